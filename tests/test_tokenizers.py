import json
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.operators import bpe, chunks, encode, wordpiece
from quillmill.operators.wordpiece import Encoder, Vocab
from quillmill.plans import queries
from quillmill.sources import vocab as files
from quillmill.tokenizer import Tokenizer, TokenizerOptions, load_bpe, load_vocab

TINY = Vocab(("[PAD]", "[UNK]", "[CLS]", "[SEP]", "hello", "world", "!", "un", "##aff", "##able", "ab", "a", "##bc", "i", "##jkl", "ij", "##kl"))
BPE = bpe.BpeVocab(("h", "e", "l", "o", "Ġ", "w", "r", "d", "lo", "low", "er"), (("l", "o"), ("lo", "w"), ("e", "r")))


def ask(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in sorted(rows.select("i", f(F.col("t"))).collect())]


@pytest.mark.parametrize(
    "text, limit, padding, want",
    [
        ("Hello world!", 16, "max_length", [2, 4, 5, 6, 3] + [0] * 11),
        ("Hello world!", -1, "max_length", [2, 4, 5, 6, 3]),
        ("Hello world!", 16, "none", [2, 4, 5, 6, 3]),
        ("unaffable hello", 4, "max_length", [2, 1, 1, 3]),
        ("!" * 13 + " unaffable", 16, "max_length", [2] + [6] * 13 + [7, 3]),
        ("!" * 13 + " unaffx", 16, "max_length", [2] + [6] * 13 + [7, 3]),
        ("!" * 12 + " unaffx", 16, "max_length", [2] + [6] * 12 + [1, 3, 0]),
        ("!" * 12 + " unaffablex hello", 16, "max_length", [2] + [6] * 12 + [7, 8, 3]),
        ("hello", 1, "max_length", [2, 3]),
        ("hello", 0, "max_length", [2, 3]),
        ("", -1, "none", [2, 3]),
        (None, 16, "max_length", None),
    ],
)
def test_encode(spark, text, limit, padding, want):
    assert ask(spark, ["hello", text], lambda c: encode.encode(c, TINY, limit, padding))[1] == want


def test_segmentation():
    assert TINY.forward("unaffable") == ([7, 8, 9], True) and TINY.limited("unaffx", 99) == [1]
    assert TINY.limited("abc", 99) == [1] and TINY.limited("abc", 99, backward=True) == [11, 12]
    assert TINY.both("abc", 99) == [1] and TINY.limited("ijkl", 99) == [15, 16]
    assert TINY.limited("ijkl", 99, backward=True) == [13, 14] and TINY.both("ijkl", 99) == [13, 14]
    assert wordpiece.less([], [5]) and not wordpiece.less([5], []) and not wordpiece.less([5], [5]) and wordpiece.less([5, 9], [6])


def sequential(vocab, words, limit):
    """The rule, one word after the other."""
    most = limit - 1 if limit >= 0 else 10**9
    out = [vocab.cls]
    for w in words:
        room = most - len(out)
        if len(w.encode()) > most and room > 0:
            out.append(vocab.unk)
            continue
        pieces, ok = vocab.forward(w)
        if ok or len(pieces) > room:
            out += pieces[: max(room, 0)]
        elif room > 0:
            out.append(vocab.unk)
    return out + [vocab.sep]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["hello", "unaffable", "unaffx", "unaffablex", "ab", "abc", "abbc", "ijkl", "!", "zz"]), max_size=12), max_size=4), st.integers(0, 14))
def test_limits_against_the_sequential_rule(docs, limit):
    got = Encoder(TINY, False, limit).encode(pa.array(docs, pa.list_(pa.string()))).to_pylist()
    assert got == [sequential(TINY, d, limit) for d in docs]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abijkl", min_size=1, max_size=8), max_size=8), st.integers(3, 12))
def test_bidirectional_against_the_rule(words, limit):
    got = Encoder(TINY, True, limit).encode(pa.array([words], pa.list_(pa.string()))).to_pylist()[0]
    body = [i for w in words for i in TINY.both(w, limit - 1)]
    assert got == [2, *body[: limit - 2], 3]


def test_encode_many_limits(spark):
    vocab, docs = load_vocab(), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from quillmill.functions.text import basic_tokenize

    rows = docs.select(basic_tokenize(F.col("text")).alias("w"), *[encode.encode(F.col("text"), vocab, n, "none").alias(f"n{n}") for n in (8, 33, 512, -1)]).collect()
    for r in rows:
        for n in (8, 33, 512, -1):
            assert r[f"n{n}"] == sequential(vocab, r["w"], n)


def test_decode(spark):
    rows = spark.createDataFrame([(0, [2, 4, 5, 6, 3, 0]), (1, [7, 8, 9]), (2, [8, 4]), (3, [1, 4]), (4, []), (5, None), (6, [8, 9, 4, 5])], "i int, ids array<int>")
    got = [r[1] for r in sorted(rows.select("i", encode.decode(F.col("ids"), TINY)).collect())]
    assert got == ["hello world !", "unaffable", "affhello", "[UNK] hello", "", None, "affablehello world"]
    with pytest.raises(Exception, match="unknown token id 99"):
        spark.createDataFrame([([99],)], "ids array<int>").select(encode.decode(F.col("ids"), TINY)).collect()


def test_decode_roundtrip_has_the_whole_turn(spark, tmp_path):
    texts = ["the end of it " * 300 + "the", "the", "", None]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["turn"]: r["decoded"] for r in queries.QUERIES["decode_roundtrip"](spark, str(tmp_path)).collect()}
    assert got[1] == "the" and got[2] == "" and got[3] is None
    assert got[0].split().count("the") == 301


def test_conversation_totals_have_no_limit(spark, tmp_path):
    rows = [(1, 0, "the " * 500), (1, 1, "the"), (2, 0, "")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["conversation_token_budget"](spark, str(tmp_path)).collect())
    assert got == [(1, 505, 2), (2, 2, 1)]


def test_tokenize(spark):
    assert ask(spark, ["unaffable!", None], lambda c: encode.tokenize(c, TINY)) == [["un", "##aff", "##able", "!"], None]
    assert ask(spark, ["hello abc"], lambda c: encode.encode_raw(c, TINY))[0] == [4, 1]


def test_relational_segmentation(spark):
    vocab = spark.createDataFrame(list(enumerate(TINY.tokens)), "id int, token string")
    rng = random.Random(1)
    words = ["unaffable", "unaffx", "abc", "ijkl", "", "hello"] + ["".join(rng.choice("abijklunf") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    got = {r["word"]: (r["ids"], r["ok"]) for r in wordpiece.segment_relational(spark.createDataFrame([(w,) for w in words], "word string"), vocab).collect()}
    assert got == {w: TINY.forward(w) for w in words}


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "v.txt").write_bytes("﻿a \r\n\r\n  \nb\t\nc \na\n".encode())
    path = f"file://{tmp_path}/v.txt"
    assert sorted(map(tuple, files.wordpiece_vocab(spark, path).collect())) == [(0, "a"), (1, "b"), (2, "c"), (3, "a")]
    assert load_vocab(spark, path).tokens == ("a", "b", "c", "a") and load_vocab(spark, path).id_of("a") == 3
    vocab = files.wordpiece_vocab(spark, path)
    tokens = spark.createDataFrame([("a",), ("zz",), (None,)], "token string")
    assert {r["token"]: r["id"] for r in files.lookup_ids(tokens, vocab).collect()} == {"a": 3, "zz": 0, None: 0}
    with pytest.raises(Exception, match="unknown token id 9"):
        files.lookup_tokens(spark.createDataFrame([(9,)], "id int"), vocab).collect()
    (tmp_path / "m.txt").write_text("#version: 0.2\n# #\nl o\n\nlo w x\nalone\n  e r \n", encoding="utf-8")
    merges = files.bpe_merges(spark, f"file://{tmp_path}/m.txt")
    assert sorted(map(tuple, merges.collect())) == [(0, "l", "o"), (1, "lo", "w"), (2, "e", "r")]
    (tmp_path / "v.json").write_text(json.dumps({t: i for i, t in enumerate(BPE.tokens)}), encoding="utf-8")
    assert files.bpe_vocab(spark, f"file://{tmp_path}/v.json").count() == 11
    assert load_bpe(spark, f"file://{tmp_path}/v.json", f"file://{tmp_path}/m.txt") == BPE
    (tmp_path / "gap.json").write_text('{"a": 0, "b": 2}', encoding="utf-8")
    with pytest.raises(Exception, match="gaps"):
        files.bpe_vocab(spark, f"file://{tmp_path}/gap.json").collect()


def test_bpe(spark):
    assert ask(spark, ["é a\n"], bpe.byte_map) == ["Ã©ĠaĊ"]
    assert ask(spark, ["hello world", "it's 42²"], bpe.pretokenize) == [["helloĠworld"], ["it", "'s", "Ġ", "42", "Â", "²"]]
    assert ask(spark, ["hello  world\n"], lambda c: bpe.pretokenize(c, "canonical")) == [["hello", "Ġ", "Ġworld", "Ċ"]]
    assert ask(spark, ["lower low", "low é", None, ""], lambda c: bpe.encode(c, BPE)) == [[9, 10, 4, 9], [9, 4], None, []]
    rows = spark.createDataFrame([(0, [9, 10, 4, 9]), (1, [9, 999, 4, -1])], "i int, ids array<int>")
    assert [r[1] for r in sorted(rows.select("i", bpe.decode(F.col("ids"), BPE)).collect())] == ["lower low", "low "]
    assert BPE.ordered() and not bpe.BpeVocab(BPE.tokens, (("lo", "w"), ("l", "o"))).ordered()


def test_byte_map_round_trip(spark):
    texts = ["".join(map(chr, range(0, 256))), "中\U0001f600é", "x\x00y"]
    assert ask(spark, texts, lambda c: bpe.byte_unmap(bpe.byte_map(c))) == texts


def test_bpe_fold_equals_merging(spark):
    vocab, rng = load_bpe(), random.Random(2)
    texts = [" ".join(rng.choice(["the", "mention", "nation", "queen", "schön", "thethe", "été"]) for _ in range(30)) for _ in range(20)]
    assert vocab.ordered()
    got = ask(spark, texts, lambda c: bpe.encode_fold(c, vocab))
    pieces = ask(spark, texts, bpe.pretokenize)
    assert got == [[t for p in ps for t in vocab.merge(p)] for ps in pieces]


def test_chunks(spark):
    text = "One two. Three four.\n\nFive six seven. Eight  nine ten eleven"
    for size in (1, 7, 20, 1000):
        fixed = ask(spark, [text], lambda c: chunks.fixed_chunks(c, size))[0]
        assert "".join(c["text"] for c in fixed) == text and all(len(c["text"]) == size for c in fixed[:-1])
        cut = ask(spark, [text, "", None], lambda c: chunks.boundary_chunks(c, size))
        assert "".join(c["text"] for c in cut[0]) == text and cut[1:] == [[], None]
        words = ask(spark, [text], lambda c: chunks.word_chunks(c, size))[0]
        assert "".join(words) == text and all(w[0] in " \n" for w in words[1:])
    assert chunks.boundaries("aaaaa\n\nbbbb. cc dd", 9) == [(0, 7), (7, 12), (12, 18)]
    # The character at which a chunk would end counts in the search.
    assert chunks.boundaries("aaaa bbbb cccc dddd", 9)[0] == (0, 9)
    assert chunks.boundaries("aaaaaaaa\n\nbb cc", 9)[0] == (0, 10)
    assert chunks.boundaries("aaaaaaaa. bb cc", 9)[0] == (0, 9)
    assert ask(spark, [""], lambda c: chunks.fixed_chunks(c, 5)) == [[]]


def test_chunked_encoding_equals_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10_000, ""), (10_001, "x" * 50_000)], "doc_id long, text string"))
    whole = {r[0]: r[1] for r in docs.select("doc_id", encode.encode_raw(F.col("text"), TINY)).collect()}
    for size in (50, 4096):
        assert {r[0]: r[1] for r in chunks.encode_chunked(docs, TINY, size=size).collect()} == whole


def test_facade(spark):
    t = Tokenizer(TokenizerOptions(model_max_length=8))
    ids = ask(spark, ["the word", None], t.encode)
    assert len(ids[0]) == 8 and ids[1] is None
    assert ask(spark, ["the word"], lambda c: t.decode(t.encode(c, max_length=64))) == ["the word"]
    assert ask(spark, ["the word"], t.tokenize) == [["the", "word"]]
    both = Tokenizer(TokenizerOptions(bidirectional=True, model_max_length=-1))
    assert ask(spark, ["the word"], both.encode)[0] == ask(spark, ["the word"], lambda c: t.encode(c, "none", 64))[0]
    b = Tokenizer(TokenizerOptions(kind="bpe"))
    assert ask(spark, ["the thing is that"], lambda c: b.decode(b.encode(c))) == ["the thing is that"]
    with pytest.raises(ValueError):
        Tokenizer(TokenizerOptions(kind="other"))
    df = t.encode_batch(spark.createDataFrame([(1, "the word")], "id int, text string"))
    assert df.columns == ["id", "text", "ids"]

"""The numpy versions against the built-in functions and against the plain rules."""

import random
import tracemalloc
import types

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from quillmill.functions.text import basic_tokenize, basic_tokenize_sql
from quillmill.operators import bpe, segment, wordpiece, words
from quillmill.operators.segment import Segmenter
from quillmill.tokenizer import load_bpe, load_vocab

from .test_tokenizers import TINY

ODD = [None, "", " ", "\x00", "a\x00b", "!", "é", "É\u0301x", "\u0301", "中a文", "한국어 텍스트", "x\u0958y", "ｆｕｌｌ！", "a\u00a0b\u3000c", "Ǆ ſ ẞ İ ΑΣ", "a" * 5000, "\U0001f600 ok", "\U0001d15e"]


def split(texts, fold=True, cjk=True):
    return [w for x in words.word_lists(pa.array(texts, pa.string()), fold, cjk) for w in x.to_pylist()]


@pytest.mark.parametrize("fold, cjk", [(True, True), (False, True), (True, False), (False, False)])
def test_words_of_every_character(spark, fold, cjk):
    """Each code point alone, between letters and between blanks: numpy and built-in functions agree."""
    every = [chr(c) for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF and not 0x4E20 < c < 0x9FD0 and not 0xAC40 < c < 0xD780 and not 0x20020 < c < 0x2F7F0]
    texts = ODD + [" ".join(f"{c} A{c}b" for c in every[i : i + 500]) for i in range(0, len(every), 500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = [r[1] for r in sorted(rows.select("i", basic_tokenize_sql(F.col("t"), fold, cjk)).collect())]
    assert split(texts, fold, cjk) == want
    got = [r[1] for r in sorted(rows.select("i", basic_tokenize(F.col("t"), fold, cjk)).collect())]
    assert got == want


def test_words_in_chunks_and_slices(monkeypatch):
    texts = ODD * 3
    whole = split(texts)
    assert split(texts[:0]) == []
    for limit in (1, 7, 100):
        monkeypatch.setattr(words.chunks_of, "__defaults__", (limit,))
        assert split(texts) == whole
    part = pa.array(["zz", *texts]).slice(3)
    assert [w for x in words.word_lists(part) for w in x.to_pylist()] == whole[2:]
    assert [w for x in words.word_lists(pa.array(texts, pa.large_string())) for w in x.to_pylist()] == whole


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choice(["é", "word", "a\x00b", "中x", "!?", "x" * 300]) for _ in range(3000))
    whole = split([text, "y", text[:700]])
    monkeypatch.setattr(words, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(words.chunks_of, "__defaults__", (1000,))
    assert len(list(words.at_blanks(words.string_parts(pa.array([text]))[0]))) > 50
    assert split([text, "y", text[:700]]) == whole
    assert split(["x" * 5000]) == [["x" * 5000]]


def test_bytes_that_are_no_utf8():
    bad = pa.array([b"ok \xff\xfe x", b"\xc3", "é".encode()], pa.binary())
    col = pa.Array.from_buffers(pa.string(), 3, bad.buffers())
    assert [w for x in words.word_lists(col) for w in x.to_pylist()] == [["ok", "x"], [], ["e"]]


@pytest.mark.parametrize("few", [0, 48])
def test_segmenter_against_the_rule(few, monkeypatch):
    monkeypatch.setattr(segment, "FEW", few)
    rng = random.Random(1)
    more = wordpiece.Vocab((*TINY.tokens, "é", "##é", "##", "a中", "##中", "a"))
    for vocab in (more, load_vocab()):
        own = ["", "a" * 3000, *{"".join(rng.choice("abijklunfé中##tion") for _ in range(rng.randrange(1, 12))) for _ in range(1500)}]
        col, seg = pa.array(own), Segmenter(vocab)
        for back in (False, True):
            ids, offs, ok = seg.greedy(col, back)
            for i, w in enumerate(own):
                assert (ids[offs[i] : offs[i + 1]].tolist(), bool(ok[i])) == (vocab.backward(w) if back else vocab.forward(w)), w
        for most in (0, 1, 3, 7, wordpiece.UNLIMITED):
            rules = {"forward": lambda w: vocab.limited(w, most), "backward": lambda w: vocab.limited(w, most, backward=True), "both": lambda w: vocab.both(w, most)}
            for direction, rule in rules.items():
                ids, offs = seg.limited(col, most, direction)
                assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:])] == [rule(w) for w in own], (most, direction)


def merged(vocab, piece):
    """The rule of merging, with a scan for each merge."""
    parts = list(piece)
    while len(parts) > 1:
        best = min(zip(parts, parts[1:]), key=lambda p: vocab.ranks.get(p, 1 << 60))
        if best not in vocab.ranks:
            break
        out, i = [], 0
        while i < len(parts):
            pair = i + 1 < len(parts) and (parts[i], parts[i + 1]) == best
            out.append(parts[i] + parts[i + 1] if pair else parts[i])
            i += 1 + pair
        parts = out
    return parts


def test_heap_merging_against_the_rule():
    """Random merges, in order and not, repeated pairs among them."""
    rng = random.Random(3)
    for _ in range(2000):
        tokens, merges = list("abc"), []
        for _ in range(rng.randrange(12)):
            merges.append((rng.choice(tokens), rng.choice(tokens)))
            tokens.append("".join(merges[-1]))
        if rng.random() < 0.5:
            rng.shuffle(merges)
        vocab = bpe.BpeVocab(("a",), tuple(merges))
        piece = "".join(rng.choice("abc") for _ in range(rng.randrange(25)))
        assert vocab.merge(piece) == merged(vocab, piece), (merges, piece)


def test_thousands_of_merges_and_a_long_piece():
    """A piece of 100,000 letters under 5,000 merges: no rescan for each merge, and the same as the batch-wise passes."""
    rng = random.Random(5)
    tokens, merges = list("abcdefgh"), {}
    while len(merges) < 5000:
        a, b = rng.choice(tokens), rng.choice(tokens)
        if len(a + b) < 12 and a + b not in merges:
            merges[a + b] = (a, b)
            tokens.append(a + b)
    vocab = bpe.BpeVocab(tuple(dict.fromkeys(tokens)), tuple(merges.values()))
    piece = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    got = vocab.merge(piece)
    assert "".join(got) == piece and len(got) < 90_000
    assert vocab.ordered()
    few = bpe.BpeVocab(vocab.tokens, vocab.merges[:1000])
    encoder = bpe.BpeEncoder(few)
    assert encoder.folder and encoder.texts(pa.array([piece])).to_pylist()[0] == [few.ids[t] for t in few.merge(piece)]
    assert bpe.BpeEncoder(vocab).folder is None
    assert bpe.BpeEncoder(vocab).texts(pa.array([piece[:500]])).to_pylist()[0] == [vocab.ids[t] for t in merged(vocab, piece[:500])]


@pytest.mark.parametrize("fold", [True, False])
def test_bpe_batches_against_the_rule(fold):
    vocab, rng = load_bpe(), random.Random(4)
    char = {b: chr(b) if b in set(bpe._PLAIN) else chr(256 + bpe._MOVED.index(b)) for b in range(256)}
    pieces = regex.compile(bpe.MAPPED_PIECE)
    texts = ["it's 'tis 're''s 42's 'll'd'", "", "'", "''", "x'", "x's", "x'r", "don't've é'm", None] + ["".join(rng.choice("abth 'sredlvm42.\n'é中") for _ in range(rng.randrange(40))) for _ in range(1500)]
    encoder = bpe.BpeEncoder(vocab)
    if not fold:
        encoder.folder = None
    for t, got in zip(texts, encoder.texts(pa.array(texts)).to_pylist()):
        mapped = "".join(char[b] for b in (t or "").encode())
        assert got == (None if t is None else [vocab.ids[x] for p in pieces.findall(mapped) for x in merged(vocab, p) if x in vocab.ids]), t


def test_missing_specials_and_special_text(spark):
    """Without special tokens their id is 0; special tokens in a text are split like any text."""
    from quillmill.operators import encode

    bare = wordpiece.Vocab(("[PAD]", "x", "##y"))
    rows = spark.createDataFrame([("x xy q",), ("[CLS]",)], "t string")
    assert [r[0] for r in rows.select(encode.encode(F.col("t"), bare)).collect()] == [[0, 1, 1, 2, 0, 0], [0, 0, 0, 0, 0]]


def peak(f, *batches):
    """MB that numpy and Python hold at most in a call, beyond what was there."""
    f(*batches)  # tables are made once
    tracemalloc.start()
    f(*batches)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def test_bpe_decoding_needs_no_arrays_of_the_whole_batch(monkeypatch):
    """what decoding holds does not grow with a batch, but for its bytes; cut anywhere, the texts are the same."""
    vocab, made = load_bpe(), []
    monkeypatch.setattr(bpe, "arrow_udf", lambda kind: lambda f: made.append(f) or (lambda ids: F.lit(b"")))
    monkeypatch.setattr(bpe, "F", types.SimpleNamespace(make_valid_utf8=lambda c: c))
    monkeypatch.setattr(F, "lit", lambda b: types.SimpleNamespace(cast=lambda kind: b))
    bpe.decode(None, vocab)
    rows = [None, [], [0, 5, -1, 1 << 20, None], *([i % 300 for i in range(n)] for n in (1, 7, 0, 50)), None]
    batch = pa.array(rows, pa.list_(pa.int32()))
    whole = made[0](batch).to_pylist()
    ids = batch.to_pylist()
    unmap = {chr(int(p)): b for b, p in enumerate(bpe.Mapped().point)}
    raw = [bytes(unmap[c] for c in t if c in unmap) for t in vocab.tokens]
    assert whole == [None if r is None else b"".join(raw[i] for i in r if i is not None and 0 <= i < len(raw)) for r in ids]
    for n in (1, 3, 8):
        monkeypatch.setattr(bpe, "DECODED_IDS", n, raising=False)
        assert made[0](batch).to_pylist() == whole and made[0](batch.slice(2)).to_pylist() == whole[2:] and made[0](batch[:0]).to_pylist() == []
    monkeypatch.undo()
    many = pa.array([[7] * 1000] * 3000, pa.list_(pa.int32()))
    assert peak(made[0], many) < 30


def test_bpe_fold_merges_whole_texts(spark):
    """the merges are outside of the function that is interpreted for each element."""
    one = spark.createDataFrame([("ab",)], "t string").select(bpe.encode_fold(F.col("t"), load_bpe()))
    before = one._jdf.queryExecution().analyzed().toString().partition("lambdafunction(")[0]
    assert before.count("replace(") >= len(load_bpe().merges)
    odd = bpe.BpeVocab(("a",), (("a", "b"), ("ab", "ab"), ("", ""), ("c", "c")))
    texts = ["ababab ab", "", None, "ccccc'sabab", "'", "x'll ab\n12ab", "ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for mode in ("reference", "canonical"):
        got = [r[1] for r in sorted(rows.select("i", bpe.encode_fold(F.col("t"), odd, mode)).collect(), key=lambda r: r[0])]
        pieces = [r[1] for r in sorted(rows.select("i", bpe.pretokenize(F.col("t"), mode)).collect(), key=lambda r: r[0])]
        assert got == [None if ps is None else [t for p in ps for t in odd.merge(p)] for ps in pieces]


@pytest.mark.parametrize("both", [False, True])
def test_encoding_holds_little_beyond_a_batch(both):
    """what a worker holds for words and ids does not grow with its batch."""
    rng = random.Random(5)
    words_ = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(5000)]
    texts = pa.array([" ".join(rng.choices(words_, k=400)) for _ in range(3000)], pa.string())
    encoder = wordpiece.Encoder(load_vocab(), both, 128)

    def ids(batch):
        return sum(len(encoder.encode(x)) for x in words.word_lists(batch))

    assert ids(texts) == len(texts)
    assert peak(ids, texts) < 80

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import decontaminate, embedding_dedup, html_text, langid, mixing, near_dedup, sharding, substring_index, suffix_dedup, url_filter
from quillmill.llm import textkit as tk
from quillmill.llm import windows as wn

from . import brute

SF = "/root/testdata/sf0.001"


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def awkward_docs(spark, texts):
    rows = brute.awkward(texts)
    return spark.createDataFrame(rows, brute.AWKWARD_SCHEMA), [(r[0], r[1]) for r in rows]


def passages(seed=1, n=40):
    """Texts that share passages of various lengths, copies and near copies among them."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "Delta", "épée", "übung"]) + str(rng.randrange(60))
    shared = [[word() for _ in range(m)] for m in (6, 9, 12, 20, 30)]
    out = []
    for i in range(n):
        body = [word() for _ in range(rng.randrange(5, 40))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(body))
            body[at:at] = rng.choice(shared)
        out.append((i, ", ".join(body) if i % 3 else " ".join(body).upper()))
    out += [(100 + i, out[i][1]) for i in range(5)] + [(3, out[3][1])]
    return out


# --- shared parts ---


def test_pack_round_trip():
    a = np.array([0, 1, 300, 1 << 39], np.uint64)
    assert (wn.unpack(wn.pack(a), np.uint64) == a).all()
    assert (wn.unpack(wn.pack(a, 5), np.uint64, 5) == a).all()
    pos = np.array([0, 1, 5, 70_000, 9_000_000])
    assert (wn.unpack_sorted(wn.pack_sorted(pos)) == pos).all()


def test_winnowing_guarantee():
    """Any passage of k + w - 1 words has a selected gram in common in both texts."""
    import pyarrow as pa

    rng = random.Random(3)
    for _ in range(50):
        shared = [f"w{rng.randrange(30)}" for _ in range(12)]
        texts = [" ".join([f"x{rng.randrange(50)}" for _ in range(rng.randrange(9))] + shared + [f"y{rng.randrange(50)}" for _ in range(rng.randrange(9))]) for _ in range(2)]
        sets = []
        for t in texts:
            for words in tk.word_chunks(pa.array([t])):
                h, _ = tk.gram_hashes(words, 5)
                sets.append(set(h[tk.winnow(h, words.doc_start, 5, 8)].tolist()))
        assert sets[0] & sets[1]


def test_long_documents_in_parts(monkeypatch):
    """Words and grams are the same, however a document is cut for hashing."""
    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "be-ta", "é", "x" * 90]) for _ in range(2000)), "y" * 9000, "!" * 3000, "a b"]
    whole = [(w.lo, w.hashes, w.start, w.end, w.doc_start, *(tk.gram_hashes(w, k)[0] for k in (1, 5, 50))) for w in tk.word_chunks(pa.array(texts))]
    monkeypatch.setattr(tk.chunks_of, "__defaults__", (1000,))
    cut = {w.lo: (w.hashes, tk.gram_hashes(w, 5)[0]) for w in tk.word_chunks(pa.array(texts))}
    monkeypatch.setattr(tk, "BLOCK", 700)
    got = {w.lo: (w.hashes, tk.gram_hashes(w, 5)[0], w.start, w.end) for w in tk.word_chunks(pa.array(texts))}
    assert sorted(got) == sorted(cut) and len(whole) == 1
    for lo, (h, g, a, b) in got.items():
        assert (h == cut[lo][0]).all() and (g == cut[lo][1]).all() and (b > a).all()


# --- 1: URL filter ---


def test_url_filter(spark):
    pages = spark.createDataFrame(
        [(1, "https://www.Bad.example.org/x?a=1#top", "r"), (2, "http://sub.bad.example.org", "r"), (3, "https://notbad.example.org/", "r"), (4, None, "r"), (5, "", "r"), (6, "http://ok.example.com/page/", "r"),
         (6, "http://ok.example.com/page/", "r"), (None, "HTTP://user@ok.example.com:8080/page", "r"), (7, "http://ok.example.com/Page", "r"), (8, "http://a.example/" + "x" * 100_000, "r"), (9, "::::", "r")],
        "page_id long, url string, rule string",
    )
    rules = spark.createDataFrame([("bad.example.org",), ("https://ok.example.com/page",), ("https://ok.example.com/page/",), (None,), ("",), ("http://a.example/" + "x" * 100_000,)], "entry string")
    got = sorted((r["page_id"] or 0, r["blocked"], (r["rule"] or "")[:30]) for r in url_filter.filter_urls(pages, url_filter.build(spark, rules)).collect())
    assert got == sorted(
        [(1, True, "bad.example.org"), (2, True, "bad.example.org"), (3, False, ""), (4, False, ""), (5, False, ""), (6, True, "ok.example.com/page"), (6, True, "ok.example.com/page"), (0, True, "ok.example.com/page"),
         (7, False, ""), (8, True, ("a.example/" + "x" * 30)[:30]), (9, False, "")]
    )
    none = url_filter.build(spark, rules.limit(0))
    assert url_filter.filter_urls(pages, none).where("blocked").count() == 0
    assert url_filter.filter_urls(pages.limit(0), none).count() == 0


@pytest.mark.parametrize("most", [1, 16])
def test_digest_array_confirms_strings(tmp_path, monkeypatch, most):
    """Equal keys of different strings, also across files, are told apart; files are let go and opened again."""
    monkeypatch.setattr(url_filter, "MAX_OPEN", most)
    import pyarrow as pa

    paths = []
    for i, rows in enumerate([[(1, "a"), (5, "b")], [(5, "c"), (5, "d"), (9, "e")]]):
        table = pa.table({"key": pa.array([k for k, _ in rows], pa.int64()), "s": pa.array([s for _, s in rows], pa.large_string())})
        paths.append(f"file://{tmp_path}/{i}.arrow")
        with pa.OSFile(f"{tmp_path}/{i}.arrow", "wb") as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table)
    digests = url_filter.DigestArray(tuple(paths), np.array([1, 5], np.int64))
    keys = np.array([1, 5, 5, 5, 5, 9, 9, 0, 7], np.int64)
    names = pa.array(["a", "b", "c", "d", "x", "e", "z", "a", "c"])
    for _ in range(2):
        assert digests.lookup(keys, names).tolist() == [True, True, True, True, False, True, False, False, False]
    assert len(url_filter._OPEN) <= most


# --- 2: decontamination ---


def test_decontamination(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    got = {tuple(r) for r in decontaminate.contamination(documents(spark), bench).collect()}
    want = set(brute.contained(rows, items, decontaminate.SHINGLE, decontaminate.THRESHOLD))
    assert got <= want and len(got) >= 0.98 * len(want) > 0
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(documents(spark), bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _, _ in got}


def test_decontamination_awkward(spark):
    item = " ".join(f"bench{i}" for i in range(30))
    long_item = " ".join(f"long{i}" for i in range(400))
    texts = [(0, "x " * 3000 + item + " y" * 3000), (1, item.upper()), (1, item.upper()), (2, " ".join(item.split()[:12])), (3, "tiny item"), (4, long_item + " end")]
    docs, rows = awkward_docs(spark, texts)
    items = [(7, item), (7, item), (8, None), (9, ""), (10, "tiny item"), (None, "one"), (11, long_item)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(tuple(r) for r in decontaminate.contamination(docs, bench).collect())
    assert got == [(0, 7, 1.0), (1, 7, 1.0), (1, 7, 1.0), (3, 10, 1.0), (4, 11, 1.0)]
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 5


def test_decontamination_short_items(spark):
    """Items of one to four words are found at any place of longer documents, and only as a run of words."""
    rng = random.Random(4)
    items = [(1, "Paris"), (2, "in the Dark"), (3, "w1 w2"), (4, "w1 w2"), (5, "w3"), (6, "w4 w5 w1 w2"), (7, "w1 w2 w3 w4 w5"), (8, "!"), (9, "w2 w2 w2")]
    texts = [(0, "x " * 50 + "in THE dark" + " y" * 50), (1, "in the"), (2, "in a dark"), (3, "Paris"), (4, "a b c d e f, paris"), (5, "parish in the"), (6, "dark"), (7, None), (7, "")]
    texts += [(i, " ".join(f"w{rng.randrange(6)}" for _ in range(rng.randrange(1, 30)))) for i in range(10, 80)]

    def held(text, item):
        w, own = brute.words(text), brute.words(item)
        return bool(own) and own in [w[p : p + len(own)] for p in range(len(w))]

    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.contamination(docs, bench).collect())
    assert got == sorted((d, i, 1.0) for d, t in texts for i, it in items if held(t, it)) and (0, 2, 1.0) in got and (4, 1, 1.0) in got
    kept = [r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()]
    assert sorted(kept) == sorted(d for d, t in texts if not any(held(t, it) for _, it in items))
    bench = spark.createDataFrame([(7, items[1][1]), (7, "w9 w9 w9 w9 w9")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contamination(docs, bench).collect()] == [(0, 7, 1.0)]


def test_decontamination_has_one_lower_case(spark):
    """What is reported is dropped, whatever the script; a sigma's place in a word and a dotted capital I do not matter."""
    texts = [(0, "x " * 9 + "ΟΔΟΣ ΕΛΛΑΔΟΣ.ΑΒ" + " y" * 9), (1, "ΟΔΟΣ ΕΛΛΑΔΟΣ"), (2, "İSTANBUL'DA ÇOK GÜZEL BİR GÜN VAR " + "z " * 9), (3, "istanbul"), (4, "Straße ÉTÉ"), (5, "STRASSE été"), (6, "οδοσ ελλαδοσ")]
    items = [(1, "οδός ελλάδος"), (2, "Οδος Ελλαδος"), (3, "İstanbul'da çok güzel bir gün var"), (4, "STRAßE été")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.contamination(docs, bench).collect()), key=str)
    assert got == brute.contained(texts, items, 5, 0.5)
    assert {(0, 2), (1, 2), (6, 2), (2, 3), (4, 4)} == {x[:2] for x in got}
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs.withColumnRenamed("text", "TEXT"), bench).collect()}
    assert kept == {3, 5}


def test_decontamination_short_and_long_items_against_brute_force(spark):
    """Items of one to thirty words, several texts an id, over one index and over many."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(12)}"
    items = [(i // 2, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 30])))) for i in range(40)]
    texts = []
    for i in range(120):
        body = [word() for _ in range(rng.randrange(0, 40))]
        if i % 3 == 0:
            body[len(body) // 2 : len(body) // 2] = rng.choice(items)[1].split()
        texts.append((i, " ".join(body)))
    texts += texts[:5]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contained(texts, items, 5, 0.5)
    assert len(want) > 100
    for most in (1, 7, 1000):
        got = sorted((tuple(r) for r in decontaminate.contamination(docs, bench, max_items=most).collect()), key=str)
        assert set(got) <= set(want) and len(got) >= 0.98 * len(want)
        short = {i for i, t in items if len(t.split()) < 5}
        assert [x for x in got if x[1] in short and x[2] == 1.0] == [x for x in want if x[1] in short and x[2] == 1.0]
        kept = decontaminate.drop_contaminated(docs, bench, max_items=most).collect()
        assert {r["doc_id"] for r in kept} == {d for d, _ in texts} - {x[0] for x in got}


# --- 3 and 10: repeated passages ---


@pytest.mark.parametrize("batches, most", [(1, 1000), (4, 1000), (3, 0)])
def test_substring_index(spark, batches, most, monkeypatch):
    from quillmill.llm import bloom

    monkeypatch.setattr(bloom, "BROADCAST_IDS", most)
    docs, rows = awkward_docs(spark, passages())
    got = sorted(tuple(r) for r in substring_index.incremental_duplicates(docs, length=10, window=5, batches=batches).collect())
    assert got == brute.repeated_spans(rows, 10, True) != []
    assert substring_index.incremental_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("qgram", [2, 5, 9])
def test_suffix_dedup(spark, qgram):
    docs, rows = awkward_docs(spark, passages(2))
    got = sorted(tuple(r) for r in suffix_dedup.repeated_substrings(docs, length=10, qgram=qgram).collect())
    assert got == brute.repeated_spans(rows, 10, False) != []
    assert suffix_dedup.repeated_substrings(docs.limit(0)).count() == 0


def test_repeats_of_the_corpus(spark, monkeypatch):
    """Production parameters on sf0.001, with segments and parts so small that there are many."""
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(tuple(r) for r in substring_index.incremental_duplicates(docs).collect())
    assert got == brute.repeated_spans(rows, 50, True) != []
    monkeypatch.setattr(wn, "PART_BYTES", 1 << 15)
    got = sorted(tuple(r) for r in suffix_dedup.repeated_substrings(docs).collect())
    assert got == brute.repeated_spans(rows, 50, False) != []


def test_index_over_two_sessions(spark, tmp_path):
    """Batches added in two sessions, each verified as it comes, give what brute force gives; runs are sorted and compacted in tiers."""
    rows = sorted({(i, t) for i, t in passages(5, 60) if i != 3})
    cuts = [0, 11, 20, 31, 39, 48, 70, 1000]
    read = lambda s, lo, hi: s.createDataFrame([r for r in rows if lo <= r[0] < hi], "doc_id long, text string").select("doc_id", tk.lowered("text").alias("__text"))
    index, got = substring_index.FingerprintIndex.create(spark, f"file://{tmp_path}/index", 10, 5, buckets=4, fanout=2), []
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        if k == 3:  # another session knows no more than the folder
            index.close()
            session = spark.newSession()
            index = substring_index.FingerprintIndex.open(session, f"file://{tmp_path}/index")
        own = index.spark
        found = [tuple(r) for r in index.add(read(own, lo, hi), read(own, 0, lo)).collect()]
        assert sorted(found) == [s for s in brute.repeated_spans([r for r in rows if r[0] < hi], 10, True) if s[0] >= lo]
        got += found
        levels = [r["level"] for r in index.runs]
        assert len(levels) == len(set(levels)) == bin(k + 1).count("1")
        for r in index.runs:
            part = index.table(r["name"]).select("h", F.input_file_name().alias("p"), F.monotonically_increasing_id().alias("i")).orderBy("i").collect()
            assert all(a["h"] <= b["h"] for a, b in zip(part, part[1:]) if a["p"] == b["p"])
    assert sorted(got) == brute.repeated_spans(rows, 10, True) != []
    with pytest.raises(ValueError, match="above"):
        index.add(read(own, 0, 5))
    assert index.add(read(own, 5000, 6000)).count() == 0
    plan = index.table(index.runs[0]["name"]).hint("merge").join(index.table(index.runs[1]["name"]).select("h"), "h", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    index.delete()
    with pytest.raises(ValueError, match="no index"):
        substring_index.FingerprintIndex.open(spark, f"file://{tmp_path}/index")


def test_passage_of_every_document(spark, monkeypatch):
    """One passage in all documents leaves a segment once, however many of its documents have it."""
    rng = random.Random(8)
    shared_words = " ".join(f"s{i}" for i in range(60))
    rows = [(i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(20))) + f" {shared_words} " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(20)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(tuple(r) for r in suffix_dedup.repeated_substrings(docs).collect()) == brute.repeated_spans(rows, 50, False)
    assert sorted(tuple(r) for r in substring_index.incremental_duplicates(docs).collect()) == brute.repeated_spans(rows, 50, True)
    texts = docs.select("doc_id", tk.lowered("text").alias("t"))
    sent = texts.mapInArrow(lambda it: suffix_dedup._initial(it, 25, 3), wn.SCHEMA).where("part >= 0").collect()
    total = sum(len(wn.unpack_sorted(r["c"])) for r in sent)
    windows = sum(max(0, len(brute.words(t)) - 24) for _, t in rows)
    assert total <= windows - 36 * (400 - 2)  # of the passage's 36 inner windows one for each segment


# --- 4: sharding ---


def test_minimax_cuts():
    rng = random.Random(5)
    for _ in range(200):
        sizes = [rng.randrange(0, 30) for _ in range(rng.randrange(1, 25))]
        n = rng.randrange(1, 8)
        capacity, starts = sharding.minimax_cuts(sizes, n)
        assert capacity == brute.least_capacity(sizes, n)
        bounds = [*starts, len(sizes)]
        assert starts[0] == 0 and len(starts) <= n and max(sum(sizes[a:b]) for a, b in zip(bounds, bounds[1:])) <= capacity


def test_sharding_documents(spark):
    docs, rows = awkward_docs(spark, passages())
    for n in (1, 3, 500):
        got = sharding.assign_shards(docs, sharding.document_group(F.col("source"), F.col("doc_id")), F.length("text"), n)
        assert got.count() == len(rows) and set(got.columns) == set(docs.columns)
        by = {}
        for r in got.select(sharding.document_group(F.col("source"), F.col("doc_id")).alias("g"), F.coalesce(F.length("text"), F.lit(0)).alias("s"), "shard_id").collect():
            by.setdefault(r["g"], []).append((r["s"], r["shard_id"]))
        order = sorted(by)
        shards = [{s for _, s in by[g]} for g in order]
        assert all(len(s) == 1 for s in shards)  # atomic
        flat = [min(s) for s in shards]
        assert flat == sorted(flat) and len(set(flat)) <= n  # contiguous
        loads = {}
        for g, s in zip(order, flat):
            loads[s] = loads.get(s, 0) + sum(x for x, _ in by[g])
        if n == 3:
            assert max(loads.values()) == brute.least_capacity([sum(x for x, _ in by[g]) for g in order], n)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


# --- 5: HTML extraction ---


def test_html_extraction(spark):
    para = "This is a long paragraph of the article, with many words and few tags in it, as articles have. " * 3
    menu = "".join(f'<li><a href="/{i}">item {i}</a></li>' for i in range(12))
    page = f"<html><head><title>T</title><style>p{{x}}</style><script>var s = '<p>no</p>';</script></head><body><nav><ul>{menu}</ul></nav><article><p>{para}</p><p>Tom &amp; <b>Ann</b> {para}<p>{para}</article><footer><a>a</a><a>b</a> (c)</footer></body></html>"
    rows = [(1, page, "t"), (2, None, "t"), (3, "", "t"), (4, "<p>", "t"), (5, "plain text only", "t"), (None, page, "t"), (1, page, "t"), (6, "<p>" + "wort " * 200_000, "t"), (7, "<![bad <x", "t"), (8, "<div><div><div>", "t")]
    got = {}
    for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect():
        got.setdefault(r["page_id"], []).append(r)
    text = got[1][0]["text"]
    assert text.count("This is a long paragraph") == 9 and "Tom & Ann This" in text
    assert "item 3" not in text and "var s" not in text and "p{x}" not in text and "(c)" not in text
    assert len(got[1]) == 2 and got[1][0] == got[1][1] and got[None][0]["text"] == text
    assert [got[i][0]["text"] for i in (2, 3, 4, 8)] == [""] * 4
    assert got[5][0]["text"] == "plain text only" and len(got[6][0]["text"]) == 999_999
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_html_parts():
    assert html_text.threshold(np.array([1.0, 1, 1])) == 0.0
    assert html_text.threshold(np.array([0.0, 0.1, 5.0, 5.2])) == pytest.approx(2.55)
    x = np.array([0.0, 0, 10, 0, 0])
    s = html_text.smooth(x, 1.0)
    assert s[2] == max(s) and s[1] == pytest.approx(s[3]) and (html_text.smooth(np.ones(4), 2.0) == pytest.approx(np.ones(4)))


@pytest.mark.parametrize(
    "start",
    [
        "<![bad x>", "<![ x>", "<![if gte mso 9>", "<![endif]-->", "<![CDATA[ never closed >", "<![>", "<!>", "<a href='&#" + "9" * 5000 + ";'>x</a>", "&#" + "9" * 5000 + "; ",
        "<head><title>hidden</title><meta charset=x>", "<head><title>hidden</title>\n", "<head><link><br/>", "<svg>", "<svg><path d=x>", "<iframe src=x>", "<object><svg></svg>", "<svg><iframe></iframe>", "<svg><svg></svg>",
        "<head><title>hidden</title><svg>", "<textarea>", "<template><noscript>", "<head><title>",
    ],
)
@pytest.mark.parametrize("tag", ["p", "div", ""])
def test_html_after_bad_markup(start, tag):
    """Bad or unclosed markup hides no text that follows it."""
    page = f"<p>before</p>{start}" + (f"<{tag}>" if tag else "") + "after it<p>last<svg><text>hidden</text></svg></p>"
    text, _, n_lines = html_text.extract(page, margin=0.0)
    assert "before" in text and "after it" in text and "last" in text and n_lines >= 2
    assert "hidden" not in text


def test_html_hidden_to_the_end():
    """An unclosed script or style has no text; closed elements stay hidden beside an unclosed one."""
    for start in ("<script>", "<style>"):
        assert html_text.extract(f"<p>before</p>{start} var after = 1")[0] == "before"
    got = html_text.extract("<svg><p>one</p><iframe>no</iframe><p>two</p><svg>no</svg><p>three", margin=0.0)[0]
    assert got.split() == ["one", "two", "three"]


def test_html_of_the_corpus(spark):
    """Articles are found and menus left out in the test pages."""
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = {r["page_id"]: r["text"] for r in html_text.extract_text(pages).collect()}
    kept = total = menus = 0
    for r in pages.collect():
        body = re.sub(r"<[^>]+>", " ", (re.findall(r"<article>(.*?)</article>", r["html"], re.S) or [""])[0])
        want = [w for w in body.split() if "&" not in w]
        have = set(out[r["page_id"]].split())
        kept += sum(w in have for w in want)
        total += len(want)
        menus += bool(re.search(r"</nav>", r["html"])) and "\n".join(re.findall(r'<li><a[^>]*>([^<]*)</a>', r["html"])) in out[r["page_id"]]
    assert kept > 0.9 * total > 0 and menus <= 0.1 * len(out)


def test_html_against_brute_force(spark):
    """All pages of sf0.001: markup by regular expressions, smoothing by its definition, the threshold by trying all."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = {r["page_id"]: tuple(r)[1:] for r in html_text.extract_text(pages).collect()}
    rows = pages.collect()
    assert len(rows) >= 50 and sum(out[r["page_id"]][1] for r in rows) > len(rows)
    for r in rows:
        assert out[r["page_id"]] == brute.html_content(r["html"], html_text.SIGMA, html_text._BLOCK, html_text._HIDDEN), r["page_id"]


# --- 6: language identification ---


def test_codewords():
    for k in (2, 3, 4, 5, 8):
        c = langid.codewords(k)
        far = min(np.count_nonzero(c[i] != c[j]) for i in range(k) for j in range(i))
        assert c.shape[0] == k and far >= max(1, 2 ** (k - 2) if k <= 5 else c.shape[1] // 4)


def test_language_id_held_out(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    got = langid.identify(test, langid.train(train)).join(test.select("doc_id", "lang"), "doc_id").collect()
    right = sum(r["lang_pred"] == r["lang"] for r in got)
    assert right >= 0.95 * len(got)
    sure = [r for r in got if not r["ambiguous"]]
    assert len(sure) >= 0.95 * len(got) and sum(r["lang_pred"] == r["lang"] for r in sure) >= 0.95 * len(sure)


def test_language_id_awkward(spark):
    docs, rows = awkward_docs(spark, [(i, "der die das und nicht wird " * 5 if i % 2 == 0 else "the and that with this have " * 5) for i in range(60)])
    model = langid.train(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 60:
            assert (r["lang_pred"], r["ambiguous"]) == ("en" if r["doc_id"] % 2 else "de", False)
        if r["doc_id"] in (900, 901, 902, 903):
            assert (r["lang_pred"], r["gap"], r["ambiguous"]) == ("und", 0.0, True)
    half = spark.createDataFrame([(1, "der die das und nicht wird the and that with this have")], "doc_id long, text string")
    assert langid.identify(half, model, min_gap=1e9).first()["ambiguous"]
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["ambiguous"]}
    nothing = langid.train(docs.limit(0))
    assert langid.identify(docs, nothing).where("lang_pred != 'und'").count() == 0
    assert langid.identify(docs.limit(0), model).count() == 0


def test_language_id_against_brute_force(spark):
    """Gram by gram and codeword by codeword, for every document of sf0.001."""
    docs = documents(spark)
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for r in docs.collect():
        lang, gap = brute.language(r["text"], model)
        mine = got[r["doc_id"]]
        assert abs(mine["gap"] - gap) < 1e-3 * max(1.0, gap), r["doc_id"]
        assert mine["lang_pred"] == lang or gap < 1e-3
        assert mine["ambiguous"] == (mine["gap"] < langid.MIN_GAP) or abs(gap - langid.MIN_GAP) < 1e-3


def test_language_id_of_long_texts(spark, monkeypatch):
    """Part by part or at once, a text has the same margins."""
    import pyarrow as pa

    model = langid.train(documents(spark))
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["der", "the", "é!!", "x  y", "los"]) for _ in range(3000)) + end for end in ("", " ", "a", "!!")]
    once = [model.predict(pa.array([t]), 0.5) for t in texts]
    monkeypatch.setattr(tk, "BLOCK", 501)
    for t, (langs, gap, _) in zip(texts, once):
        got = model.predict(pa.array([t]), 0.5)
        assert got[0] == langs and got[1] == pytest.approx(gap, rel=1e-5)


def test_language_id_sample(spark):
    """Null ids and copies change neither what is learned from nor how much of it; without labels nothing is dropped."""
    words = {"de": "der die das und nicht wird auch mit sich", "en": "the and that with this have from they which"}
    rng = random.Random(3)
    rows = [(None, " ".join(rng.choice(words[x].split()) for _ in range(30)), x) for x in ("de", "en") for _ in range(2000)]
    rows += [(None, rows[0][1], "de")] * 6000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    fit = langid.fit
    try:
        langid.fit = lambda texts, labels: seen.append((texts, labels)) or fit(texts, labels)
        model = langid.train(docs, sample_per_lang=100)
    finally:
        langid.fit = fit
    texts, labels = seen[0]
    assert model.langs == ("de", "en") and all(70 <= labels.count(x) <= 100 for x in ("de", "en")) and len(set(texts)) == len(texts)
    assert langid.keep_identified(docs, model).count() >= 0.99 * len(rows)
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_identified(bare, langid.train(bare)).count() == len(rows)


# --- 7: embeddings ---


def brute_links(rows, least):
    """Links between distinct (id, vector) rows, by comparing all of them: (i, j, cosine) of their numbers, and the rows."""
    own = sorted({(i, tuple(e)) for i, e in rows})
    links = []
    for x, (_, a) in enumerate(own):
        for y, (_, b) in enumerate(own[:x]):
            if len(a) == len(b):
                c = 1.0 if a == b else float(np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b)))
                if c >= least:
                    links.append((y, x, c))
    return own, links


def brute_classes(rows, least):
    own, links = brute_links(rows, least)
    root = brute.groups([(x, y) for x, y, _ in links])
    name = {}
    for k, (i, _) in enumerate(own):
        name[root.get(k, k)] = min(i, name.get(root.get(k, k), i))
    return sorted((i, name[root.get(k, k)], sum(k in x[:2] for x in links)) for k, (i, _) in enumerate(own))


def brute_pairs(rows, least):
    own, links = brute_links(rows, least)
    out = {}
    for x, y, c in links:
        i, j = sorted((own[x][0], own[y][0]))
        if i != j:
            out[i, j] = max(c, out.get((i, j), 0.0))
    return out


def vectors(seed=4, dim=20):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((25, dim))
    rows = [(i, base[i]) for i in range(25)]
    rows += [(100 + i, base[i % 9] + rng.standard_normal(dim) * rng.choice([0.02, 0.1, 0.25, 0.4])) for i in range(120)]
    rows += [(300 + i, base[0]) for i in range(6)] + [(5, base[5]), (5, base[6]), (7, base[0]), (500, 2 * base[1])]
    return [(i, [float(x) for x in e]) for i, e in rows]


ODD_VECTORS = [(400, None), (401, []), (402, [0.0] * 20), (403, [float("nan")] * 20), (404, [1.0, None]), (None, [1.0] * 20), (407, [float("inf")] * 20)]


@pytest.mark.parametrize("tile, block", [(7, 5), (4000, 16), (4000, 20), (40, 3)])
def test_embedding_classes(spark, tile, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "ROW", 5)
    rows = [*vectors(), (405, [1.0, 2.0]), (406, [2.0, 4.0])]
    table = spark.createDataFrame([(i, e, 0, 1) for i, e in rows + ODD_VECTORS], "vec_id long, embedding array<double>, node int, block int")
    got = sorted(tuple(r) for r in embedding_dedup.near_classes(table, 0.9, block_dims=block, tile=tile).collect())
    want = brute_classes(rows, 0.9)
    assert got == want and sum(x[2] for x in want) > 400 and any(x[0] != x[1] for x in want)
    assert embedding_dedup.near_classes(table.limit(0)).count() == 0


def test_embedding_pairs(spark):
    """Every pair of ids, copies beside copies and ids that stand for several vectors among them."""
    rows = vectors(8)
    table = spark.createDataFrame([*rows, *ODD_VECTORS], "vec_id long, embedding array<float>")
    rows = [(i, np.array(e, np.float32).astype(float).tolist()) for i, e in rows]
    want = brute_pairs(rows, 0.9)
    got = {(a, b): c for a, b, c in embedding_dedup.near_pairs(table, 0.9).collect()}
    assert set(got) == set(want) and all(abs(want[k] - c) < 2e-6 for k, c in got.items())
    assert embedding_dedup.near_pairs(table.limit(0)).count() == 0


def test_embedding_blocks_lose_no_pair():
    """Pairs at the very threshold, spread over the blocks in any way, are candidates of one block at least."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    dim, least = 64, 0.95
    spans = embedding_dedup.blocks_of(dim)
    assert [b - a for a, b in spans] == [16] * 4 and embedding_dedup.blocks_of(3) == [(0, 3)]
    a = rng.standard_normal((400, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((400, dim)) * np.repeat(rng.choice([0.0, 1.0], (400, 4), p=[0.4, 0.6]) + 1e-9, 16, axis=1)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    angle = np.arccos(least) * rng.uniform(0.9, 1.0, (400, 1))
    b = np.cos(angle) * a + np.sin(angle) * side
    both, groups, met = np.vstack((a, b)), {}, set()
    for batch in embedding_dedup._pack(both, np.arange(800), spans, 2 * (1 - least)):
        for r in batch.to_pylist():
            groups.setdefault((r["block"], r["cell"]), []).append({**r, "tile": 0, "ti": 0, "tj": 0})
    for rows in groups.values():
        found = embedding_dedup._join(pa.Table.from_pylist(rows), [16] * 4, 2 * (1 - least))
        met |= set(zip(found.column("a").to_pylist(), found.column("b").to_pylist()))
    assert all((i, i + 400) in met for i in range(400))


@pytest.mark.parametrize("task", [2_000_000, 5])
def test_components(spark, task, monkeypatch):
    """Chains, stars and cliques, by one task and by rounds over several."""
    from quillmill.llm import graph

    monkeypatch.setattr(graph, "TASK_EDGES", task)
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 230)] + [(i, j) for i in range(300, 312) for j in range(300, i)] + [(5, 5)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)]
    rng.shuffle(edges)
    table = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in graph.components(table)[0].collect()}
    want = {k: v for k, v in brute.groups([e for e in edges if e[0] != e[1]]).items() if k != v}
    assert got == want
    assert graph.components(table.limit(0))[0].count() == 0


# --- 8: mixing ---


def test_mixing(spark):
    import hashlib

    docs, rows = awkward_docs(spark, passages())
    weights = {"s0": 3.0, "s9": 0.5}
    full = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    key = lambda d: hashlib.md5(f"42:{'' if d is None else d}".encode()).hexdigest()
    want = brute.fair_queue(full, weights, 0.6, key)
    got = sorted(mixing.mix(docs, weights).collect(), key=lambda r: (r["finish"], r["source"] or "", r["cum_tokens"]))
    assert sorted(((r["doc_id"], r["source"], r["n_tokens"], r["cum_tokens"]) for r in got), key=str) == sorted(want, key=str)
    kept = mixing.keep_mixed(docs, weights=weights)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["source"])) for r in kept.collect()) == sorted((str(d), str(s)) for d, s, _, _ in want)
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": 0.0})


def test_mixing_keeps_the_same_with_many_sources(spark, monkeypatch):
    """Ids that several sources have, and null ids, are kept by source whatever the number of sources."""
    rows = [(i % 40 if i % 7 else None, " ".join(["w"] * (1 + i % 5)), None if s == 0 else f"s{s}") for s in range(6) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keep = lambda: mixing.keep_mixed(docs, weights={"s1": 8.0}, budget_share=0.4)
    few = sorted(map(str, keep().collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    many = keep()
    assert sorted(map(str, many.collect())) == few and 0 < len(few) < len(rows)
    assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()


# --- 9: near duplicates ---


def test_near_duplicates_recall(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute.near_groups(rows, near_dedup.SHINGLE, near_dedup.THRESHOLD)
    got = {r["doc_id"]: r["keep_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) > 0
    assert all(want[a] == want[b] for a, b in got.items())  # every group lies in a true one
    assert sum(got.get(d) == k for d, k in want.items()) >= 0.9 * len(want)


@pytest.mark.parametrize("most", [0, 1000])
def test_near_duplicates_awkward(spark, most, monkeypatch):
    from quillmill.llm import bloom

    monkeypatch.setattr(bloom, "BROADCAST_IDS", most)
    rng = random.Random(9)
    base = [f"w{rng.randrange(10_000)}" for _ in range(200)]
    texts = [(10, " ".join(base)), (11, " ".join(base[:100] + ["changed"] + base[101:])), (12, " ".join(base).upper()), (13, " ".join(f"z{i}" for i in range(200)))]
    texts += [(i, f"copy of one text number one {' '.join(base[:20])}") for i in range(200, 260)]
    docs, rows = awkward_docs(spark, texts)
    got = {r["doc_id"]: (r["keep_id"], r["exact"]) for r in near_dedup.near_duplicates(docs).collect()}
    want = brute.near_groups(rows, near_dedup.SHINGLE, near_dedup.THRESHOLD)
    assert {d: k for d, (k, _) in got.items()} == want
    assert got[12] == (10, True) and got[11] == (10, False) and got[906] == (905, True) and 13 not in got and None not in got
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, _ in rows if i is not None and want.get(i, i) == i) and None in ids
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_bucket_members_unlike_the_first(spark):
    """Members that only resemble each other, and not their bucket's smallest one, are found."""
    rng = random.Random(2)
    a = [f"a{rng.randrange(9999)}" for _ in range(60)]
    b = [f"b{rng.randrange(9999)}" for _ in range(60)]
    # 1 shares some with both others, which are near each other.
    texts = [(1, " ".join(a[:40] + b[:20])), (2, " ".join(b + a[:25])), (3, " ".join(b + a[:24]))]
    got = {r["doc_id"]: r["keep_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute.near_groups(texts, 3, 0.6) == {2: 2, 3: 2}


def test_hot_bucket_of_unlike_members(spark, monkeypatch):
    """A hundred documents share boilerplate, and so buckets; chains of near ones among them are found as brute force finds them."""
    rng = random.Random(12)
    boiler = [f"licence{i}" for i in range(40)]
    texts, last = [], []
    for i in range(100):
        own = [f"q{rng.randrange(99_999)}" for _ in range(rng.randrange(20, 45))]
        body = last[:-6] + own[:6] if last and i % 3 else own
        texts.append((i, " ".join(boiler + body)))
        last = body
    want = brute.near_groups(texts, 3, near_dedup.THRESHOLD)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = near_dedup.near_duplicates(docs).collect()
    got = {r["doc_id"]: r["keep_id"] for r in rows}
    assert set(got) <= set(want) and sum(got.get(d) == k for d, k in want.items()) >= 0.9 * len(want) > 0
    assert all(r["n_links"] >= 1 for r in rows)
    few = sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(docs).collect())
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(docs).collect()) == few


@pytest.mark.parametrize("tasks", [1, 6])
def test_buckets_of_tasks_and_of_all(spark, tasks, monkeypatch):
    """Whatever documents a task reads, candidates connect each bucket, and each bucket's firsts alone are shuffled."""
    rng = np.random.default_rng(2)
    halves = rng.integers(0, 3, (200, 6))
    rows = [(int(i), [int(v) for v in halves[i]]) for i in rng.permutation(200)]
    docs = spark.createDataFrame(rows, "doc_id long, keys array<long>").repartition(tasks, "doc_id")
    local = docs.mapInArrow(lambda it: near_dedup._own_buckets(it, True), "key long, rep long, doc_id long").collect()
    firsts = docs.mapInArrow(lambda it: near_dedup._own_buckets(it, False), "key long, doc_id long").collect()
    keys = near_dedup.tensor(halves.astype(np.uint64)).view(np.int64)
    assert len(local) + len(firsts) == keys.size and keys.shape == (200, 9)
    buckets = {}
    for i in range(200):
        for k in keys[i].tolist():
            buckets.setdefault(k, set()).add(i)
    assert len(buckets) == 9 * 9  # each table has the pairs of 3 values
    for k, held in buckets.items():
        own = [r for r in local if r["key"] == k]
        top = {r["doc_id"] for r in firsts if r["key"] == k}
        assert top | {r["doc_id"] for r in own} == held and {r["rep"] for r in own} <= top and len(top) <= tasks
        assert all(r["rep"] < r["doc_id"] for r in own)


def test_bloom_filter_has_all_its_ids(spark):
    from quillmill.llm import bloom

    rng = np.random.default_rng(5)
    ids = rng.integers(-(1 << 62), 1 << 62, 5000)
    words = bloom.build(spark.createDataFrame([(int(i),) for i in ids], "id long").repartition(3), len(ids))
    assert bloom.might_hold(words, ids).all()
    assert bloom.might_hold(words, rng.integers(-(1 << 62), 1 << 62, 5000)).mean() < 0.1
    assert not bloom.might_hold(bloom.build(spark.createDataFrame([], "id long"), 0), ids).any()

import hashlib
import random

import corpus_pipeline
from quillmill.llm import decontaminate, langid, near_dedup, shared, sharding

from . import brute

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {r["doc_id"] for r in langid.identify(docs, langid.train(docs)).collect() if not r["ambiguous"]}
    assert len(kept) >= 0.95 * len(rows)
    near = brute.near_groups([(i, rows[i]["text"]) for i in sorted(kept)], near_dedup.SHINGLE, near_dedup.THRESHOLD)
    kept = {i for i in kept if near.get(i, i) == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _, _ in brute.contained([(i, rows[i]["text"]) for i in kept], items, decontaminate.SHINGLE, decontaminate.THRESHOLD)}
    assert leaks
    kept -= leaks
    served = brute.fair_queue([(i, rows[i]["text"], rows[i]["source"]) for i in kept], corpus_pipeline.WEIGHTS, 0.6, lambda d: hashlib.md5(f"42:{d}".encode()).hexdigest())
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == {d for d, _, _, _ in served} and len(got) == len(served)
    group = lambda r: f"1{r['source']}/{hashlib.md5(str(r['doc_id']).encode()).hexdigest()[: sharding.HEX_DIGITS]}"
    sizes, shard = {}, {}
    for r in got:
        sizes[group(r)] = sizes.get(group(r), 0) + len(rows[r["doc_id"]]["text"])
        shard.setdefault(group(r), set()).add(r["shard_id"])
    order = sorted(sizes)
    capacity, starts = sharding.minimax_cuts([sizes[g] for g in order], sharding.N_SHARDS)
    assert capacity == brute.least_capacity([sizes[g] for g in order], sharding.N_SHARDS)
    at = 0
    for i, g in enumerate(order):
        at += i in starts
        assert shard[g] == {at - 1}


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def table(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "short secret item"), (2, None), (3, "ΟΔΟΣ ΕΛΛΑΔΟΣ")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_awkward_tables(spark, tmp_path):
    """Nulls, repeats, long and empty texts and clashing names; no document that holds an item is left, and nothing clean is lost before mixing."""
    rng = random.Random(7)
    words = {"de": "der die das und nicht wird auch mit sich ein haus", "en": "the and that with this have from they which house"}
    rows = brute.awkward([(i, " ".join(rng.choice(words["en" if i % 2 else "de"].split()) + f" {rng.randrange(999)}" for _ in range(40))) for i in range(80)])
    rows += [(i, f"{rows[i][1]} {t} und das haus", *rows[i][2:]) for i, t in ((70, "short SECRET item"), (71, "οδος ελλαδος"), (72, "Οδος. ΕΛΛΑΔΟΣ!"))]
    out = table(spark, rows, brute.AWKWARD_SCHEMA, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    texts = [r["text"].lower() for r in kept.collect() if r["text"]]
    assert len(texts) >= 70 and not any("short secret item" in t or "οδος ελλαδος" in t for t in texts)
    got = out.collect()
    assert set(out.columns) == set(docs.columns) and 0 < len(got) < len(rows)


def test_unlabelled_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    rows = [(i, f"text number {i} of {i * 7} with {i * 13} words", None, f"s{i % 3}", 9) for i in range(60)]
    (tmp_path / "a").mkdir()
    out = table(spark, rows, schema, tmp_path / "a")
    assert 20 <= out.count() < 60 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard_id"]
    (tmp_path / "b").mkdir()
    assert table(spark, [], schema, tmp_path / "b").count() == 0


def test_only_the_last_table_stays(spark):
    before = set(shared.live())
    out = corpus_pipeline.run(spark, SF)
    left = [p for p in shared.live() if p not in before]
    assert len(left) == 1 and "pipeline-3" in left[0] and out.count() > 0
    shared.remove(spark, *left)

import pytest
from pyspark.sql import functions as F

from quillmill.functions import sql
from quillmill.operators import bpe, encode
from quillmill.functions.text import basic_tokenize
from quillmill.sources import tables
from quillmill.sources import vocab as files
from quillmill.streaming import encode_stream as es
from quillmill.tokenizer import Tokenizer, TokenizerOptions


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = {"a.txt": "the word is that. " * 400, "b.txt": "﻿nation " * 3, "c.txt": "", "d.txt": "x" * 1000}
    for name, t in texts.items():
        (tmp_path / "in" / name).write_text(t, encoding="utf-8")
    t = Tokenizer(TokenizerOptions(model_max_length=-1))
    stream = es.encode_stream(es.read_text_stream(spark, f"file://{tmp_path}/in", 2), t, 500)
    query = es.write_encoded(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    query.awaitTermination(120)
    got = {r["path"].rsplit("/", 1)[1]: r["ids"] for r in es.reassemble(spark.read.parquet(f"{tmp_path}/out")).collect()}
    rows = spark.createDataFrame([(k, v.removeprefix("﻿")) for k, v in texts.items() if v], "k string, t string")
    assert got == {r[0]: r[1] for r in rows.select("k", t.encode_raw(F.col("t"))).collect()}


def test_sql_functions(spark):
    options = TokenizerOptions(model_max_length=12)
    sql.register(spark, options, TokenizerOptions(kind="bpe"))
    t, b = Tokenizer(options), Tokenizer(TokenizerOptions(kind="bpe"))
    rows = spark.createDataFrame([(0, "the nation is that"), (1, None)], "i int, text string")
    words = rows.select("i", "text", basic_tokenize(F.col("text")).alias("w"), bpe.pretokenize(F.col("text")).alias("p"))
    words.createOrReplaceTempView("sql_words")
    got = spark.sql("SELECT i, bert_encode_words(w) AS ids, bert_tokenize_words(w) AS pieces, bpe_encode_pieces(p) AS b FROM sql_words ORDER BY i").collect()
    want = rows.select("i", t.encode(F.col("text")).alias("ids"), encode.tokenize(F.col("text"), t.vocab).alias("pieces"), b.encode(F.col("text")).alias("b")).orderBy("i").collect()
    assert got == want
    got = spark.sql("SELECT i, bert_encode(text) AS ids, bert_tokenize(text) AS pieces, bpe_encode(text) AS b FROM sql_words ORDER BY i").collect()
    assert got == want
    rows.selectExpr("i AS doc_id", "concat(text, '. É') AS text").createOrReplaceTempView("sql_docs")
    lateral = spark.sql("SELECT doc_id, pos, token FROM tokenize_lateral(TABLE(sql_docs)) ORDER BY doc_id, pos").collect()
    assert [tuple(r) for r in lateral] == [(0, i, w) for i, w in enumerate(["the", "nation", "is", "that", ".", "e"])]
    with pytest.raises(ValueError):
        sql.register(spark, options, TokenizerOptions(kind="bpe", bpe_pretokenize="canonical"))
    rows.createOrReplaceTempView("sql_rows")
    assert sql.bert_table(spark, "SELECT * FROM sql_rows WHERE i = 0", t).first()["n_ids"] == 12


def test_cancelled_stream_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(6):
        (tmp_path / "in" / f"{i}.txt").write_text(f"the word {i} " * 50, encoding="utf-8")
    t = Tokenizer(TokenizerOptions(model_max_length=-1))
    start = lambda once: es.write_encoded(es.encode_stream(es.read_text_stream(spark, f"file://{tmp_path}/in", 1), t, 100), f"file://{tmp_path}/out", f"file://{tmp_path}/cp", once)
    query = start(False)
    while not (query.lastProgress or {}).get("numInputRows"):
        assert query.isActive
        query.awaitTermination(1)
    es.cancel(query)
    assert not query.isActive
    start(True).awaitTermination(120)
    chunks = spark.read.parquet(f"{tmp_path}/out")
    assert chunks.groupBy("path", "chunk_index").count().where("count > 1").isEmpty()  # exactly once
    whole = spark.read.text(f"{tmp_path}/in", wholetext=True).select(t.encode_raw(F.col("value")).alias("ids"))
    assert sorted(r["ids"] for r in es.reassemble(chunks).collect()) == sorted(r["ids"] for r in whole.collect())


def test_files_that_are_no_utf8(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfthe \xff\xc3 word \xed\xa0\x80")
    text = files.read_texts(spark, f"file://{tmp_path}/a.txt").first()["text"]
    assert text.startswith("the ") and "�" in text and text.encode("utf-8").decode("utf-8") == text
    words = spark.createDataFrame([(text,)], "t string").select(basic_tokenize(F.col("t"))).first()[0]
    assert words == ["the", "word"]
    query = es.write_encoded(es.read_text_stream(spark, f"file://{tmp_path}/*.txt"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").first()["text"] == text


def test_spread(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(1000).repartition(20).write.parquet(f"{tmp_path}/many")
    cores = spark.sparkContext.defaultParallelism
    one = tables.read_table(spark, f"{tmp_path}/one")
    assert one.rdd.getNumPartitions() == cores and one.count() == 1000
    many = spark.read.parquet(f"{tmp_path}/many")
    if many.rdd.getNumPartitions() >= cores:
        assert tables.spread(many) is many

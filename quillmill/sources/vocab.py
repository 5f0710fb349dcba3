"""Vocabulary, merge and text files as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chars import valid_utf8

_BREAK = "\\r\\n|\\r|\\n"
_TRAILING = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def whole_text(value: Column) -> Column:
    """A file's text: bytes that are no UTF-8 become U+FFFD, a byte order mark is left out."""
    return F.regexp_replace(valid_utf8(value), "^\\x{FEFF}", "")


def _whole(spark: SparkSession, path: str) -> Column:
    return whole_text(F.col("value"))


def _numbered(lines: DataFrame, order: str) -> DataFrame:
    """n: a line's number among the kept ones (a vocabulary is one file, so one small partition)."""
    kept = lines.agg(F.array_sort(F.collect_list(F.struct(order, "line"))).alias("__l"))
    return kept.select(F.posexplode(F.transform("__l", lambda x: x["line"])).alias("n", "line"))


def wordpiece_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(id, token): a token a line, numbered without the lines that are blank."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(_whole(spark, path), _BREAK)).alias("i", "raw"))
    lines = lines.select("i", F.regexp_replace("raw", _TRAILING + "$", "").alias("line")).where("line != ''")
    return _numbered(lines, "i").select(F.col("n").alias("id"), F.col("line").alias("token"))


def bpe_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(id, token) of a JSON object token -> id; ids must be 0 to n - 1."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(_whole(spark, path), "map<string,int>")).alias("token", "id"))
    n = pairs.agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count_distinct("id").alias("d"))
    good = n.select(F.when((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("d") == F.col("n")), True).otherwise(F.raise_error(F.lit("vocabulary ids have gaps"))).alias("ok"))
    return pairs.crossJoin(good).where("ok").select("id", "token")


def bpe_merges(spark: SparkSession, path: str) -> DataFrame:
    """(rank, a, b): a pair a line; empty lines and those that begin with # count for nothing."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(_whole(spark, path), _BREAK)).alias("i", "raw"))
    lines = lines.select("i", F.regexp_replace("raw", f"^{_TRAILING}|{_TRAILING}$", "").alias("line"))
    lines = lines.where("line != '' AND NOT startswith(line, '#')").where(F.size(F.filter(F.split("line", " +"), lambda x: x != "")) >= 2)
    parts = F.split("line", " +")
    return _numbered(lines, "i").select(F.col("n").alias("rank"), parts[0].alias("a"), parts[1].alias("b"))


def lookup_ids(tokens: DataFrame, vocab: DataFrame, token_col: str = "token", default: int = 0) -> DataFrame:
    """tokens with ``id``, ``default`` where the vocabulary lacks the token; of a repeated token the last id counts."""
    last = vocab.groupBy(F.col("token").alias("__t")).agg(F.max("id").alias("__id"))
    return tokens.join(last, F.col(token_col) == F.col("__t"), "left").select(*tokens.columns, F.coalesce("__id", F.lit(default)).alias("id"))


def lookup_tokens(ids: DataFrame, vocab: DataFrame, id_col: str = "id") -> DataFrame:
    """ids with ``token``; an id that the vocabulary lacks is an error."""
    known = vocab.select(F.col("id").alias("__id"), F.col("token").alias("__t"))
    token = F.coalesce("__t", F.raise_error(F.concat(F.lit("unknown token id "), F.col(id_col).cast("string"))))
    return ids.join(known, F.col(id_col) == F.col("__id"), "left").select(*ids.columns, token.alias("token"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one text of valid UTF-8, without a byte order mark."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), _whole(spark, path).alias("text"))


def parse_vocab(text: str) -> list[str]:
    """The tokens of a vocabulary file in order (the same rule as wordpiece_vocab, for the driver's own use)."""
    lines = (line.rstrip() for line in re.split("\r\n|\r|\n", text.removeprefix("﻿")))
    return [line for line in lines if line]


def parse_merges(text: str) -> list[tuple[str, str]]:
    """The pairs of a merges file in rank order."""
    lines = (line.strip() for line in re.split("\r\n|\r|\n", text.removeprefix("﻿")))
    parts = ([p for p in line.split(" ") if p] for line in lines if line and not line.startswith("#"))
    return [(p[0], p[1]) for p in parts if len(p) >= 2]

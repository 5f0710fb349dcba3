"""The corpus pipeline: documents -> language ID -> near-dedup -> decontamination -> mixing -> sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what
a stage returns as Parquet in the shared folder and reads it for the next one.

Null ids, null and empty texts, repeated rows, empty tables and further columns of
any names pass through all stages; what each does with them is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import decontaminate, langid, mixing, near_dedup, sharding
from quillmill.llm.shared import live, materialize, remove
from quillmill.sources.tables import read_table

#: Target weights of sources: the hot one has four times the share of any other.
WEIGHTS = {"src0": 4.0}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is unknown or ambiguous, among them those without a letter; all stay where no row has a language to learn from."""
    return langid.keep_identified(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each near-duplicate group, that of the smallest id; documents without an id or without a word are in no group and stay, rows that repeat the id that stays do, too."""
    return near_dedup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold half of a benchmark item or more; without a benchmark item, or a word of their own, they stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Serves documents by weighted fair queueing up to the token budget; null sources are one source, rows of a source with the same id are served together."""
    return mixing.keep_mixed(docs, weights=WEIGHTS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard_id (and replaces a column of that name); null texts have size 0, null ids and sources lie first."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_to_weights),
    ("sharding", shards),
]

#: Language ID and MinHash cannot be expressed in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of sf_dir, one after the other.

    A stage's tables are removed when the next one's input is written; the last of
    these stays, as the result reads it (shared.live() names it, shared.remove() ends it).
    """
    docs, last = read_table(spark, f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(STAGES):
        before = set(live())
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, path = materialize(docs, f"pipeline-{i}")
            remove(spark, *last, *(p for p in live() if p not in before and p != path))
            last = [path]
    return docs

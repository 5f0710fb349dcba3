"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow: its documents, in shuffled order, finish at virtual time
(tokens of the source so far) / (target weight).  Serving documents in the order
of finish time keeps every prefix of the stream as near to the target weights as
whole documents allow, until a source runs dry; the stream is cut at the token
budget.

Both running sums (by source, and over the whole stream) are prefix sums over a
range partitioning: a partition's own running sum, plus the totals of those before
it.  So a hot source is spread over many tasks, and only narrow rows (no text) are
shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, materialize, remove

SEED = 42
BUDGET_SHARE = 0.6
#: Sources whose cut points are broadcast at most; with more, documents are merge-joined with them by source.
MAX_BROADCAST_SOURCES = 10_000
TOKEN = "[^ \\t\\n\\r\\f]+"


def token_count(text: Column) -> Column:
    """Tokens separated by white space (space, TAB, LF, CR, FF) in the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)).cast("long"), F.lit(0).cast("long"))


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """A pseudo-random order of documents that depends on their ids and the seed alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _weight(source: Column, weights: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for name, w in weights.items():
        out = F.when(source == name, F.lit(float(w))).otherwise(out)
    return out


def _running(batches, size: int, flow: int | None):
    """Appends the running sum of column ``size`` in this partition, anew for each value of column ``flow``."""
    last, total = None, 0
    for batch in batches:
        v = batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
        c = np.cumsum(v)
        if flow is None:
            c, total = c + total, total + (int(c[-1]) if len(c) else 0)
        elif len(v):
            codes = batch.column(flow).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            base = np.where(starts > 0, c[starts - 1], 0)
            first = batch.column(flow)[0].as_py()
            base[0] -= total if last is not None and last == (first,) else 0
            c = c - np.repeat(base, np.diff(np.append(starts, len(v))))
            last, total = (batch.column(flow)[len(v) - 1].as_py(),), int(c[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c)], [*batch.schema.names, "__run"])


def prefix_sums(df: DataFrame, order: list[str], size: str, out: str, flow: str | None = None) -> tuple[DataFrame, str]:
    """df with the exact running sum of ``size`` in the order of ``order`` (within each value of ``flow``, which comes first in it)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__pid", F.spark_partition_id())
    at, fl = ranged.columns.index(size), ranged.columns.index(flow) if flow else None
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema) + ", __run long"
    local, path = materialize(ranged.mapInArrow(lambda it: _running(it, at, fl), schema), "mix-run")
    flows = [flow] if flow else []
    totals = local.groupBy("__pid", *flows).agg(F.sum(size).alias("__total"))
    before = Window.partitionBy(*flows).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("__pid").alias("__p"), *[F.col(f).alias("__flow") for f in flows], F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    on = (local["__pid"] == totals["__p"]) & (local[flow].eqNullSafe(totals["__flow"]) if flow else F.lit(True))
    joined = local.join(totals, on).select(*df.columns, (F.col("__run") + F.col("__before")).alias(out))
    return joined, path


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    default_weight: float = 1.0,
    budget_share: float = BUDGET_SHARE,
    budget_tokens: int | None = None,
    seed: int = SEED,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """The documents served within the budget: (doc_id, source, n_tokens, finish, cum_tokens).

    ``finish`` is the virtual finish time, ``cum_tokens`` the running total of the
    stream, at most the budget: ``budget_tokens``, or the floor of ``budget_share``
    of all tokens.  Weights must be positive.

    Defined cases: a null source is a source of its own with the default weight;
    null and empty texts have no tokens and are served when their turn comes; equal
    finish times go by source (null first), shuffle key and id; repeated rows are
    served each, next to each other; rows with a null id share one place in the
    shuffle; an empty table or a budget of 0 gives only what costs nothing; other
    columns are not read.
    """
    weights = weights or {}
    if default_weight <= 0 or any(w <= 0 for w in weights.values()):
        raise ValueError("target weights must be positive")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), token_count(F.col(text_col)).alias("n_tokens"))
    rows, rows_path = materialize(rows.withColumn("__key", shuffle_key(F.col("doc_id"), seed)), "mix-rows")
    if budget_tokens is None:
        budget_tokens = int((rows.agg(F.sum("n_tokens")).first()[0] or 0) * budget_share)
    served, served_path = prefix_sums(rows, ["source", "__key", "doc_id"], "n_tokens", "__served", flow="source")
    timed, timed_path = materialize(served.select("doc_id", "source", "n_tokens", "__key", (F.col("__served").cast("double") / _weight(F.col("source"), weights, default_weight)).alias("finish")), "mix-timed")
    remove(spark, rows_path, served_path)
    # Of what finishes late nothing is served: only the first total, not the rows, is needed beyond the budget.
    stream, stream_path = prefix_sums(timed, ["finish", "source", "__key", "doc_id"], "n_tokens", "cum_tokens")
    out, _ = materialize(stream.where(F.col("cum_tokens") <= budget_tokens).select("doc_id", "source", "n_tokens", "finish", "cum_tokens"), "mix-served")
    remove(spark, timed_path, stream_path)
    return out


def keep_mixed(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", **params) -> DataFrame:
    """docs that mix() serves, with their columns.

    A source's served documents are the first ones of its shuffle, so its last
    shuffle key is all that a document is compared with.  Text is shuffled only
    where there are more than ``MAX_BROADCAST_SOURCES`` sources; the rule is the same.

    Defined cases: rows of a source that repeat an id share a place in its shuffle and
    are served together, so where mix() ends between them, the budget is passed by
    the tokens of such repeats; likewise rows of a source with null ids; null sources,
    null and empty texts as in mix(); an empty table stays empty; columns may have any
    names.
    """
    served = mix(docs, seed=seed, id_col=id_col, source_col=source_col, **params)
    source, cut = free_name(docs, "__source"), free_name(docs, "__cut")
    cuts = served.groupBy(F.col("source").alias(source)).agg(F.max(shuffle_key(F.col("doc_id"), seed)).alias(cut))
    cuts = F.broadcast(cuts) if cuts.count() <= MAX_BROADCAST_SOURCES else cuts.hint("merge")
    on = docs[source_col].cast("string").eqNullSafe(cuts[source]) & (shuffle_key(docs[id_col].cast("long"), seed) <= cuts[cut])
    return docs.join(cuts, on, "left_semi")

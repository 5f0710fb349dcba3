"""A Bloom filter over ids, of a size that is bounded whatever their number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

#: Bits of a filter at most (8 MB): with more ids than it holds well, it passes more that aren't in it.
MOST_BITS = 1 << 26
#: Ids that are broadcast one by one.
BROADCAST_IDS = 1_000_000
_SEEDS = (0x1B873593, 0x85EBCA6B)


def places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of each id."""
    u = ids.astype(np.int64).view(np.uint64)
    return [(tk.mix(u + np.uint64(s)) >> np.uint64(20)) & np.uint64(bits - 1) for s in _SEEDS]


def might_hold(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id may be in the filter: never False for one that is."""
    out = np.ones(len(ids), bool)
    for at in places(ids, 64 * len(words)):
        out &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    return out


def build(ids: DataFrame, n: int) -> np.ndarray:
    """The filter of a column of ``n`` ids: its words, put together by all tasks (a word is 64 bits)."""
    bits = min(MOST_BITS, 1 << max(12, int(12 * n).bit_length()))

    def own(batches):
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            for at in places(batch.column(0).to_numpy(), bits):
                np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some].view(np.int64))], ["at", "word"])

    found = ids.mapInArrow(own, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("at").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return out


def only(rows: DataFrame, ids: DataFrame, n: int, column: str) -> DataFrame:
    """The rows whose ``column`` is one of the ``n`` distinct ids of a table of one column, and perhaps a few others; they are not shuffled.

    Up to ``BROADCAST_IDS`` ids (some 20 MB) are broadcast themselves, beyond that a
    Bloom filter is.  Either goes before what is computed from other columns.
    """
    if n <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids.toDF(column)), column, "left_semi")
    return rows.where(might(rows.sparkSession.sparkContext.broadcast(build(ids, n)))(column))


def might(shared: Broadcast):
    """A function of an id column: whether it may be in a broadcast filter.  In where(), it goes before what is computed from other columns."""

    @F.arrow_udf("boolean")
    def may_be_in(ids: pa.Array) -> pa.Array:
        return pa.array(might_hold(shared.value, ids.to_numpy(zero_copy_only=False)))

    return may_be_in

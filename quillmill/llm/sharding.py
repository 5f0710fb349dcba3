"""Minimax contiguous sharding of ordered atomic groups.

The smallest capacity with which a greedy walk over the ordered group sizes fills
at most ``n_shards`` shards is the smallest possible size of the largest shard;
it is found by search between max(largest group, ceil(total / n_shards)) and that
plus the largest group (always feasible), each pass checking ``PROBES``
capacities greedily, and the order is then cut there.

The sizes are range-partitioned and packed into blocks of a table in the shared
folder.  A pass is one task that streams the blocks, 8 bytes a group: neither it nor
the driver ever holds them all, and nothing but the cuts comes back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, remove

N_SHARDS = 64
#: A source is split into 16 ** HEX_DIGITS atomic groups.
HEX_DIGITS = 3
PROBES = 32
_BLOCK = 1 << 16


def document_group(source: Column, doc_id: Column, digits: int = HEX_DIGITS) -> Column:
    """Ordered group key: a source's documents lie together, split by a hash of the id (a null id hashes as the empty string)."""
    bucket = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, digits)
    return F.concat(F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source)), F.lit("/"), bucket)


def _pack(batches):
    """group, size, pid (sorted) -> blocks of their sizes."""
    seq = 0
    for batch in batches:
        size = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        groups = batch.column(0)
        for i in range(0, len(size), _BLOCK):
            part = size[i : i + _BLOCK]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).slice(i, 1), pa.array([seq], pa.int64()), pa.array([part.tobytes()], pa.binary()), pa.array([groups.slice(i, len(part)).to_pylist()], pa.list_(pa.string())), pa.array([int(part.sum())], pa.int64()), pa.array([int(part.max())], pa.int64())],
                ["pid", "seq", "sizes", "groups", "total", "largest"],
            )
            seq += 1


class Greedy:
    """Greedy walks with several capacities over one stream of sizes; all sizes must fit each capacity."""

    def __init__(self, capacities: list[int]):
        self.capacities = capacities
        self.fill = [0] * len(capacities)
        self.shards = [0] * len(capacities)
        self.cuts: list[list[int]] = [[] for _ in capacities]  #: numbers of the groups that begin a shard
        self.seen = 0

    def feed(self, sizes: np.ndarray) -> None:
        sums = np.concatenate(([0], np.cumsum(sizes)))
        for c, cap in enumerate(self.capacities):
            at, room = 0, cap - self.fill[c] if self.shards[c] else -1
            while at < len(sizes):
                stop = int(np.searchsorted(sums, sums[at] + room, side="right")) - 1 if room >= 0 else at
                if stop >= len(sizes):
                    break
                self.cuts[c].append(self.seen + stop)
                self.shards[c] += 1
                at, room = stop, cap
            self.fill[c] = cap - room + int(sums[-1] - sums[at]) if self.shards[c] else 0
        self.seen += len(sizes)


def _search(walk, total: int, largest: int, n_shards: int) -> int:
    """Smallest feasible capacity; ``walk(capacities)`` tells how many shards each of them fills."""
    lo = max(largest, -(-total // n_shards))
    hi = lo + largest
    while True:
        probes = sorted({lo + (hi - lo) * i // PROBES for i in range(PROBES + 1)})
        shards = walk(probes)
        k = next(i for i, s in enumerate(shards) if s <= n_shards)
        if k == 0 or probes[k] - probes[k - 1] == 1:
            return probes[k]
        lo, hi = probes[k - 1] + 1, probes[k]


def minimax_cuts(sizes: list[int], n_shards: int) -> tuple[int, list[int]]:
    """For sizes in memory: (capacity, first group of each shard)."""
    if not sizes:
        return 0, []
    a = np.array(sizes, np.int64)

    def walk(probes):
        w = Greedy(probes)
        w.feed(a)
        return w

    capacity = _search(lambda p: walk(p).shards, int(a.sum()), int(a.max()), n_shards)
    return capacity, walk([capacity]).cuts[0]


def _walk(batches, capacities: list[int]):
    """sizes (in order) -> capacity, shards."""
    walk = Greedy(capacities)
    for batch in batches:
        for b in batch.column(0):
            walk.feed(np.frombuffer(b.as_buffer(), np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(capacities, pa.int64()), pa.array(walk.shards, pa.int64())], ["capacity", "shards"])


def _first_groups(batches, capacity: int):
    """sizes, groups (in order) -> the groups that begin a shard."""
    walk = Greedy([capacity])
    for batch in batches:
        for b, names in zip(batch.column(0), batch.column(1)):
            at = walk.seen
            walk.cuts = [[]]
            walk.feed(np.frombuffer(b.as_buffer(), np.int64))
            yield pa.RecordBatch.from_arrays([names.values.take(pa.array(np.array(walk.cuts[0], np.int64) - at))], ["group"])


def shard_boundaries(spark: SparkSession, groups: DataFrame, n_shards: int) -> tuple[int, list[str]]:
    """Of ``groups`` (group, size): the least capacity and the group key that begins each shard."""
    ranged = groups.repartitionByRange("group").sortWithinPartitions("group").withColumn("pid", F.spark_partition_id())
    packed = ranged.select("group", F.col("size").cast("long"), "pid").mapInArrow(_pack, "pid int, seq long, sizes binary, groups array<string>, total long, largest long")
    blocks, path = materialize(packed, "shard-blocks")
    total, largest, n = blocks.agg(F.sum("total"), F.max("largest"), F.count("*")).first()
    if not n:
        remove(spark, path)
        return 0, []
    ordered = blocks.coalesce(1).sortWithinPartitions("pid", "seq")

    def walk(probes: list[int]) -> list[int]:
        rows = ordered.select("sizes").mapInArrow(lambda it: _walk(it, probes), "capacity long, shards long").collect()
        return [r["shards"] for r in sorted(rows)]

    capacity = _search(walk, total, largest, n_shards)
    keys = ordered.select("sizes", "groups").mapInArrow(lambda it: _first_groups(it, capacity), "group string").collect()
    remove(spark, path)
    return capacity, sorted(r[0] for r in keys)


def assign_shards(docs: DataFrame, group: Column, size: Column, n_shards: int = N_SHARDS) -> DataFrame:
    """docs with ``shard_id``: contiguous shards in the order of ``group``, no group split, the largest shard as small as can be.

    ``group`` is a string that sorts as the groups shall lie (a null sorts first, as
    the empty string), ``size`` a whole number not below 0 (null: 0).

    Defined cases: null and empty texts have size 0 and stay with their group; more
    shards than groups leaves shards out; repeated rows are of one group; groups of
    size 0 join the shard before them; one group of any size is never split; an
    empty table stays empty; a column named shard_id is replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    key = F.coalesce(group, F.lit(""))
    sizes = docs.select(key.alias("group"), F.coalesce(size.cast("long"), F.lit(0)).alias("__s")).groupBy("group").agg(F.sum("__s").alias("size"))
    _, first = shard_boundaries(docs.sparkSession, sizes, n_shards)
    edges = np.array(first, dtype=object)

    @F.pandas_udf("int")
    def shard(g: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(edges, g.to_numpy(dtype=object), side="right") - 1, 0).astype(np.int32))

    return docs.withColumn("shard_id", shard(key))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, digits: int = HEX_DIGITS, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """assign_shards() over documents: groups by source and hash of the id, sizes in characters of the whole text."""
    return assign_shards(docs, document_group(F.col(source_col).cast("string"), F.col(id_col), digits), F.length(text_col), n_shards)

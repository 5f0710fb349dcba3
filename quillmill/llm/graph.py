"""Connected components of edge tables of any size.

Edges are first contracted inside each task to a spanning forest (a star for each
component that the task sees), which removes nearly all edges of dense groups before
anything is shuffled.  While more edges are left than one task may hold, alternating
large-star and small-star rounds go on, each written to the shared folder; what is
left is contracted by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, remove

#: Edges that one task contracts at once: 16 bytes each, and some 100 while it does.
TASK_EDGES = 2_000_000


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, smallest node) of the components of edges (u, v), of all nodes but the smallest."""
    nodes, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        # Hook the larger root of each edge to the smaller, then shorten all paths.
        x, y = label[a], label[b]
        live = x != y
        a, b, x, y = a[live], b[live], x[live], y[live]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            short = label[label]
            if (short == label).all():
                break
            label = short
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def _forest(batches):
    """u, v -> the stars of what this task has; at most about two times TASK_EDGES edges are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = stars = 0

    def out(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= TASK_EDGES + stars:
            held = [contract(*(np.concatenate(x) for x in zip(*held)))]
            n = stars = len(held[0][0])
            if stars >= TASK_EDGES:
                yield out(*held[0])
                held, n, stars = [], 0, 0
    if held:
        yield out(*contract(*(np.concatenate(x) for x in zip(*held))))


def _contracted(edges: DataFrame, name: str) -> tuple[DataFrame, str]:
    return materialize(edges.mapInArrow(_forest, "u long, v long"), name)


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """Connected components of edges (a, b): (node, root) of all nodes but each component's smallest, its root; and the path of the table."""
    spark = edges.sparkSession
    now, path = _contracted(edges.where("a != b").select(F.col("a").alias("u"), F.col("b").alias("v")), "graph-stars")
    mark = None
    while now.count() > TASK_EDGES:
        # Here v < u in every row.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("__m")).select("u", F.least("u", "__m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        after, new = _contracted(small, "graph-stars")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(spark, path)
        now, path = after, new
        if mark == tuple(seen):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")), path
        mark = tuple(seen)
    last, new = _contracted(now.coalesce(1), "graph-roots")
    remove(spark, path)
    return last.select(F.col("u").alias("node"), F.col("v").alias("root")), new

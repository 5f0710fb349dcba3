"""Near-duplicate embeddings by a subspace pigeonhole join.

Vectors are normalised, turned by a fixed random rotation and cut into blocks of
about ``BLOCK_DIMS`` dimensions.  If the squared distance of two vectors is at most
d2, then in one block at least it is at most the block's share of d2, in proportion
to its dimensions: the union of a range join of each block under that budget holds
every pair, without exception.

A block's range join is a grid join on its leading ``GRID`` coordinates: cells are
twice as wide as the block's radius, so the partners of a vector are in its cell or
in a neighbouring one.  A vector is *home* in its cell and a *guest* in those of half
of the neighbours that its ball reaches (each pair of cells meets once).  What is
shuffled are packed rows, one for a cell and some thousand vectors that one task
read: of each vector its number and a byte a coordinate of the block.  A crowded cell
is split in tiles, and each pair of tiles is a group of its own, so no cell is too
large for a task.  A tile pair's distances are one matrix product, compared with the
budget and what rounding may add to it; in 16 dimensions hardly any false pair is
within that, and the union of the blocks' pairs is verified with the vectors
themselves.

Copies are one vector in all of this; the number of its links counts them.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import materialize, remove

MIN_COSINE = 0.95
BLOCK_DIMS = 16
GRID = 4
#: Vectors of a tile, about.
TILE = 4_000
#: Vectors that a task packs at once, and that a packed row has at most.
PACK, ROW = 1 << 16, 1 << 10
#: Resolution of the packed coordinates.
STEP = 1 / 127


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, block_dims: int = BLOCK_DIMS) -> list[tuple[int, int]]:
    """First and last-plus-one dimension of each block."""
    edges = np.linspace(0, dim, max(1, round(dim / block_dims)) + 1).astype(int).tolist()
    return list(zip(edges, edges[1:]))


def _offsets(g: int) -> list[tuple[int, ...]]:
    """Half of the neighbouring cells, and the cell itself."""
    return [o for o in itertools.product((-1, 0, 1), repeat=g) if o >= (0,) * g]


def _hash(cell: np.ndarray) -> np.ndarray:
    """One number for each cell; if two cells share it, they are searched together."""
    out = np.zeros(len(cell), np.uint64)
    for i in range(cell.shape[1]):
        out = (out + cell[:, i].astype(np.int64).view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _pack(v: np.ndarray, nodes: np.ndarray, spans: list[tuple[int, int]], radius2: float):
    """Rows block, cell, guest, n, nodes, x of turned unit vectors."""
    for b, (lo, hi) in enumerate(spans):
        radius = np.sqrt(radius2 * (hi - lo) / v.shape[1]) + 1e-5
        width, g = 2 * radius, min(GRID, hi - lo)
        x = v[:, lo : lo + g]
        cell = np.floor(x / width).astype(np.int32)
        low = x - cell * width
        who, where, away = [], [], []
        for o in _offsets(g):
            # A guest goes only where its ball reaches.
            way = np.where(np.array(o) > 0, width - low, np.where(np.array(o) < 0, low, 0.0))
            at = np.flatnonzero((way * way).sum(1) <= radius * radius)
            who.append(at)
            where.append(_hash(cell[at] + np.array(o, np.int32)))
            away.append(np.full(len(at), any(o)))
        who, where, away = np.concatenate(who), np.concatenate(where), np.concatenate(away)
        order = np.lexsort((away, where))
        who, where, away = who[order], where[order], away[order]
        new = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (away[1:] != away[:-1])))
        ends = np.append(new[1:], len(who))
        cuts = np.concatenate([np.arange(a, z, ROW) for a, z in zip(new, ends)])
        ends = np.append(cuts[1:], len(who))
        small = np.ascontiguousarray(np.rint(v[who, lo:hi] / STEP).astype(np.int8))
        names = np.ascontiguousarray(nodes[who])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(cuts), b, np.int32)), pa.array(where[cuts]), pa.array(away[cuts]), pa.array((ends - cuts).astype(np.int32)),
                pa.array([names[a:z].tobytes() for a, z in zip(cuts, ends)], pa.binary()), pa.array([small[a:z].tobytes() for a, z in zip(cuts, ends)], pa.binary()),
            ],
            ["block", "cell", "guest", "n", "nodes", "x"],
        )


def _cells(batches, dim: int, spans: list[tuple[int, int]], radius2: float):
    """node, e -> packed rows of all cells that the vectors are in."""
    turn, held, n = rotation(dim), [], 0

    def out():
        v = np.concatenate([x for _, x in held])
        return _pack((v / np.linalg.norm(v, axis=1, keepdims=True)) @ turn, np.concatenate([i for i, _ in held]), spans, radius2)

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dim)))
            n += batch.num_rows
        if n >= PACK:
            yield from out()
            held, n = [], 0
    if n:
        yield from out()


def _join(table: pa.Table, dims: list[int], radius2: float) -> pa.Table:
    """One pair of tiles: pairs of a home vector with a home or guest vector that may be within the block's budget."""
    d = dims[table.column("block")[0].as_py()]
    ti, tj = table.column("ti")[0].as_py(), table.column("tj")[0].as_py()
    sides: dict[str, list] = {"left": [], "home": [], "guest": []}
    for guest, tile, nodes, x in zip(*(table.column(c).to_pylist() for c in ("guest", "tile", "nodes", "x"))):
        one = np.frombuffer(nodes, np.int64), np.frombuffer(x, np.int8).reshape(-1, d)
        if not guest and tile == ti:
            sides["left"].append(one)
        if tile == tj:
            sides["guest" if guest else "home"].append(one)
    out = [np.zeros((0, 2), np.int64)]
    # Each rounded coordinate is off by half a step at most, so a difference by one.
    most = np.float32((np.sqrt(radius2 * d / sum(dims)) / STEP + np.sqrt(d) + 1e-3) ** 2)
    if sides["left"]:
        p, x = (np.concatenate(c) for c in zip(*sides["left"]))
        x = x.astype(np.float32)
        for kind in ("home", "guest"):
            if not sides[kind]:
                continue
            q, y = (np.concatenate(c) for c in zip(*sides[kind]))
            y = y.astype(np.float32)
            # (x, 1, xx) . (2y, -yy, -1) is minus the squared distance; whole numbers below 2**24, so exact.
            left = np.column_stack((x, np.ones(len(x), np.float32), (x * x).sum(1)))
            right = np.ascontiguousarray(np.column_stack((2 * y, -(y * y).sum(1), np.full(len(y), -1, np.float32))).T)
            for a in range(0, len(left), 256):
                i, j = np.divmod(np.flatnonzero(left[a : a + 256] @ right >= -most), len(q))
                u, v = p[a + i], q[j]
                # Home vectors of one tile meet each other once.
                keep = u < v if kind == "home" and ti == tj else u != v
                u, v = u[keep], v[keep]
                out.append(np.stack((np.minimum(u, v), np.maximum(u, v)), 1))
    pairs = np.unique(np.concatenate(out), axis=0) if len(out) > 1 else out[0]
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _verifying(min_cosine: float, to: np.dtype):
    """a, b and their vectors' bytes -> a, b, cosine of the near ones."""

    def verify(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), to).reshape(n, -1).astype(np.float64) for i in (2, 3))
                c = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                near = np.flatnonzero(c >= min_cosine)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(near)), batch.column(1).take(pa.array(near)), pa.array(c[near])], ["a", "b", "cosine"])

    return verify


def _raw(batches):
    """node, e -> node and the vector's bytes."""
    for batch in batches:
        flat = np.ascontiguousarray(batch.column(1).flatten().to_numpy(zero_copy_only=False))
        size = flat.itemsize * (len(flat) // max(batch.num_rows, 1))
        data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), batch.num_rows, [None, pa.py_buffer(flat)]) if batch.num_rows else pa.array([], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), data.cast(pa.binary())], ["node", "raw"])


def _joining(dims: list[int], radius2: float):
    return lambda table: _join(table, dims, radius2)


def _usable(vectors: DataFrame, embedding_col: str, id_col: str) -> DataFrame:
    """(id, e) of the rows that can be near others; e keeps its type if that is float, else it is double."""
    kind = "array<float>" if vectors.schema[embedding_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(embedding_col).cast(kind).alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & F.col("e").isNotNull() & ~bad & F.exists("e", lambda x: x != 0))


def _distinct(vectors: DataFrame, embedding_col: str, id_col: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(id, e, dim) of the usable rows, each once; (node, id, m, e, dim) of the distinct vectors: smallest of their ids, and how many; paths."""
    rows, rows_path = materialize(_usable(vectors, embedding_col, id_col).distinct(), "embed-rows")
    own = rows.groupBy("e").agg(F.min("id").alias("id"), F.count("*").alias("m"))
    # Numbered where they are written: whatever reads the table sees the same numbers.
    firsts, path = materialize(own.select(F.monotonically_increasing_id().alias("node"), "id", "m", "e", F.size("e").alias("dim")), "embed-first")
    return rows, firsts, [rows_path, path]


def _near(firsts: DataFrame, min_cosine: float, block_dims: int, tile: int) -> tuple[DataFrame, list[str]]:
    """(a, b, cosine) of all near pairs of nodes, a < b, each once; and paths."""
    radius2, paths, out = 2 * (1 - min_cosine), [], None
    for dim in sorted(r[0] for r in firsts.select("dim").distinct().collect()):
        spans = blocks_of(dim, block_dims)
        own = firsts.where(F.col("dim") == dim).select("node", "e")
        cells, path = materialize(own.mapInArrow(lambda it, d=dim, s=spans: _cells(it, d, s, radius2), "block int, cell long, guest boolean, n int, nodes binary, x binary"), "embed-cells")
        paths.append(path)
        # A cell without a home vector, or with one vector alone, has no pair.
        size = cells.groupBy("block", "cell").agg(F.sum(F.when(F.col("guest"), 0).otherwise(F.col("n"))).alias("home"), F.sum("n").alias("n")).where("home > 0 AND n > 1")
        size = size.select("block", "cell", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
        placed = cells.join(size, ["block", "cell"]).withColumn("tile", F.pmod(F.xxhash64("nodes"), F.col("tiles")).cast("int"))
        # Pair (ti, tj) joins the home vectors of tile ti with those of tile tj >= ti, and with all guests of tile tj.
        every, mine = F.sequence(F.lit(0), F.col("tiles") - 1), F.col("tile")
        right = F.transform(every, lambda x: F.when(F.col("guest"), F.struct(x.alias("ti"), mine.alias("tj"))).otherwise(F.struct(F.least(x, mine).alias("ti"), F.greatest(x, mine).alias("tj"))))
        left = F.when(F.col("guest"), F.slice(right, 1, 0)).otherwise(F.transform(F.filter(every, lambda x: x < mine), lambda x: F.struct(mine.alias("ti"), x.alias("tj"))))
        spread = placed.select("block", "cell", "guest", "nodes", "x", "tile", F.explode(F.concat(right, left)).alias("p")).select("block", "cell", "guest", "nodes", "x", "tile", "p.ti", "p.tj")
        found = spread.groupBy("block", "cell", "ti", "tj").applyInArrow(_joining([hi - lo for lo, hi in spans], radius2), "a long, b long").distinct()
        to = np.dtype(np.float32 if "float" in own.schema["e"].dataType.simpleString() else np.float64)
        raw = own.mapInArrow(_raw, "node long, raw binary")
        vectors_of = lambda c, v: raw.select(F.col("node").alias(c), F.col("raw").alias(v))
        near = found.join(vectors_of("a", "__x"), "a").join(vectors_of("b", "__y"), "b").select("a", "b", "__x", "__y").mapInArrow(_verifying(min_cosine, to), "a long, b long, cosine double")
        near, path = materialize(near, "embed-near")
        paths.append(path)
        out = near if out is None else out.union(near)
    return out if out is not None else firsts.sparkSession.createDataFrame([], "a long, b long, cosine double"), paths


def near_classes(vectors: DataFrame, min_cosine: float = MIN_COSINE, embedding_col: str = "embedding", id_col: str = "vec_id", block_dims: int = BLOCK_DIMS, tile: int = TILE) -> DataFrame:
    """(vec_id, class_id, n_links) of every vector: its class and the number of others of at least ``min_cosine``.

    A class is what links join, directly or through others; its id is the smallest of
    its vectors' ids.  Links are those of all pairs of vectors, copies counted each,
    although they are never listed; the search is exact.

    Defined cases: rows with a null id or embedding, an empty embedding, a null,
    infinite or NaN number in it, or of length 0 (all zeros) have no row; vectors of
    different dimensions are not compared; rows that repeat id and vector are one; an
    id with several vectors has a row for each, and these are compared like any
    others; a vector without links is a class of its own; an empty table gives no
    rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows, firsts, paths = _distinct(vectors, embedding_col, id_col)
    near, more = _near(firsts, min_cosine, block_dims, tile)
    roots, root_path = components(near.select("a", "b"))
    # Of each distinct vector: the other vectors near it, times their copies, and its own other copies.
    size = lambda c, v: firsts.select(F.col("node").alias(c), F.col("m").alias(v))
    counted = near.select("a", "b").join(size("a", "ma"), "a").join(size("b", "mb"), "b")
    degree = counted.select(F.col("a").alias("node"), F.col("mb").alias("k")).union(counted.select(F.col("b").alias("node"), F.col("ma").alias("k"))).groupBy("node").agg(F.sum("k").alias("k"))
    own = firsts.select("node", "id", "m", "e").join(roots, "node", "left").join(degree, "node", "left")
    own = own.select("e", "id", F.coalesce("root", "node").alias("root"), (F.coalesce("k", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    names = own.groupBy("root").agg(F.min("id").alias("class_id"))
    own, own_path = materialize(own.join(names, "root").select("e", "class_id", "n_links"), "embed-own")
    out, _ = materialize(rows.join(own, "e").select(F.col("id").alias("vec_id"), "class_id", "n_links"), "embed-classes")
    remove(spark, *paths, *more, root_path, own_path)
    return out


def near_pairs(vectors: DataFrame, min_cosine: float = MIN_COSINE, embedding_col: str = "embedding", id_col: str = "vec_id", block_dims: int = BLOCK_DIMS, tile: int = TILE) -> DataFrame:
    """(a, b, cosine): all pairs of ids of at least ``min_cosine``, a < b, each once with its largest cosine.

    Copies are expanded: m copies of one vector and n of a near one have all their
    m * n pairs, and copies all pairs among themselves (near_classes() has the same
    links without listing them).  Defined cases as there; ids are never paired with
    themselves.
    """
    spark = vectors.sparkSession
    rows, firsts, paths = _distinct(vectors, embedding_col, id_col)
    near, more = _near(firsts, min_cosine, block_dims, tile)
    held = rows.join(firsts.select("e", "node"), "e").select("id", "node")
    side = lambda c, v: held.select(F.col("node").alias(c), F.col("id").alias(v))
    apart = near.join(side("a", "p"), "a").join(side("b", "q"), "b").select("p", "q", "cosine")
    same = side("n", "p").join(side("n", "q"), "n").where("p < q").select("p", "q", F.lit(1.0).alias("cosine"))
    out = apart.union(same).where("p != q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "cosine")
    out, _ = materialize(out.groupBy("a", "b").agg(F.round(F.max("cosine"), 6).alias("cosine")), "embed-pairs")
    remove(spark, *paths, *more)
    return out

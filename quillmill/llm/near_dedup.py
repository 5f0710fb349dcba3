"""MinHash near-duplicate detection with tensored banding.

Two small collections of ``side`` keys each are made of ``rows`` minhash values
a key; table (i, j) is keyed by the pair of key i of the first and key j of the
second.  That gives side**2 tables of 2 * rows values from 2 * side * rows
minhash computations instead of 2 * side**2 * rows.  A pair of Jaccard
similarity s meets in some table with probability (1 - (1 - s**rows)**side)**2:
0.945 at s = 0.6, 0.991 at 0.7 and 0.9996 at 0.8 with the defaults.

Every candidate that decides a group is verified by the exact Jaccard
similarity of its shingle sets.  Inside a bucket the members that one task reads are
compared with the first of them, and these firsts, which alone are shuffled, with the
first of all: a bucket of a third of all rows is a row a task.  Members that this does
not settle are compared with the others of their buckets that are not in their group
yet.  Of these, pairs are left out that cannot be similar: their sizes differ too
much, or their distances to the same first one do (the Jaccard distance obeys the
triangle inequality).  So the groups
are the connected components of *all* verified candidate pairs, with no cap on the
size of a bucket and without listing the pairs of a large group of copies.

No text is shuffled: shingle sets are made where a document is read, for those whose
ids are candidates (or that a Bloom filter of these lets through, where they are many).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import textkit as tk
from .graph import components
from .shared import free_name, materialize, remove

SHINGLE = 3
ROWS = 2
SIDE = 8
THRESHOLD = 0.6
#: Documents whose buckets a task puts together at once.
TOGETHER = 1 << 13
#: Ids that are dropped by a broadcast (8 bytes each); more than these by a merge join.
BROADCAST_IDS = 1_000_000


def _seeds(n: int) -> np.ndarray:
    return np.array([tk.mix_int(0x5EED0 + i) | 1 for i in range(n)], dtype=np.uint64)


def half_keys(sh: np.ndarray, offs: np.ndarray, rows: int, side: int) -> np.ndarray:
    """(documents, 2 * side) keys of ``rows`` minhash values each; documents have a shingle at least."""
    seeds, out = _seeds(2 * side * rows), np.zeros((len(offs) - 1, 2 * side), np.uint64)
    for key in range(2 * side):
        acc = np.full(len(offs) - 1, key + 1, np.uint64)
        for r in range(rows):
            v = sh * seeds[key * rows + r]
            v ^= v >> np.uint64(32)
            acc = tk.mix(acc * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(v * np.uint64(0xFF51AFD7ED558CCD), offs[:-1]))
        out[:, key] = acc
    return out


def _signatures(batches, k: int, rows: int, side: int):
    """doc_id, __text -> doc_id, n_words, two sequence hashes, keys; documents without words are left out."""
    for batch in batches:
        ids = batch.column(0)
        for words in tk.word_chunks(batch.column(1)):
            has = np.flatnonzero(np.diff(words.doc_start) > 0)
            if not len(has):
                continue
            s1, s2 = tk.sequence_hashes(words)
            sh, offs = tk.shingles(words, k)
            keys = half_keys(sh, np.append(offs[:-1][has], offs[-1]), rows, side)
            raw = keys.view(np.int64).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, raw.size + 1, 2 * side, dtype=np.int32)), pa.array(raw))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(has + words.lo)), pa.array(np.diff(words.doc_start)[has].astype(np.int64)), pa.array(s1[has]), pa.array(s2[has]), lists],
                ["doc_id", "n_words", "seq1", "seq2", "keys"],
            )


def tensor(keys: np.ndarray) -> np.ndarray:
    """(documents, side ** 2) table keys of (documents, 2 * side) half keys: every pair of a first and a second one."""
    side = keys.shape[1] // 2
    table = np.arange(side * side, dtype=np.uint64).reshape(side, side)
    both = tk.mix(keys[:, :side, None] + np.uint64(0x9E3779B97F4A7C15)) + keys[:, None, side:]
    return tk.mix(both + table * np.uint64(0xD6E8FEB86659FD93)).reshape(len(keys), side * side)


def _own_buckets(batches, others: bool):
    """doc_id, keys -> key, rep, doc_id of the members of this task's buckets but the first ones (``others``), or key, doc_id of the first ones."""

    def out(docs: np.ndarray, halves: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(docs, kind="stable")
        docs, all_keys = docs[order], tensor(halves[order])
        key, doc = all_keys.ravel(), np.repeat(docs, all_keys.shape[1])
        s = np.sort(key)
        again = np.unique(s[1:][s[1:] == s[:-1]])
        own = np.flatnonzero(again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key) if len(again) else np.zeros(0, np.int64)
        at = own[np.argsort(key[own], kind="stable")]  # in a bucket, ids ascend
        new = np.append(True, key[at][1:] != key[at][:-1])[: len(at)]
        first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        if others:
            at, first = at[doc[at] != doc[first]], first[doc[at] != doc[first]]
            return pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(doc[first]), pa.array(doc[at])], ["key", "rep", "doc_id"])
        alone = np.ones(len(key), bool)
        alone[at[~new]] = False
        return pa.RecordBatch.from_arrays([pa.array(key[alone].view(np.int64)), pa.array(doc[alone])], ["key", "doc_id"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)))
            n += batch.num_rows
        if n >= TOGETHER:
            yield out(*(np.concatenate(x) for x in zip(*held)))
            held, n = [], 0
    if held:
        yield out(*(np.concatenate(x) for x in zip(*held)))


def _bucket_members(batches):
    """key, doc_id (sorted) -> key, rep, doc_id of each bucket's members but the first, which is rep; a bucket of any size is streamed."""
    last, rep = None, 0
    for batch in batches:
        key, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = last is None or key[0] != last
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first = np.where(at >= 0, doc[at], rep)
        last, rep = key[-1], first[-1]
        other = np.flatnonzero(doc != first)
        yield pa.RecordBatch.from_arrays([pa.array(key[other]), pa.array(first[other]), pa.array(doc[other])], ["key", "rep", "doc_id"])


def _shingle_sets(batches, k: int):
    """doc_id, __text -> doc_id and its sorted distinct shingle hashes as bytes."""
    for batch in batches:
        ids = batch.column(0)
        for words in tk.word_chunks(batch.column(1)):
            sh, offs = tk.shingles(words, k)
            doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
            order = np.lexsort((sh, doc))
            sh, doc = sh[order], doc[order]
            keep = np.ones(len(sh), bool)
            keep[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
            sh, doc = sh[keep], doc[keep]
            cut = np.searchsorted(doc, np.arange(len(offs))) * 8
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(cut.astype(np.int64).tobytes()), pa.py_buffer(sh.tobytes())])
            yield pa.RecordBatch.from_arrays([ids.slice(words.lo, words.n_docs), binary.cast(pa.binary())], ["doc_id", "shingles"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    both = np.concatenate((a, b))
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same / (len(a) + len(b) - same)


def _verify(batches):
    """a, b and their shingle bytes -> a, b, jaccard and b's number of shingles."""
    for batch in batches:
        x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(i)] for i in (2, 3))
        found, size = np.array([jaccard(p, q) for p, q in zip(x, y)], np.float64), np.array([len(q) for q in y], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array(size)], ["a", "b", "jaccard", "size"])


def _sets_of(docs: DataFrame, pairs: DataFrame, k: int) -> tuple[DataFrame, str]:
    """Shingle sets of the documents in pairs (a, b), and of a few others."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    ids, path = materialize(ids, "near-candidates")
    some = bloom.only(docs, ids, ids.count(), "doc_id")
    sets = materialize(some.mapInArrow(lambda it: _shingle_sets(it, k), "doc_id long, shingles binary"), "near-shingles")
    remove(docs.sparkSession, path)
    return sets


def _verified(sets: DataFrame, pairs: DataFrame) -> tuple[DataFrame, str]:
    """pairs (a, b) with their exact Jaccard similarity, and b's size; of an id with several texts, each of these."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("__x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("__y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "__x", "__y")
    return materialize(joined.mapInArrow(_verify, "a long, b long, jaccard double, size long"), "near-verified")


def near_duplicates(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    shingle: int = SHINGLE,
    rows: int = ROWS,
    side: int = SIDE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Groups of near-duplicates: (doc_id, keep_id, exact, n_links) for every document of a group of two or more.

    ``keep_id`` is the smallest id of the group (the document that stays), its class;
    ``exact`` tells whether the document has the very word sequence of another
    document with a smaller id.  ``n_links`` is the number of documents that it was
    compared with and resembles: of copies, each is linked with the first of them
    alone, and in a bucket what resembles its first one is not compared any further,
    so a group's links hold it together, but are not all that could be drawn in it.
    Documents are compared by the sets of their word ``shingle``-grams; those of
    fewer words have one shingle, all their words.

    Defined cases: a null id cannot be named, so such rows are left out; null
    texts and texts without a word have no shingle and are in no group; rows that
    repeat an id count once (if their texts differ, all of them are compared and
    the id is in a group with whatever any of them resembles); texts of any length
    are taken whole; an empty table gives an empty result; other columns, whatever
    their names, are not read.  Ties go to the smaller id.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), tk.lowered(text_col).alias("__text")).where("doc_id IS NOT NULL")
    sig, sig_path = materialize(texts.mapInArrow(lambda it: _signatures(it, shingle, rows, side), "doc_id long, n_words long, seq1 long, seq2 long, keys array<long>"), "near-signatures")
    # Documents of the same words are one: only the first goes on.
    seq = ["seq1", "seq2", "n_words"]
    first = sig.groupBy(*seq).agg(F.min("doc_id").alias("__first"), F.min("keys").alias("keys"))
    table, first_path = materialize(first.select(*seq, F.col("__first").alias("doc_id"), "keys"), "near-first")
    copies, copies_path = materialize(
        sig.select("doc_id", *seq).join(table.select(*seq, F.col("doc_id").alias("keep_id")), seq).where("doc_id != keep_id").select("doc_id", "keep_id").distinct(), "near-copies"
    )
    remove(spark, sig_path)
    # Tables of pairs of keys: what a task has of a bucket, and the first ones of all tasks.
    half = table.select("doc_id", "keys")
    local = half.mapInArrow(lambda it: _own_buckets(it, True), "key long, rep long, doc_id long")
    firsts = half.mapInArrow(lambda it: _own_buckets(it, False), "key long, doc_id long").repartition("key").sortWithinPartitions("key", "doc_id")
    members, members_path = materialize(local.union(firsts.mapInArrow(_bucket_members, "key long, rep long, doc_id long")), "near-buckets")
    star = members.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    sets, sets_path = _sets_of(texts, star, shingle)
    checked, checked_path = _verified(sets, star)
    good = checked.where(F.col("jaccard") >= threshold).select("a", "b")
    used = [first_path, members_path, sets_path, checked_path, copies_path]
    # Members that this leaves outside of the group of their bucket's first one: compared with the others there.
    if not checked.where(F.col("jaccard") < threshold).isEmpty():
        settled, settled_path = components(good)
        # An id with several texts has the bounds of all of them.
        scores = checked.groupBy(F.col("a").alias("rep"), F.col("b").alias("doc_id")).agg(*[f(c).alias(f"{n}_{c}") for c in ("jaccard", "size") for n, f in (("lo", F.min), ("hi", F.max))])
        unknown = [F.lit(None).cast("double").alias(f"{n}_jaccard") for n in ("lo", "hi")] + [F.lit(None).cast("long").alias(f"{n}_size") for n in ("lo", "hi")]
        top = members.groupBy("key").agg(F.min("rep").alias("doc_id"))
        rows = members.join(scores, ["rep", "doc_id"]).select("key", "rep", "doc_id", "lo_jaccard", "hi_jaccard", "lo_size", "hi_size")
        rows = rows.union(top.select("key", F.col("doc_id").alias("rep"), "doc_id", *unknown))
        roots = settled.select(F.col("node").alias("doc_id"), "root")
        rows = rows.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        first = top.join(roots, "doc_id", "left").select("key", F.coalesce("root", "doc_id").alias("top"))
        rows, rows_path = materialize(rows.join(first, "key").withColumn("out", F.col("root") != F.col("top")).drop("top"), "near-rows")
        x = rows.where("out").alias("x")
        y = rows.join(rows.where("out").select("key").distinct(), "key", "left_semi").alias("y")
        apart = (F.col("x.rep") == F.col("y.rep")) & (F.greatest(F.col("x.lo_jaccard") - F.col("y.hi_jaccard"), F.col("y.lo_jaccard") - F.col("x.hi_jaccard")) > 1 - threshold + 1e-9)
        uneven = (F.col("x.hi_size") < threshold * F.col("y.lo_size") - 1e-9) | (F.col("y.hi_size") < threshold * F.col("x.lo_size") - 1e-9)
        twice = F.col("y.out") & (F.col("x.doc_id") > F.col("y.doc_id"))
        no = lambda c: ~F.coalesce(c, F.lit(False))  # noqa: E731  # what is not known rules nothing out
        more = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & no(apart) & no(uneven) & ~twice)
        more = more.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
        more = more.join(star, ["a", "b"], "left_anti")  # verified already
        second, second_path = _verified(sets, more)  # all of them are in star, too
        good = good.union(second.where(F.col("jaccard") >= threshold).select("a", "b"))
        used += [settled_path, rows_path, second_path]
    links, links_path = materialize(good.union(copies.select(F.col("keep_id").alias("a"), F.col("doc_id").alias("b"))).distinct(), "near-links")
    near, near_path = components(links)
    ends = links.select(F.col("a").alias("doc_id")).union(links.select(F.col("b").alias("doc_id"))).groupBy("doc_id").agg(F.count("*").alias("n_links"))
    # Every document of a group has a link.
    result = ends.join(near.select(F.col("node").alias("doc_id"), F.col("root").alias("keep_id")), "doc_id", "left").join(copies.select("doc_id", F.lit(True).alias("exact")).distinct(), "doc_id", "left")
    out, _ = materialize(result.select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("exact", F.lit(False)).alias("exact"), "n_links"), "near-groups")
    remove(spark, links_path, near_path, *used)
    return out


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **params) -> DataFrame:
    """docs without the members of near-duplicate groups other than each group's smallest id.

    Columns and their order stay; rows with a null id stay (they are in no
    group), and so do rows whose text is null or has no word; rows that repeat a kept
    id stay, as they cannot be told apart; an empty table stays empty.  Nothing is
    shuffled up to ``BROADCAST_IDS`` dropped ids; beyond, rows are merge-joined with them.
    """
    groups = near_duplicates(docs, text_col, id_col, **params)
    name = free_name(docs, "__gone")
    gone = groups.where("doc_id != keep_id").select(F.col("doc_id").alias(name))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("merge")
    return docs.join(gone, docs[id_col].cast("long") == gone[name], "left_anti")

"""Repeated substrings by bucket-pointer refinement of a suffix array.

Every word position of the corpus is a suffix.  Suffixes are first put into
buckets by their leading q-gram.  A bucket of depth h is then refined by sorting
its suffixes on the bucket identifiers of the suffixes h words on: equal
identifiers there mean 2h equal words.  The identifiers that a round assigns are
what the next one sorts on, so the depth doubles each round (the last step
overlaps, to end at exactly the wanted length).  A suffix alone in its bucket is
at its final place and leaves; for deduplication that is nearly all of them after
the first round.

The leading q-gram is known by ``log2(parts) + 40`` bits of its hash; two
different texts that agree in them are told apart by the refinement unless their
next q-grams agree in the same way, too.  Identifiers after that are exact.

Each round moves packed positions (see windows.py) to the part that sorts their
bucket and back to their segment, where the pointers to later offsets are looked
up.  Text is read once and never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from . import windows as wn
from .shared import materialize

#: Words of the initial buckets' q-gram.
QGRAM = 13
#: Words that a repeat has at least.
LENGTH = 50
_TAIL = 5


def _initial(batches, q: int, parts: int):
    """doc_id, __text -> directories, and by part the q-gram hash tails of all positions, and whether others of the segment share them."""

    def values(_, words):
        return tk.gram_hashes(words, q)

    for seg, ids, start, (h, ok) in wn.segments(batches, values):
        rows, pos = wn.Rows(), np.flatnonzero(ok)
        h = h[pos]
        # What a part can tell apart: its number and the tail.
        part = wn.part_of(h, parts)
        folded = wn.fold([(h & np.uint64((1 << 8 * _TAIL) - 1)) | (part.astype(np.uint64) << np.uint64(8 * _TAIL))], pos)
        at = folded.at
        rows.directory(seg, ids, start, folded)
        wn.split(rows, seg, part[at], pos[at], [(h[at], _TAIL), (folded.many, 1)])
        yield rows.batch()


def _number(keys: list[np.ndarray], many: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries that share their key with another, or stand for ``many`` (ascending), and their buckets' identifiers, from 1 on in this part."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        s = k[order]
        same &= s[1:] == s[:-1]
    some = many[order]
    some[1:] |= same
    some[:-1] |= same
    bucket = np.cumsum(np.append(True, ~same)[: len(order)])
    at, ident = order[some], bucket[some].astype(np.uint64) | np.uint64(part << 40)
    back = np.argsort(at, kind="stable")
    return at[back], ident[back]


def _bucket(table: pa.Table, n_keys: int, width: int) -> pa.Table:
    """The rows of a part (keys, many, positions) -> back by segment: a = bucket identifiers, b = positions, of what is not alone."""
    rows, part = wn.Rows(), table.column("part")[0].as_py()
    if part < 0:
        return table
    keys = [[wn.unpack(v.as_py(), np.uint64, width) for v in table.column(c)] for c in "ab"[:n_keys]]
    many = np.concatenate([wn.unpack(v.as_py(), np.bool_) for v in table.column("abc"[n_keys])])
    at, ident = _number([np.concatenate(k) for k in reversed(keys)], many, part)
    row_of = np.repeat(np.arange(table.num_rows), [len(x) for x in keys[0]])
    wn.by_segment(table, row_of, at, rows, part, [(ident, 8)], [wn.unpack_sorted(v.as_py()) for v in table.column("cd"[n_keys - 1])])
    return pa.Table.from_batches([rows.batch()])


def _point(table: pa.Table, step: int, parts: int, last: bool) -> pa.Table:
    """A segment's bucketed positions -> by part: the identifiers of a position and of the one ``step`` on, for window_spans() if they are the ``last``."""
    rows = wn.Rows()
    ids, start, rest, reps, found = wn.directory_of(table)
    seg = table.column("seg")[0].as_py()
    ident = np.zeros(start[-1] + step, np.uint64)
    for r in found:
        ident[wn.unpack_sorted(r["b"])] = wn.unpack(r["a"], np.uint64)
    ident[rest] = ident[reps]
    pos = np.flatnonzero((ident[:-step] != 0) & (ident[step:] != 0))
    doc = np.searchsorted(start, pos, side="right") - 1
    pos = pos[pos + step < start[doc + 1]]
    a, b = ident[pos], ident[pos + step]
    part = wn.part_of(tk.mix(tk.mix(a) + b), parts)
    if last:
        wn.send_windows(rows, seg, ids, start, pos, [a, b], (8, 8), part)
    else:
        folded = wn.fold([a, b], pos)
        at = folded.at
        rows.directory(seg, ids, start, folded)
        wn.split(rows, seg, part[at], pos[at], [(a[at], 8), (b[at], 8), (folded.many, 1)])
    return pa.Table.from_batches([rows.batch()])


def _bucketing(n_keys: int, width: int):
    return lambda table: _bucket(table, n_keys, width)


def _pointing(step: int, parts: int, last: bool):
    return lambda table: _point(table, step, parts, last)


def repeated_substrings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, qgram: int = QGRAM) -> DataFrame:
    """Spans of words that other documents repeat: (doc_id, start_word, end_word, first_doc).

    A span is a maximal run of words covered by windows of ``length`` words that
    occur in another document, too; ``first_doc`` is the smallest id of a document
    that has one of these windows (where it is doc_id, this is a first
    occurrence).  Words are those of textkit.py (case and punctuation do not
    count), numbered from 0; end_word is exclusive.

    Defined cases: rows with a null id are left out; null, empty and short texts
    have no window; rows that repeat an id are one document when repeats are
    counted, and each has its spans reported; repeats inside one document alone are
    not reported; texts of any length are taken whole; an empty table has no spans;
    other columns are not read.
    """
    if not 1 <= qgram < length:
        raise ValueError("qgram must be shorter than length")
    parts = wn.n_parts(docs, text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), tk.lowered(text_col).alias("__text")).where("doc_id IS NOT NULL")
    keyed, depth, keys, width = texts.mapInArrow(lambda it: _initial(it, qgram, parts), wn.SCHEMA), qgram, 1, _TAIL
    while depth < length:
        step = min(depth, length - depth)
        found = keyed.groupBy("part").applyInArrow(_bucketing(keys, width), wn.SCHEMA)
        keyed = found.groupBy("seg").applyInArrow(_pointing(step, parts, depth + step >= length), wn.SCHEMA)
        depth, keys, width = depth + step, 2, 8
    return materialize(wn.window_spans(keyed, length, (8, 8), later_only=False), "suffix-spans")[0]

"""Packed word positions: the exchange that the two substring operators share.

A *segment* is a run of documents that one task read, of about ``SEGMENT_WORDS``
words; a position is a word number in its segment.  Keys of positions travel
between segments and *parts* (hash ranges) as packed arrays, a row for each
(part, segment) and not for each word: sorting and comparing is numpy's work, and
a shuffled position costs little more than the bits of its key that differ.

A key that a segment has at several positions leaves it once, with its first one (its
*representative*); the others stay in the segment's directory.  So what a part gets
of a passage that all documents share is a position for each segment, not for each
document, and the smallest and largest document id of it in that segment.

Rows have the columns ``part, seg, a, b, c, d, e``.  A negative part marks a segment's
directory: a = document ids, b = first word of each document and the end, c = positions
that are not sent, d = their representatives.  It passes through the parts' groups as it
is, so that one plan without a stored table between its steps does all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

SEGMENT_WORDS = 1 << 19
#: Bytes of text a part stands for: what a reducer holds of it is about 40 bytes for each 6 of these.
PART_BYTES = 4 << 20
#: Groups that directories are spread over.
DIRECTORY_PARTS = 1 << 12
SCHEMA = "part int, seg long, a binary, b binary, c binary, d binary, e binary"
SPANS = "doc_id long, start_word long, end_word long, first_doc long"
_NAMES = ["part", "seg", "a", "b", "c", "d", "e"]


def pack(a: np.ndarray, width: int | None = None) -> bytes:
    """Byte planes of an array, the lowest ``width`` of them: planes that hardly vary compress to nothing."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)
    return np.ascontiguousarray(planes[:, : width or a.itemsize].T).tobytes()


def unpack(b: bytes, dtype: type, width: int | None = None) -> np.ndarray:
    """The array that pack() packed, its upper bytes zero."""
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(b, np.uint8).reshape(width or size, -1)
    out = np.zeros((planes.shape[1], size), np.uint8)
    out[:, : planes.shape[0]] = planes.T
    return out.view(dtype).ravel()


def pack_sorted(pos: np.ndarray) -> bytes:
    """Ascending positions as packed gaps."""
    return pack(np.diff(pos, prepend=0).astype(np.uint32))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint32), dtype=np.int64)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash, by its upper 32 bits."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def n_parts(docs: DataFrame, text_col: str) -> int:
    """Parts for all text of docs."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-total // PART_BYTES))


@dataclass
class Folded:
    """Positions of a segment's keys, each key once."""

    at: np.ndarray  #: entries that are sent (ascending)
    many: np.ndarray  #: of each of them, whether others have its key
    rest: np.ndarray  #: positions of the others
    first: np.ndarray  #: and of their representatives
    entries: np.ndarray  #: all entries that share a key, by key
    runs: np.ndarray  #: where the entries of a key begin in that


def fold(keys: list[np.ndarray], pos: np.ndarray) -> Folded:
    """Entries (keys at ascending positions), the equal ones put together."""
    n = len(pos)
    one = keys[0] if len(keys) == 1 else tk.mix(tk.mix(keys[0]) + keys[1])
    s = np.sort(one)
    again = s[1:][s[1:] == s[:-1]]
    none = np.zeros(0, np.int64)
    if not len(again):
        return Folded(np.arange(n), np.zeros(n, bool), none, none, none, none)
    again = again[np.append(True, again[1:] != again[:-1])]
    # Few entries share a key: only these are sorted by it.
    own = np.flatnonzero(again[np.minimum(np.searchsorted(again, one), len(again) - 1)] == one)
    order = own[np.lexsort([k[own] for k in keys])]  # stable: positions of a key ascend
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        t = k[order]
        new[1:] |= t[1:] != t[:-1]
    runs = np.flatnonzero(new)
    size = np.diff(np.append(runs, len(order)))
    keep, many = np.ones(n, bool), np.zeros(n, bool)
    keep[order[~new]] = False
    many[order[runs[size > 1]]] = True
    return Folded(np.flatnonzero(keep), many[keep], pos[order[~new]], pos[np.repeat(order[runs], size)[~new]], order, runs)


def extremes(folded: Folded, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest document id of the entries that are sent."""
    low, high = docs.copy(), docs.copy()
    if len(folded.entries):
        d, head = docs[folded.entries], folded.entries[folded.runs]
        low[head], high[head] = np.minimum.reduceat(d, folded.runs), np.maximum.reduceat(d, folded.runs)
    return low[folded.at], high[folded.at]


def unfold(pos: np.ndarray, values: np.ndarray, rest: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (ascending) and their values, from those of representatives."""
    order = np.argsort(pos)
    pos, values = pos[order], values[order]
    if len(rest) and len(pos):
        at = np.minimum(np.searchsorted(pos, first), len(pos) - 1)
        some = pos[at] == first
        pos, values = np.concatenate((pos, rest[some])), np.concatenate((values, values[at[some]]))
        order = np.argsort(pos)
        pos, values = pos[order], values[order]
    return pos, values


class Rows:
    """Collects rows of SCHEMA for one Arrow batch."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, part: int, seg: int, *blobs: bytes) -> None:
        self.rows.append((part, seg, *blobs, *[None] * (5 - len(blobs))))

    def directory(self, seg: int, ids: np.ndarray, start: np.ndarray, folded: Folded) -> None:
        self.add(-1 - seg % DIRECTORY_PARTS, seg, pack(ids.astype(np.int64)), pack(start), pack(folded.rest), pack(folded.first))

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) if self.rows else [()] * 7
        types = [pa.int32(), pa.int64()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], _NAMES)


def split(rows: Rows, seg: int, part: np.ndarray, pos: np.ndarray, columns: list[tuple[np.ndarray, int]]) -> None:
    """A row for each part: columns (array, bytes to keep) and, last, the positions (which ascend)."""
    order = np.argsort(part.astype(np.uint16) if part.size and part.max() < 1 << 16 else part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for ix in np.split(order, cuts) if len(order) else []:
        rows.add(int(part[ix[0]]), seg, *[pack(c[ix], w) for c, w in columns], pack_sorted(pos[ix]))


class Segment:
    """Documents with an array of values for each word position."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.values: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray, *values: np.ndarray) -> None:
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.values.append(values)
        self.size += int(lengths.sum())

    def directory(self) -> tuple[np.ndarray, np.ndarray]:
        start = np.concatenate([[0], np.cumsum(np.concatenate(self.lengths))])
        return np.concatenate(self.ids), start


def segments(batches, values: Callable[[pa.RecordBatch, tk.Words], tuple[np.ndarray, ...]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Segments of doc_id, text batches: (number, document ids, first words, concatenated values)."""
    base, n, seg = TaskContext.get().partitionId() << 32, 0, Segment()

    def done(s: Segment):
        ids, start = s.directory()
        return base + n, ids, start, [np.concatenate(c) for c in zip(*s.values)]

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for words in tk.word_chunks(batch.column(1)):
            seg.add(ids[words.lo : words.lo + words.n_docs], np.diff(words.doc_start), *values(batch, words))
            if seg.size >= SEGMENT_WORDS:
                yield done(seg)
                n, seg = n + 1, Segment()
    if seg.size:
        yield done(seg)


def by_segment(table: pa.Table, row_of: np.ndarray, at: np.ndarray, rows: Rows, part: int, columns: list[tuple[np.ndarray, int]], positions: list[np.ndarray]) -> None:
    """Send the entries numbered ``at`` (ascending; entry -> table row in ``row_of``) back to their segments."""
    segs = table.column("seg").to_pylist()
    owner = row_of[at]
    cuts = np.flatnonzero(np.diff(owner)) + 1
    pos = np.concatenate(positions) if positions else np.zeros(0, np.int64)
    for ix in np.split(np.arange(len(at)), cuts) if len(at) else []:
        rows.add(part, segs[owner[ix[0]]], *[pack(c[ix], w) for c, w in columns], pack_sorted(pos[at[ix]]))


def directory_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[dict]]:
    """A segment's document ids, first words, positions that were not sent, their representatives, and its other rows."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["part"] < 0)
    return *(unpack(head[c], np.int64) for c in "abcd"), [r for r in rows if r["part"] >= 0]


def cross_document(keys: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose key two documents or more have (ascending), and the smallest document id of each one's key."""
    if not len(low):
        return np.zeros(0, np.int64), low
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    low, high = np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)
    size = np.diff(np.append(first, len(order)))
    low, many = np.repeat(low, size), np.repeat(low != high, size)
    at = order[many]
    back = np.argsort(at, kind="stable")
    return at[back], low[many][back]


def spans_of(ids: np.ndarray, start: np.ndarray, rest: np.ndarray, reps: np.ndarray, rows: list[dict], length: int, later_only: bool) -> pa.RecordBatch:
    """Maximal runs of words covered by repeated windows of ``length`` words: (doc_id, start_word, end_word, first_doc)."""
    pos = np.concatenate([unpack_sorted(r["b"]) for r in rows])
    pos, first = unfold(pos, np.concatenate([unpack(r["a"], np.int64) for r in rows]), rest, reps)
    doc = np.searchsorted(start, pos, side="right") - 1
    if later_only:
        keep = first < ids[doc]
        pos, first, doc = pos[keep], first[keep], doc[keep]
    new = np.ones(len(pos), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + length)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(pos)) - 1 if len(at) else at
    low = np.minimum.reduceat(first, at) if len(at) else first
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[doc[at]]), pa.array(pos[at] - start[doc[at]]), pa.array(pos[last] + length - start[doc[last]]), pa.array(low)],
        ["doc_id", "start_word", "end_word", "first_doc"],
    )


def send_windows(rows: Rows, seg: int, ids: np.ndarray, start: np.ndarray, pos: np.ndarray, keys: list[np.ndarray], widths: tuple[int, int], part: np.ndarray) -> None:
    """A segment's directory and, by part, what window_spans() takes: keys, smallest id, what the largest has more, positions."""
    folded = fold(keys, pos)
    doc = np.searchsorted(start, pos, side="right") - 1
    low, high = extremes(folded, ids[doc])
    at = folded.at
    rows.directory(seg, ids, start, folded)
    split(rows, seg, part[at], pos[at], [(keys[0][at], widths[0]), (keys[1][at], widths[1]), (low, 8), (high - low, 8)])


def window_spans(keyed: DataFrame, length: int, widths: tuple[int, int], later_only: bool) -> DataFrame:
    """Spans of ``keyed`` rows: directories, and parts as send_windows() makes them."""

    def classes(table: pa.Table) -> pa.Table:
        rows, part = Rows(), table.column("part")[0].as_py()
        if part < 0:
            return table
        a = [unpack(v.as_py(), np.uint64, widths[0]) for v in table.column("a")]
        b = [unpack(v.as_py(), np.uint64, widths[1]) for v in table.column("b")]
        low, more = (np.concatenate([unpack(v.as_py(), np.int64) for v in table.column(c)]) for c in ("c", "d"))
        at, low = cross_document([np.concatenate(b), np.concatenate(a)], low, low + more)
        by_segment(table, np.repeat(np.arange(len(a)), [len(x) for x in a]), at, rows, part, [(low, 8)], [unpack_sorted(v.as_py()) for v in table.column("e")])
        return pa.Table.from_batches([rows.batch()])

    def spans(table: pa.Table) -> pa.Table:
        ids, start, rest, reps, rows = directory_of(table)
        if not rows:
            return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, ["doc_id", "start_word", "end_word", "first_doc"])])
        return pa.Table.from_batches([spans_of(ids, start, rest, reps, rows, length, later_only)])

    return keyed.groupBy("part").applyInArrow(classes, SCHEMA).groupBy("seg").applyInArrow(spans, SPANS)

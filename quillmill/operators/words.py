"""The words of whole Arrow batches with numpy.

A table over all code points says what each character becomes (folded, dropped)
and what it is after that: blank, part of a word, or a word of its own.  Looking a
batch up in it, finding where words begin and putting their bytes together are
passes over arrays; no character or word is handled in Python.  The result is that
of functions.text.basic_tokenize_sql(), which is the same in built-in functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from ..functions import accents, chars

#: Bytes of text handled at once (arrays of some 60 times as many are held for them); a longer text is taken whole.
CHUNK_BYTES = 1 << 20
_DROPPED, _BLANK, _WORD, _ALONE = range(4)
_POINTS = 0x110000


@dataclass(frozen=True)
class Tables:
    """Of each code point: what it becomes and what that is; and what the ones that become several are replaced by first."""

    becomes: np.ndarray
    kind: np.ndarray
    special: np.ndarray
    expand: dict[int, str]


def _points(inside: str) -> np.ndarray:
    return np.array([ord(c) for c in chars.members(inside)], np.int64)


@lru_cache(maxsize=4)
def tables(fold: bool, cjk: bool) -> Tables:
    """The tables of the options; made once for each worker."""
    becomes = np.arange(_POINTS, dtype=np.uint32)
    gone = np.zeros(_POINTS, bool)
    special = np.zeros(_POINTS, bool)
    expand: dict[int, str] = {}
    if fold:
        frm, to, several = accents.tables()
        source = np.array([ord(c) for c in frm], np.int64)
        becomes[source[: len(to)]] = [ord(c) for c in to]
        gone[source[len(to) :]] = True
        expand = {ord(c): accents.fold_char(c) for c in (*several, *map(chr, range(0xAC00, 0xD7A4)))}
        special[list(expand)] = True
    blank = _points(chars.WHITESPACE)
    becomes[blank], gone[blank] = 32, False
    gone[_points(chars.DROPPED)] = True
    alone = np.zeros(_POINTS, bool)
    alone[_points(chars.PUNCTUATION)] = True
    kind = np.full(_POINTS, _WORD, np.uint8)
    kind[alone[becomes]] = _ALONE
    kind[becomes == 32] = _BLANK
    if cjk:
        kind[_points(chars.CHINESE)] = _ALONE
    kind[gone] = _DROPPED
    return Tables(becomes, kind, special, expand)


def string_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the n + 1 offsets into them (a null is empty)."""
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def chunks_of(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes (one at least)."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1))
        yield i, j
        i = j


def at_blanks(buf: np.ndarray, limit: int | None = None) -> Iterator[np.ndarray]:
    """A text's bytes in parts of about ``limit`` that end with a blank (the last need not)."""
    limit, at = limit or CHUNK_BYTES, 0
    while at < len(buf):
        end = len(buf)
        for near in range(at + limit, len(buf), 1 << 16):
            blank = np.flatnonzero(buf[near : near + (1 << 16)] == 32)
            if len(blank):
                end = near + int(blank[0]) + 1
                break
        yield buf[at:end]
        at = end


def code_points(buf: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the cuts (byte offsets) as offsets into them; what is no UTF-8 becomes U+FFFD."""
    if not len(buf) or buf.max() < 128:
        return buf, cut
    text = buf.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    if lead[-1] != len(points):  # not valid: each text by itself
        texts = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(cut, cut[1:])]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return points, np.append(0, np.cumsum([len(t) for t in texts]))
    return points, lead[cut]


def to_utf8(points: np.ndarray, cut: np.ndarray) -> tuple[bytes, np.ndarray]:
    """UTF-8 of code points, and cuts between them as byte offsets."""
    if not len(points) or points.max() < 128:
        return points.astype(np.uint8).tobytes(), cut
    size = 1 + (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), at[cut]


def _expanded(points: np.ndarray, cut: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """The texts with every special character replaced by the several that it becomes."""
    at = np.flatnonzero(t.special[points])
    to = [t.expand[int(p)] for p in points[at]]
    more = np.zeros(len(points), np.int64)
    more[at] = [len(x) - 1 for x in to]
    where = np.append(0, np.cumsum(more + 1))
    out = np.empty(where[-1], np.uint32)
    plain = np.ones(len(points), bool)
    plain[at] = False
    out[where[:-1][plain]] = points[plain]
    for a, x in zip(at, to):
        out[where[a] : where[a + 1]] = [ord(c) for c in x]
    return out, where[cut]


def _list(points: np.ndarray, cut: np.ndarray, t: Tables) -> tuple[np.ndarray, pa.Array]:
    """Number of words before each text (and at the end), and all words."""
    if points.dtype != np.uint8 and t.expand and t.special[points].any():
        points, cut = _expanded(points, cut, t)
    kind = t.kind[points]
    code = t.becomes[points]
    keep = kind != _DROPPED
    if not keep.all():
        before = np.zeros(len(kind) + 1, np.int64)
        np.cumsum(keep, out=before[1:])
        kind, code, cut = kind[keep], code[keep], before[cut]
    word = kind == _WORD
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    heads = cut[:-1][cut[:-1] < len(kind)]
    begins[heads] = word[heads]
    begins |= kind == _ALONE
    inside = kind != _BLANK
    starts = np.flatnonzero(begins)
    rank = np.cumsum(inside, dtype=np.int64)
    data, offs = to_utf8(code[inside], np.append(rank[starts] - 1, rank[-1] if len(rank) else 0))
    narrow = len(data) < 1 << 31
    kind_of = pa.string() if narrow else pa.large_string()
    words = pa.Array.from_buffers(kind_of, len(starts), [None, pa.py_buffer(offs.astype(np.int32 if narrow else np.int64)), pa.py_buffer(data)])
    return np.searchsorted(starts, cut), words


def word_lists(col: pa.Array, fold: bool = True, cjk: bool = True) -> Iterator[pa.Array]:
    """Lists of the words of a column's texts, a chunk of texts at a time; a null for a null."""
    t = tables(fold, cjk)
    buf, offs = string_parts(col)
    null = col.is_null().to_numpy(zero_copy_only=False)
    for i, j in chunks_of(offs):
        own = buf[offs[i] : offs[j]]
        if j == i + 1 and len(own) > 2 * CHUNK_BYTES:
            # A long text is done part by part, so that memory does not grow with it.
            parts = [_list(*code_points(x, np.array([0, len(x)])), t)[1].cast(pa.large_string()) for x in at_blanks(own)]
            words = pa.concat_arrays(parts)
            first = np.array([0, len(words)])
        else:
            first, words = _list(*code_points(own, offs[i : j + 1] - offs[i]), t)
        mask = pa.array(null[i:j]) if null[i:j].any() else None
        yield pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), words, mask=mask)


def basic_words(text: Column, fold: bool = True, cjk: bool = True) -> Column:
    """The words of a text column."""

    @arrow_udf("array<string>")
    def split_words(batch: pa.Array) -> pa.Array:
        return pa.concat_arrays([x.cast(pa.list_(pa.string())) for x in word_lists(batch, fold, cjk)] or [pa.array([], pa.list_(pa.string()))])

    return split_words(text)


def joined_words(text: Column, fold: bool = True, cjk: bool = True) -> Column:
    """The words of a text column in one string, with blanks between them, and their number: a struct of n and words."""

    @arrow_udf("struct<n:int,words:string>")
    def join_words(batch: pa.Array) -> pa.Array:
        n, out = [pa.array([], pa.int32())], [pa.array([], pa.string())]
        for lists in word_lists(batch, fold, cjk):
            n.append(pc.list_value_length(lists))
            out.append(pc.binary_join(lists, " ").cast(pa.string()))
        return pa.StructArray.from_arrays([pa.concat_arrays(n), pa.concat_arrays(out)], ["n", "words"])

    return join_words(text)


def count_words(text: Column, fold: bool = True, cjk: bool = True) -> Column:
    """The number of words of a text column."""

    @arrow_udf("int")
    def number_of_words(batch: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.int32()), *(pc.list_value_length(x) for x in word_lists(batch, fold, cjk))])

    return number_of_words(text)

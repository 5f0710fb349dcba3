"""Vectorised word and shingle hashing over Arrow string columns.

A *word* is a maximal run of ASCII letters and digits and non-ASCII characters
of the text as lowered() gives it; everything else separates words.  All arithmetic is modulo 2**64 on
whole buffers: a text costs a few numpy passes, never a Python loop per word.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text handled at once; a longer single text is taken whole.
CHUNK_BYTES = 1 << 20

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True

_P_BYTE = 0x9E3779B97F4A7C15
_P_WORD = 0xD6E8FEB86659FD93
_P_WORD2 = 0xA0761D6478BD642F
_MASK = (1 << 64) - 1
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes, or words, of a long document that are hashed at once.
BLOCK = 1 << 20
#: Powers that a worker keeps at most (16 bytes each); those of a longer text go with it.
KEPT = 1 << 21


def lowered(text: Column | str) -> Column:
    """The one lower-casing of all texts that are compared, by the JVM: a sigma does not depend on what follows it, and a dotted capital I is an i."""
    return F.replace(F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3")), F.lit("i\u0307"), F.lit("i"))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    """mix() of one Python int."""
    return int(mix(np.array([x & _MASK], dtype=np.uint64))[0])


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i in 0..n, modulo 2**64."""
    have = _TABLES.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 12, 1 << int(n + 1).bit_length()) if n <= KEPT else n + 1
        with np.errstate(over="ignore"):
            out = []
            for b in (base, pow(base, -1, 1 << 64)):
                t = np.full(size, b, dtype=np.uint64)
                t[0] = 1
                out.append(np.multiply.accumulate(t))
        have = (out[0], out[1])
        if n <= KEPT:
            _TABLES[base] = have
    return have


def string_parts(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets into them (a null is empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):  # no or several chunks
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


@dataclass
class Words:
    """The words of some documents: document i has words doc_start[i]..doc_start[i + 1]."""

    lo: int  #: number of the first document in the batch
    hashes: np.ndarray
    start: np.ndarray  #: byte offset of each word in ``buf``
    end: np.ndarray
    doc_start: np.ndarray
    buf: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.doc_start) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.doc_start))


def chunks_of(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes (one at least)."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_of(buf: np.ndarray, offs: np.ndarray, lo: int) -> Words:
    """Find and hash the words of the documents that ``offs`` cuts ``buf`` into."""
    n = len(buf)
    bounds = offs - offs[0]
    if n > BLOCK and len(offs) == 2:
        return _long_words(buf, lo)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(lo, z.astype(np.uint64), z, z, np.zeros(len(offs), np.int64), buf)
    isw = _IS_WORD[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = isw[:-1]
    inner = bounds[(bounds > 0) & (bounds < n)]
    before[inner] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = isw[1:]
    after[inner - 1] = False
    start = np.flatnonzero(isw & ~before)
    end = np.flatnonzero(isw & ~after) + 1
    power, inverse = _powers(_P_BYTE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return Words(lo, h, start, end, np.searchsorted(start, bounds), buf)


def _long_words(buf: np.ndarray, lo: int) -> Words:
    """words_of() one long document, part by part between words: a word's hash does not depend on where it lies."""
    parts, at = [], 0
    while at < len(buf):
        end = len(buf)
        for near in range(at + BLOCK // 2, len(buf), 1 << 16):
            gap = np.flatnonzero(~_IS_WORD[buf[near : near + (1 << 16)]])
            if len(gap):
                end = near + int(gap[0]) + 1
                break
        if end - at > BLOCK:  # a word of this length
            at_once = words_of(buf[at:end], np.array([0, 0, end - at]), lo)
        else:
            at_once = words_of(buf[at:end], np.array([0, end - at]), lo)
        parts.append((at_once.hashes, at_once.start + at, at_once.end + at))
        at = end
    h, start, end = (np.concatenate(x) for x in zip(*parts))
    return Words(lo, h, start, end, np.array([0, len(h)]), buf)


def word_chunks(col: pa.Array) -> Iterator[Words]:
    """Words of all documents of a column, a chunk of documents at a time."""
    buf, offs = string_parts(col)
    for i, j in chunks_of(offs):
        yield words_of(buf[offs[i] : offs[j]], offs[i : j + 1], i)


def gram_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they are all in one document."""
    n = len(words.hashes)
    if n < k:
        return np.zeros(n, np.uint64), np.zeros(n, bool)
    out = np.zeros(n, np.uint64)
    size = BLOCK + k - 1
    power, inverse = _powers(_P_WORD, min(n, size) + 1)
    for a in range(0, n - k + 1, BLOCK):  # a gram's hash does not depend on where it lies
        h = words.hashes[a : a + size]
        m = len(h) - k + 1
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power[: len(h)], out=sums[1:])
        out[a : a + m] = mix((sums[k:] - sums[:m]) * inverse[:m] + np.uint64(k))
    last = np.repeat(words.doc_start[1:], np.diff(words.doc_start))
    return out, np.arange(n) + k <= last


def sequence_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each document's whole word sequence, as two int64 arrays."""
    n = len(words.hashes)
    a, b = words.doc_start[:-1], words.doc_start[1:]
    out = []
    for base in (_P_WORD, _P_WORD2):
        power, inverse = _powers(base, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words.hashes * power[:n], out=sums[1:])
        out.append(mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and the n + 1 offsets of each document's.

    A document of 1 to k - 1 words has one shingle, all its words; one without
    words has none.
    """
    h, ok = gram_hashes(words, k)
    count = np.diff(words.doc_start)
    full = np.maximum(count - k + 1, 0)
    sizes = np.where(count > 0, np.maximum(full, 1), 0)
    offs = np.zeros(len(count) + 1, np.int64)
    np.cumsum(sizes, out=offs[1:])
    short = np.flatnonzero((count > 0) & (full == 0))
    if not len(short):
        return h[ok], offs
    out = np.empty(offs[-1], np.uint64)
    is_short = np.zeros(len(out), bool)
    is_short[offs[short]] = True
    out[~is_short] = h[ok]
    out[is_short] = sequence_hashes(words)[0][short].view(np.uint64)
    return out, offs


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w neighbours, in log2(w) passes."""
    have, m = 1, v
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < w:
        m = np.minimum(m[: len(m) - (w - have)], m[w - have :])
    return m


def winnow(h: np.ndarray, doc_start: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions selected by winnowing: the smallest k-gram hash (the last of equals) of each w neighbours.

    The choice depends on the k + w - 1 words of a window alone, so any passage
    of that length has a selected position in every document that holds it.
    """
    n = len(h)
    if n < w + k - 1:
        return np.zeros(0, np.int64)
    bits = max(1, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    key = (h & ~low) | (low - np.arange(n, dtype=np.uint64))
    m = sliding_min(key, w)
    last = np.repeat(doc_start[1:], np.diff(doc_start))[: len(m)]
    good = np.arange(len(m)) + (w + k - 1) <= last
    sel = np.zeros(n, bool)
    sel[(low - (m[good] & low)).astype(np.int64)] = True
    return np.flatnonzero(sel)

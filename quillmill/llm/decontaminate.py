"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has a Jaccard similarity near nothing, so the
items are partitioned by size (shingle count, classes a factor ``GROWTH`` apart)
and for each class the documents are seen as overlapping windows of twice the
class's largest size, half a window apart: an item's passage lies wholly in at
least one of them, and containment t becomes a Jaccard similarity of at least
t * q / (2 * u + (1 - t) * q) there, which is bounded below within a class.  A
window and an item are candidates if any of ``PERMS`` minhash values agree.
A value can only agree where the window holds the item's own minimal shingle, so
windows without such a shingle are never evaluated: same result, little work.
Candidates are verified by exact containment of the item's shingles in the
document.

An item with fewer words than a shingle is looked up by all its words: the
documents' n-grams of each such length that the benchmark has are compared with
the items' own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

SHINGLE = 5
PERMS = 24
GROWTH = 1.25
THRESHOLD = 0.5
#: Items, and characters of theirs, whose index one pass over the documents carries (some 60 MB); a larger benchmark takes several passes.
MAX_ITEMS, MAX_CHARS = 50_000, 16_000_000


def _perms(n: int) -> np.ndarray:
    return np.array([tk.mix_int(0xBE9C + i) | 1 for i in range(n)], dtype=np.uint64)


def _permute(h: np.ndarray, a: np.uint64) -> np.ndarray:
    v = h * a
    v ^= v >> np.uint64(29)
    return v * np.uint64(0x94D049BB133111EB)


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    """Which low bits the hashes have."""
    out = np.zeros(1 << max(16, int(16 * len(hashes)).bit_length()), bool)
    out[(hashes & np.uint64(len(out) - 1)).astype(np.int64)] = True
    return out


@dataclass(frozen=True)
class Index:
    """Benchmark items: ids, sorted shingle sets, and by size class the minhash values."""

    ids: list
    sets: list[np.ndarray]
    classes: list[tuple[int, np.ndarray]]  #: largest size, item numbers
    values: np.ndarray  #: (items, perms)
    minimal: np.ndarray  #: sorted shingles that are some item's minimum under some permutation
    held_from: np.ndarray  #: where each minimal shingle's items begin in ``held``, and the end
    held: np.ndarray  #: item * perms + perm, of whose values a minimal shingle is the source
    filter: np.ndarray  #: bitmap over the low bits of the minimal shingles
    shingle: int
    short: dict[int, tuple[np.ndarray, np.ndarray, list[list[int]]]]  #: words of an item, below ``shingle`` -> sorted hashes, bitmap, items of each hash; these items have no set

    @staticmethod
    def build(ids: list, texts: list[str | None], shingle: int = SHINGLE, perms: int = PERMS, growth: float = GROWTH) -> Index:
        """Of texts as textkit.lowered() gives them."""
        keep, sets = [], []
        brief: list[tuple[int, int, int]] = []  # words, hash, id
        base = 0
        for words in tk.word_chunks(pa.array(texts, pa.large_string())):
            sh, offs = tk.shingles(words, shingle)
            count = np.diff(words.doc_start)
            for i in np.flatnonzero(count >= shingle).tolist():
                keep.append(ids[base + i])
                sets.append(np.unique(sh[offs[i] : offs[i + 1]]))
            for n in np.unique(count[(count > 0) & (count < shingle)]).tolist():
                grams = tk.gram_hashes(words, n)[0]
                brief += [(n, int(grams[words.doc_start[i]]), ids[base + i]) for i in np.flatnonzero(count == n).tolist()]
            base += words.n_docs
        a = _perms(perms)
        values = np.zeros((len(sets), perms), np.uint64)
        by: dict[int, list[tuple[int, int]]] = {}
        for i, s in enumerate(sets):
            for p in range(perms):
                v = _permute(s, a[p])
                k = int(np.argmin(v))
                values[i, p] = v[k]
                by.setdefault(int(s[k]), []).append((i, p))
        minimal = np.array(sorted(by), dtype=np.uint64)
        held = np.array([i * perms + p for k in sorted(by) for i, p in by[k]], np.int64)
        held_from = np.append(0, np.cumsum([len(by[k]) for k in sorted(by)])).astype(np.int64)
        bitmap = _bitmap(minimal)
        sizes, classes = np.array([len(s) for s in sets], np.int64), []
        top = 1.0
        while len(sizes) and top < sizes.max() * growth:
            own = np.flatnonzero((sizes <= top) & (sizes > top / growth)) if top > 1 else np.flatnonzero(sizes <= 1)
            if len(own):
                classes.append((int(sizes[own].max()), own))
            top *= growth
        found: dict[int, dict[int, list[int]]] = {}
        for n, h, item_id in brief:
            found.setdefault(n, {}).setdefault(h, []).append(len(keep))
            keep.append(item_id)
        short = {}
        for n, of in sorted(found.items()):
            hashes = np.array(sorted(of), dtype=np.uint64)
            short[n] = hashes, _bitmap(hashes), [of[h] for h in sorted(of)]
        return Index(keep, sets, classes, values, minimal, held_from, held, bitmap, shingle, short)

    def _short_matches(self, words: tk.Words) -> tuple[list[int], list[int]]:
        """Documents of ``words`` and the short items whose words they hold in a row; each pair once."""
        docs: list[int] = []
        items: list[int] = []
        for n, (hashes, bitmap, of) in self.short.items():
            grams, whole = tk.gram_hashes(words, n)
            hit = np.flatnonzero(bitmap[(grams & np.uint64(len(bitmap) - 1)).astype(np.int64)] & whole)
            at = np.minimum(np.searchsorted(hashes, grams[hit]), len(hashes) - 1)
            good = hashes[at] == grams[hit]
            doc = np.searchsorted(words.doc_start, hit[good], side="right") - 1
            for d, k in np.unique(np.stack([doc, at[good]]), axis=1).T.tolist():
                docs += [d] * len(of[k])
                items += of[k]
        return docs, items

    def matches(self, col: pa.Array, threshold: float) -> tuple[np.ndarray, list[int], list[float]]:
        """Rows of col, items and containments of all verified matches."""
        rows: list[int] = []
        items: list[int] = []
        found: list[float] = []
        if not self.ids:
            return np.array(rows, np.int64), items, found
        size_of = {int(i): u for u, own in self.classes for i in own}
        a = _perms(self.values.shape[1])
        mask = np.uint64(len(self.filter) - 1)
        for words in tk.word_chunks(col):
            if self.short and threshold <= 1:
                own_docs, own_items = self._short_matches(words)
                rows += [words.lo + d for d in own_docs]
                items += own_items
                found += [1.0] * len(own_items)
            if not self.sets:
                continue
            sh, offs = tk.shingles(words, self.shingle)
            hit = np.flatnonzero(self.filter[(sh & mask).astype(np.int64)])
            if not len(hit):
                continue
            at = np.minimum(np.searchsorted(self.minimal, sh[hit]), len(self.minimal) - 1)
            same = self.minimal[at] == sh[hit]
            hit, at = hit[same], at[same]
            docs = np.searchsorted(offs, hit, side="right") - 1
            for d in np.unique(docs):
                lo, hi = int(offs[d]), int(offs[d + 1])
                cands: set[int] = set()
                seen: dict[tuple[int, int, int], np.uint64] = {}
                own = slice(*np.searchsorted(docs, [d, d + 1]))
                for pos, k in zip(hit[own].tolist(), at[own].tolist()):
                    for item, p in (divmod(x, len(a)) for x in self.held[self.held_from[k] : self.held_from[k + 1]].tolist()):
                        if item in cands:
                            continue
                        u = size_of[item]
                        for w in ((pos - lo) // u - 1, (pos - lo) // u):  # windows [w * u, w * u + 2u) of the document that hold pos
                            if w < 0:
                                continue
                            if (u, w, p) not in seen:
                                seen[u, w, p] = _permute(sh[lo + w * u : min(hi, lo + w * u + 2 * u)], a[p]).min()
                            if seen[u, w, p] == self.values[item, p]:
                                cands.add(item)
                                break
                if cands:
                    own = np.unique(sh[lo:hi])
                    for item in sorted(cands):
                        s = self.sets[item]
                        c = float((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).mean())
                        if c >= threshold:
                            rows.append(words.lo + int(d))
                            items.append(item)
                            found.append(c)
        return np.array(rows, np.int64), items, found


def indexes(benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", max_items: int = MAX_ITEMS, max_chars: int = MAX_CHARS, **params) -> list[Index]:
    """The benchmark's items, an index for each ``max_items`` or ``max_chars`` of them (an index is what a task holds).

    A benchmark is fixed and small beside the corpus; it is collected in full.
    Items without a word or without an id have nothing to find and are left out.
    All texts of an id are in one index.
    """
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), tk.lowered(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct().toArrow()
    items = sorted(zip(rows.column("i").to_pylist(), rows.column("t").to_pylist()))
    out: list[list[tuple[int, str]]] = []
    chars = 0
    for k, (i, t) in enumerate(items):
        if not out or ((len(out[-1]) >= max_items or chars >= max_chars) and i != items[k - 1][0]):
            out.append([])
            chars = 0
        out[-1].append((i, t))
        chars += len(t)
    return [Index.build([i for i, _ in part], [t for _, t in part], **params) for part in out]


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, **params) -> DataFrame:
    """(doc_id, item_id, containment) of every benchmark item of which a document holds ``threshold`` of the shingles.

    Containment is the share of the item's distinct word 5-grams (of all its
    words, where it has fewer than five) that occur in the document.

    Defined cases: null or wordless texts on either side match nothing; a document
    with a null id is reported with a null doc_id; an item id that repeats with
    several texts is reported for each of them once, with the largest containment;
    repeated documents are each reported; texts are searched whole; an empty
    benchmark or corpus gives no rows; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), tk.lowered(text_col).alias("__text"))
    out = None
    for one in indexes(benchmark, **params):
        shared = docs.sparkSession.sparkContext.broadcast(one)

        def search(batches, shared=shared):
            index = shared.value
            for batch in batches:
                rows, items, c = index.matches(batch.column(1), threshold)
                best: dict[tuple[int, int], float] = {}
                for r, i, x in zip(rows.tolist(), items, c):
                    k = (r, index.ids[i])
                    best[k] = max(x, best.get(k, 0.0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r for r, _ in best], pa.int64())), pa.array([i for _, i in best], pa.int64()), pa.array(np.round(list(best.values()), 6), pa.float64())],
                    ["doc_id", "item_id", "containment"],
                )

        part = texts.mapInArrow(search, "doc_id long, item_id long, containment double")
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, containment double")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, **params) -> DataFrame:
    """docs without those that contamination() reports; the columns stay, nothing is shuffled.

    Defined cases: rows with a null or wordless text stay; a null id does not matter;
    of repeated rows all stay or all go; texts are searched whole; an empty benchmark
    drops nothing, an empty table stays empty; other columns, whatever their names,
    are not read.
    """
    for index in indexes(benchmark, **params):
        docs = docs.where(_clean(docs.sparkSession.sparkContext.broadcast(index), threshold)(tk.lowered(text_col)))
    return docs


def _clean(shared: Broadcast, threshold: float):
    """Whether a text holds no item of a broadcast index."""

    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        good = np.ones(len(text), bool)
        good[shared.value.matches(text, threshold)[0]] = False
        return pa.array(good)

    return clean

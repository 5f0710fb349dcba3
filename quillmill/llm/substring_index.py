"""Incremental substring deduplication with a log-structured fingerprint index.

The index holds hashes of word windows of documents seen before: of each document
the windows of ``PRINT`` words that winnowing selects, so that any passage of
``LENGTH`` words has one that is selected in every document that holds it.  They
lie in immutable runs, each sorted by hash and bucketed by it, in a folder with a
manifest, so that any session can open the index and go on.

A new batch becomes a run of its own, which is merge-joined with every run of the
history (equal bucketing: no exchange, no side is broadcast) and with itself.  The
matches are verified at once: in the documents that have any, the windows of
``LENGTH`` words around matching hashes are computed from the text anew and compared
by digests of 80 bits; a window is a repeat if a document with a smaller id has it,
too.  Which hashes match is known by a Bloom filter of bounded size, and so are the
documents where they are many, so text is read, but never shuffled; what a filter lets
through by mistake is ruled out by the digests.  Places are never paired: a passage that thousands of documents share
costs no more for each of them than one that two share.

After that the run joins the history.  Runs are compacted in tiers: ``FANOUT`` runs of
a level become one of the next, so that a hash is rewritten a logarithmic number of
times.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from . import textkit as tk
from . import windows as wn
from .shared import get_bytes, list_names, materialize, new_path, put_bytes, remove

PRINT = 25
LENGTH = 50
#: Runs of a level that are merged into one of the next.
FANOUT = 3
BATCHES = 4
#: Bytes of text for which a run has a bucket at least.
BUCKET_BYTES = 256 << 20
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_RUN = "h BIGINT, doc_id BIGINT"


def _prints(batches, k: int, w: int):
    """doc_id, __text -> h, doc_id of the selected windows."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for words in tk.word_chunks(batch.column(1)):
            h, _ = tk.gram_hashes(words, k)
            pos = tk.winnow(h, words.doc_start, k, w)
            doc = np.searchsorted(words.doc_start, pos, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(h[pos].view(np.int64)), pa.array(ids[words.lo + doc])], ["h", "doc_id"])


def _windows(batches, length: int, window: int, parts: int, hashes: np.ndarray):
    """doc_id, __text -> directories, and by part the digests of all windows of ``length`` words around matching hashes."""

    def values(_, words):
        k, w = window, length - window + 1
        h, ok = tk.gram_hashes(words, length)
        other = tk.Words(words.lo, tk.mix(words.hashes * _SECOND + np.uint64(1)), words.start, words.end, words.doc_start, words.buf)
        g, _ = tk.gram_hashes(words, k)
        at = tk.winnow(g, words.doc_start, k, w)
        at = at[bloom.might_hold(hashes, g[at].view(np.int64))]
        lo = words.doc_start[np.searchsorted(words.doc_start, at, side="right") - 1]
        n = len(h) + 2
        step = np.bincount(np.maximum(at - (length - window), lo), minlength=n) - np.bincount(at + 1, minlength=n)
        return h, tk.gram_hashes(other, length)[0], ok & (np.cumsum(step)[: len(h)] > 0)

    for seg, ids, start, (h, second, near) in wn.segments(batches, values):
        rows, pos = wn.Rows(), np.flatnonzero(near)
        # Of the second hash as much is compared as is sent.
        wn.send_windows(rows, seg, ids, start, pos, [h[pos], second[pos] & np.uint64(0xFFFF)], (8, 2), wn.part_of(h[pos], parts))
        yield rows.batch()


class FingerprintIndex:
    """Sorted immutable runs of selected window hashes (h, doc_id), in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path, state
        self._tables: dict[str, str] = {}  #: run -> its name in this session's catalog

    @staticmethod
    def create(spark: SparkSession, path: str | None = None, length: int = LENGTH, window: int = PRINT, buckets: int | None = None, fanout: int = FANOUT) -> FingerprintIndex:
        """An empty index in a new folder (of the shared one, if none is given)."""
        if not 1 <= window < length:
            raise ValueError("the selected windows must be shorter than a repeat")
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        out = FingerprintIndex(
            spark,
            path or new_path(spark, "fingerprints"),
            {"length": length, "window": window, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "fanout": fanout, "top": None, "version": 0, "runs": []},
        )
        out._publish()
        return out

    @staticmethod
    def open(spark: SparkSession, path: str) -> FingerprintIndex:
        """The index of a folder as its last manifest describes it."""
        names = sorted(n for n in list_names(spark, path) if n.startswith("manifest-"))
        if not names:
            raise ValueError(f"no index in {path}")
        return FingerprintIndex(spark, path, json.loads(get_bytes(spark, f"{path}/{names[-1]}")))

    @property
    def runs(self) -> list[dict]:
        """The runs of the history: name and level."""
        return self.state["runs"]

    def _publish(self) -> None:
        """Write the next manifest; what it does not name is no part of the index."""
        self.state["version"] += 1
        put_bytes(self.spark, f"{self.path}/manifest-{self.state['version']:09d}.json", json.dumps(self.state).encode())

    def table(self, run: str) -> DataFrame:
        """A run as a bucketed table of this session."""
        if run not in self._tables:
            name = f"quillmill_run_{uuid.uuid4().hex[:12]}"
            self.spark.sql(f"CREATE TABLE {name} ({_RUN}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.state['buckets']} BUCKETS LOCATION '{self.path}/{run}'")
            self._tables[run] = name
        return self.spark.table(self._tables[run])

    def _write(self, rows: DataFrame) -> str:
        run, n = f"run-{uuid.uuid4().hex[:12]}", self.state["buckets"]
        name = f"quillmill_run_{uuid.uuid4().hex[:12]}"
        rows.repartition(n, "h").sortWithinPartitions("h").write.bucketBy(n, "h").sortBy("h").option("path", f"{self.path}/{run}").saveAsTable(name)
        self._tables[run] = name
        return run

    def _drop(self, run: str) -> None:
        if run in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(run)}")
        remove(self.spark, f"{self.path}/{run}")

    def _matches(self, run: str) -> tuple[DataFrame, str]:
        """(h, doc_id) of the selected windows of the new run and of the history that share their hash with another document."""
        new = self.table(run)
        several = new.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo != hi").select("h")
        found = new.join(several.hint("merge"), "h", "left_semi")
        for old in (self.table(r["name"]) for r in self.runs):
            found = found.union(new.join(old.select("h").hint("merge"), "h", "left_semi")).union(old.join(new.select("h").hint("merge"), "h", "left_semi"))
        return materialize(found.select("h", "doc_id"), "index-matches")

    def _verify(self, texts: DataFrame, matches: DataFrame, parts: int) -> DataFrame:
        """The repeated spans of texts (doc_id, __text) around the matches."""
        length, window = self.state["length"], self.state["window"]
        docs = matches.select("doc_id").distinct()
        some = bloom.only(texts, docs, docs.count(), "doc_id")
        hashes = self.spark.sparkContext.broadcast(bloom.build(matches.select("h"), matches.count()))
        keyed = some.select("doc_id", "__text").mapInArrow(lambda it: _windows(it, length, window, parts, hashes.value), wn.SCHEMA)
        return wn.window_spans(keyed, length, (8, 2), later_only=True)

    def add(self, texts: DataFrame, history: DataFrame | None = None, parts: int | None = None) -> DataFrame:
        """Add a batch (doc_id, __text): the spans of its documents that documents with smaller ids have, verified.

        ``history`` has the texts of the batches before, which matches with them are
        verified in; ``parts`` is into how many groups their windows are put (by
        default as many as the batch has text for).  Ids must be above those of
        earlier batches; rows without an id are left out, null texts are empty.
        """
        spark, top = self.spark, self.state["top"]
        texts = texts.where("doc_id IS NOT NULL")
        size = texts.agg(F.min("doc_id"), F.max("doc_id"), *([F.sum(F.octet_length("__text"))] if parts is None else [])).first()
        if size[0] is None:
            return spark.createDataFrame([], wn.SPANS)
        if top is not None and size[0] <= top:
            raise ValueError(f"ids of a batch must be above {top}")
        k, w = self.state["window"], self.state["length"] - self.state["window"] + 1
        run = self._write(texts.mapInArrow(lambda it: _prints(it, k, w), "h long, doc_id long"))
        matches, path = self._matches(run)
        scope = texts
        if history is not None and top is not None:
            scope = texts.union(history.select("doc_id", "__text").where(F.col("doc_id") <= top))
        # Of the history no more takes part than what matches the batch.
        spans = self._verify(scope, matches, parts or max(1, -(-(size[2] or 0) // wn.PART_BYTES)))
        out, _ = materialize(spans.where(F.col("doc_id") > top) if top is not None else spans, "index-spans")
        remove(spark, path)
        self.runs.append({"name": run, "level": 0})
        self.state["top"] = size[1]
        self._publish()
        self.compact()
        return out

    def compact(self) -> None:
        """Merge the runs of every level that has ``fanout`` of them."""
        level = 0
        while level <= max((r["level"] for r in self.runs), default=-1):
            own = [r for r in self.runs if r["level"] == level]
            if len(own) >= self.state["fanout"]:
                rows = self.table(own[0]["name"])
                for r in own[1:]:
                    rows = rows.union(self.table(r["name"]))
                merged = self._write(rows)
                self.state["runs"] = [r for r in self.runs if r not in own] + [{"name": merged, "level": level + 1}]
                self._publish()
                for r in own:
                    self._drop(r["name"])
            level += 1

    def close(self) -> None:
        """Forget this session's names of the runs; the index stays."""
        for name in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables = {}

    def delete(self) -> None:
        """Delete the index."""
        self.close()
        remove(self.spark, self.path)


def incremental_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, window: int = PRINT, batches: int = BATCHES) -> DataFrame:
    """Spans of words that documents with smaller ids hold: (doc_id, start_word, end_word, first_doc).

    The documents arrive in ``batches`` batches in the order of their ids, as they
    would day by day; the result does not depend on where the batches are cut.  A
    span is a maximal run of words covered by windows of ``length`` words that occur
    in a document with a smaller id; ``first_doc`` is the smallest id of those that
    have one of these windows.  Words are those of textkit.py (case and punctuation
    do not count), numbered from 0; end_word is exclusive.

    Defined cases: rows with a null id are left out; null, empty and short texts
    have no window; rows that repeat an id are one document when repeats are
    counted, and each has its spans reported; repeats inside one document alone are
    not reported; texts of any length are taken whole; an empty table has no spans;
    other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), tk.lowered(text_col).alias("__text")).where("doc_id IS NOT NULL")
    seen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text_col).alias("n")).agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [1.0], 10_000), F.sum("n")).first()
    cuts = sorted(set(seen[0] or [])) if batches > 1 else []
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (seen[1] or 0) // BUCKET_BYTES)
    parts = max(1, -(-(seen[1] or 0) // batches // wn.PART_BYTES))
    index, out = FingerprintIndex.create(spark, None, length, window, buckets), None
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        batch = texts
        if lo is not None:
            batch = batch.where(F.col("doc_id") > lo)
        if hi is not None:
            batch = batch.where(F.col("doc_id") <= hi)
        found = index.add(batch, texts, parts)
        out = found if out is None else out.union(found)
    index.delete()
    return out

"""URL filtering against a sorted digest array.

The blocklist becomes files in the shared folder: 64-bit xxhash keys in ascending
order, and the strings they are of, in the same order.  Tasks memory-map them,
probe with a vectorised binary search and confirm each hit by comparing the whole
stored string, so that a hash collision cannot block a page.  A file holds a range
of keys of about ``FILE_KEYS``; what a task keeps in memory is the first key of
each file and the pages of the files that it touched.

Hashing and URL parsing are Spark's built-in functions.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, new_path, remove

#: Keys in a file, about.
FILE_KEYS = 4_000_000
#: [userinfo@]host[:port]rest, after an optional scheme; the fragment is not part of it.
URL_PATTERN = "^[ \\t]*(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, URL_PATTERN, 1)), "^www[.]", "")


def normalize(url: Column) -> Column:
    """Host (lower case, without www., port and user), path and query; without fragment, trailing slashes and blanks."""
    return F.concat(host_of(url), F.regexp_replace(F.regexp_extract(url, URL_PATTERN, 2), "[/ \\t]+$", ""))


def candidates(url: Column) -> Column:
    """What a rule may name to match a URL: the URL, its host, and each parent domain of two labels or more."""
    labels = F.split(host_of(url), "[.]")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.filter(F.array_distinct(F.concat(F.array(normalize(url)), parents)), lambda x: x != "")


@dataclass(frozen=True)
class DigestArray:
    """Files of one blocklist, and the first key of each."""

    paths: tuple[str, ...]
    first: np.ndarray

    def lookup(self, keys: np.ndarray, strings: pa.Array) -> np.ndarray:
        """Whether each string, of the given key, is in the array."""
        found = np.zeros(len(keys), bool)
        if not len(self.paths) or not len(keys):
            return found
        # A key may lie at the end of one file and the start of the next.
        last = np.searchsorted(self.first, keys, side="right") - 1
        least = np.maximum(np.searchsorted(self.first, keys, side="left") - 1, 0)
        for f in np.unique(np.concatenate((last, least))):
            ix = np.flatnonzero((least <= f) & (f <= last))
            if f < 0 or not len(ix):
                continue
            stored, texts = _load(self.paths[f])
            at, end = np.searchsorted(stored, keys[ix], side="left"), np.searchsorted(stored, keys[ix], side="right")
            while True:
                live = at < end
                ix, at, end = ix[live], at[live], end[live]
                if not len(ix):
                    break
                same = pc.equal(texts.take(pa.array(at)), strings.take(pa.array(ix))).to_numpy(zero_copy_only=False)
                found[ix[same]] = True
                ix, at, end = ix[~same], at[~same] + 1, end[~same]
        return found


#: Files that a worker has open at once: mapped ones cost address space, read ones memory.
MAX_OPEN = 16
_OPEN: OrderedDict[str, tuple[np.ndarray, pa.Array]] = OrderedDict()


def _load(path: str) -> tuple[np.ndarray, pa.Array]:
    """Keys and strings of a file: mapped, where the shared folder is a mounted one, else read; the least recently used ones are let go."""
    if path in _OPEN:
        _OPEN.move_to_end(path)
    else:
        while len(_OPEN) >= MAX_OPEN:
            _OPEN.popitem(last=False)
        system, name = fs.FileSystem.from_uri(path)
        source = pa.memory_map(name) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(name)
        table = pa.ipc.open_file(source).read_all()
        _OPEN[path] = (table.column("key").chunk(0).to_numpy(), table.column("s").chunk(0))
    return _OPEN[path]


def _write(batches, folder: str):
    """key, s (sorted) -> a file for the partition: its path and first key."""
    rows = [b for b in batches if b.num_rows]
    if rows:
        table = pa.Table.from_batches(rows)
        table = pa.table({"key": table.column(0), "s": table.column(1).cast(pa.large_string())}).combine_chunks()
        path = f"{folder}/{uuid.uuid4().hex}.arrow"  # each attempt of a task writes a file of its own
        system, name = fs.FileSystem.from_uri(path)
        with system.open_output_stream(name) as out, pa.ipc.new_file(out, table.schema) as writer:
            writer.write_table(table)
        yield pa.RecordBatch.from_arrays([pa.array([path]), table.column("key").chunk(0).slice(0, 1)], ["path", "first"])


def build(spark: SparkSession, entries: DataFrame, entry_col: str = "entry") -> DigestArray:
    """The digest array of a blocklist of URLs, hosts and domains (null and empty entries are left out, repeats are one)."""
    rows = entries.select(normalize(F.col(entry_col)).alias("s")).where("s != ''").distinct().select(F.xxhash64("s").alias("key"), "s")
    rows, rows_path = materialize(rows, "digest-rows")
    n = rows.count()
    if not n:
        remove(spark, rows_path)
        return DigestArray((), np.zeros(0, np.int64))
    folder = new_path(spark, "digests")
    path = folder if "://" in folder else "file://" + folder
    system, name = fs.FileSystem.from_uri(path)
    system.create_dir(name, recursive=True)
    files = rows.repartitionByRange(-(-n // FILE_KEYS), "key").sortWithinPartitions("key", "s").mapInArrow(lambda it: _write(it, path), "path string, first long").collect()
    remove(spark, rows_path)
    files.sort(key=lambda r: r["first"])
    return DigestArray(tuple(r["path"] for r in files), np.array([r["first"] for r in files], np.int64))


def filter_urls(pages: DataFrame, digests: DigestArray, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """(page_id, blocked, rule) for every row: the most specific blocklist entry that a URL falls under, if any.

    The URL itself comes first, then its host, then its parent domains from the
    longest on.

    Defined cases: null, empty and unparsable URLs are not blocked (rule null);
    rows that repeat are each reported; a null id stays null; an empty blocklist
    blocks nothing; URLs of any length are taken whole; other columns are not read.
    """

    def probe(batches):
        for batch in batches:
            names, keys = batch.column(1), batch.column(2)
            flat = names.flatten()
            hit = digests.lookup(keys.flatten().to_numpy(zero_copy_only=False), flat)
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(names), 0).to_numpy(zero_copy_only=False))
            at = np.flatnonzero(hit)
            rows, first = np.unique(row[at], return_index=True)
            take = np.full(batch.num_rows, -1)
            take[rows] = at[first]
            blocked = take >= 0
            rule = flat.take(pa.array(take, mask=~blocked)).cast(pa.string()) if len(flat) else pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocked), rule], ["page_id", "blocked", "rule"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(candidates(F.col(url_col)), F.array().cast("array<string>")).alias("__c"))
    rows = rows.select("page_id", "__c", F.transform("__c", lambda x: F.xxhash64(x)).alias("__k"))
    return rows.mapInArrow(probe, "page_id long, blocked boolean, rule string")

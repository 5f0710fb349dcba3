"""Chunks of texts, and their results put together again in order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import encode as enc
from .wordpiece import Vocab

FIXED_CHUNK = 256 * 1024
CHUNK = 128 * 1024
_STRUCT = "array<struct<chunk_index:int,start:int,end:int,text:string>>"


def fixed_chunks(text: Column, size: int = FIXED_CHUNK) -> Column:
    """A text in chunks of ``size`` characters (code points): structs of chunk_index, start, end and text; none of an empty text."""
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    piece = lambda s, i: F.struct(i.cast("int").alias("chunk_index"), s.alias("start"), F.least(s + size, n).alias("end"), F.substring(text, s + 1, F.lit(size)).alias("text"))
    return F.transform(starts, piece)


def boundaries(text: str, size: int) -> list[tuple[int, int]]:
    """Cuts after a paragraph in the second half of a chunk, else after a sentence past its first quarter, else before a blank, else anywhere.

    What is looked for may use the character at which the chunk would end anyway, so
    a chunk that ends with a paragraph has ``size`` + 1 characters at most.
    """
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            para = text.rfind("\n\n", start + 1, end + 1)
            dot = text.rfind(". ", start + 1, end + 1)
            blank = text.rfind(" ", start + 1, end + 1)
            if para > start + size // 2:
                end = para + 2
            elif dot > start + size // 4:
                end = dot + 1
            elif blank > start:
                end = blank
        out.append((start, end))
        start = end
    return out


def boundary_chunks(text: Column, size: int = CHUNK) -> Column:
    """A text in chunks of about ``size`` characters that end at a paragraph, sentence or word where they can."""
    if size < 1:
        raise ValueError("size must be 1 or more")

    @arrow_udf(_STRUCT)
    def cut(batch: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("chunk_index", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
        rows = [None if t is None else [{"chunk_index": i, "start": a, "end": b, "text": t[a:b]} for i, (a, b) in enumerate(boundaries(t, size))] for t in batch.to_pylist()]
        return pa.array(rows, kind)

    return cut(text)


def word_chunks(text: Column, size: int = CHUNK) -> Column:
    """Chunks of at least ``size`` characters (the last may have fewer) that end only where a blank begins, so no word is cut."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{size}}}[^ \\t\\r\\n]*|.+"), F.lit(0))


def encode_chunked(docs: DataFrame, vocab: Vocab, text_col: str = "text", id_col: str = "doc_id", size: int = CHUNK, **options) -> DataFrame:
    """(doc_id, ids): encode_raw() of texts; the chunks of those longer than ``size`` are spread over all tasks.

    Equal to encode_raw() of the whole text.  Rows must have unique ids.  Short texts
    are encoded where they are read; of long ones the chunks are shuffled, and their
    ids for putting them together.
    """
    long = F.coalesce(F.length(text_col) > size, F.lit(False))
    short = docs.where(~long).select(id_col, enc.encode_raw(F.col(text_col), vocab, **options).alias("ids"))
    parts = docs.where(long).select(id_col, F.posexplode(word_chunks(F.col(text_col), size)).alias("chunk_index", "chunk"))
    parts = parts.repartition(docs.sparkSession.sparkContext.defaultParallelism, id_col, "chunk_index")
    ids = parts.select(id_col, F.struct("chunk_index", enc.encode_raw(F.col("chunk"), vocab, **options).alias("ids")).alias("c"))
    whole = ids.groupBy(id_col).agg(F.flatten(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["ids"])).alias("ids"))
    return short.union(whole)

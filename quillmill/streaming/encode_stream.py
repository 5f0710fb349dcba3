"""Tokenizing streams of files with Structured Streaming.

Encoding needs no state: a stream is a select over it.  How much is under way at
once is bounded by files per trigger and by the cluster's cores; stopping the query
cancels it.  Ids carry the chunk they are of, so that any consumer can put a file's
chunks in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunks import CHUNK, word_chunks
from ..sources.vocab import whole_text
from ..tokenizer import Tokenizer


def read_text_stream(spark: SparkSession, folder: str, max_files: int = 64) -> DataFrame:
    """(path, text) of the files of a folder, each as one text, as they arrive."""
    raw = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder, wholetext=True)
    return raw.select(F.input_file_name().alias("path"), whole_text(F.col("value")).alias("text"))


def encode_stream(texts: DataFrame, tokenizer: Tokenizer, size: int = CHUNK) -> DataFrame:
    """(path, chunk_index, ids): raw ids of each chunk; chunks end between words, so they are together those of the text."""
    parts = texts.select("path", F.posexplode(word_chunks(F.col("text"), size)).alias("chunk_index", "chunk"))
    return parts.select("path", "chunk_index", tokenizer.encode_raw(F.col("chunk")).alias("ids"))


def cancel(query: StreamingQuery, seconds: int = 60) -> None:
    """Stop a stream: what it has committed stays, and a query with the same checkpoint goes on from there."""
    query.stop()
    query.awaitTermination(seconds)


def reassemble(chunks: DataFrame) -> DataFrame:
    """(path, ids) of a table that encode_stream() filled: a path's chunks in order."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", "ids")))
    return chunks.groupBy("path").agg(F.flatten(F.transform(rows, lambda r: r["ids"])).alias("ids"))


def write_encoded(stream: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once; ``once`` stops when all that is there has been read."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()

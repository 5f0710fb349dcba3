"""Intermediate tables in the folder that all machines of a cluster share.

The folder is ``spark.checkpoint.dir``; only where a session names none (tests)
is one made.  A written table cuts lineage: what is read from it survives the
loss of any executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import new_path, shared_dir

__all__ = ["free_name", "get_bytes", "list_names", "live", "materialize", "new_path", "put_bytes", "remove", "shared_dir"]

#: Paths of the tables that this session wrote and has not removed.
_LIVE: dict[str, None] = {}


def live() -> list[str]:
    """The tables that are there now: an operator's result reads the last of its own, which its caller may remove() after use."""
    return list(_LIVE)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write df to a new table of the shared folder; the table as read again, and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df.write
    _LIVE[path] = None
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
        _LIVE.pop(path, None)


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one file through Hadoop's file system, whatever its scheme."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        for i in range(0, len(data), 1 << 24):
            out.write(bytearray(data[i : i + (1 << 24)]))
    finally:
        out.close()


def get_bytes(spark: SparkSession, path: str) -> bytes:
    """One small file, read through Hadoop's file system."""
    fs, p = _fs(spark, path)
    source = fs.open(p)
    try:
        return bytes(source.readAllBytes())
    finally:
        source.close()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if it isn't there."""
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

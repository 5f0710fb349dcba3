"""Parquet tables, read by all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files have fewer splits than there are cores.

    A small file may be a single row group, which one task reads.  A large table has
    more splits than the cluster has cores, and is read as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < cores else df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, spread()."""
    return spread(spark.read.parquet(path))

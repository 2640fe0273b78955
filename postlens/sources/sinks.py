"""Views and table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Publish a frame to SQL under ``name``; returns the frame."""
    df.createOrReplaceTempView(name)
    return df


def write_features(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Persist a feature table as parquet under ``path`` and read it back; an existing
    table is only replaced with ``mode="overwrite"``."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, by: str, buckets: int) -> DataFrame:
    """Persist a table under ``path`` in ``buckets`` files by the hash of ``by``, sorted, under a name in the
    catalog, and read it back.  Tables with equal numbers of buckets of one key join, and aggregate by
    it, without an exchange; choose the number so that a bucket fits into a task."""
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)

"""Scan-level parallelism."""

from __future__ import annotations

from pyspark.sql import DataFrame


def balance_partitions(scan: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal a file scan over ``partitions`` tasks with a round-robin shuffle, for files
    that cannot be split (one big row group, multi-line CSV) under CPU-heavy text
    work.  None, the right choice for inputs of many files, leaves the scan alone."""
    return scan.repartition(partitions) if partitions else scan

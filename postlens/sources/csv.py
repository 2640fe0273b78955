"""CSV sources for posts and comments exports (';'-separated, quoted, multi-line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..schemas import COMMENTS_SCHEMA, POSTS_SCHEMA, ROW_INDEX
from .balance import balance_partitions

CSV_OPTIONS = {
    "sep": ";",
    "header": "true",
    "multiLine": "true",
    "escape": '"',
    "mode": "PERMISSIVE",
}


def read_csv_table(spark: SparkSession, path_glob: str, schema: StructType,
                   num_partitions: int | None = None) -> DataFrame:
    """Read a glob of CSV exports with an explicit schema and drop the row index.

    ``multiLine`` makes every file one unsplittable task; for few files, name
    ``num_partitions`` to deal the rows over that many tasks right after the scan.
    """
    df = balance_partitions(spark.read.schema(schema).options(**CSV_OPTIONS).csv(path_glob), num_partitions)
    return df.drop(ROW_INDEX) if ROW_INDEX in df.columns else df


def read_posts(spark: SparkSession, path_glob: str, num_partitions: int | None = None) -> DataFrame:
    return read_csv_table(spark, path_glob, POSTS_SCHEMA, num_partitions)


def read_comments(spark: SparkSession, path_glob: str, num_partitions: int | None = None) -> DataFrame:
    return read_csv_table(spark, path_glob, COMMENTS_SCHEMA, num_partitions)

"""Session construction and lineage-cutting helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "postlens",
                  shuffle_partitions: int | None = None,
                  checkpoint_dir: str | None = None, read_partitions: int | None = None) -> SparkSession:
    """A session tuned for the library's plans.

    AQE is on so shuffle partition counts coalesce at runtime and skewed join
    partitions are split; the UI is off (no server).  ``checkpoint_dir`` is only
    applied when the cluster has not named one in ``spark.checkpoint.dir``.
    ``read_partitions``: how many partitions the registered queries deal small,
    unsplittable input files over (none by default).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # no Python call-site capture per Column operation (error messages only)
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    if read_partitions:
        conf["spark.postlens.readPartitions"] = str(read_partitions)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    if checkpoint_dir and not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", checkpoint_dir)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, named by ``spark.checkpoint.dir``.

    A session on one machine that names none gets a temporary folder of its own; on a
    cluster such a folder would not be shared, so there a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="postlens-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut_lineage(df: DataFrame, **options: str) -> DataFrame:
    """Write a table as parquet under a new name in the shared folder and read it back.

    Survives executor loss, bounds recomputation for iterative consumers such as
    cross-validation, and no two callers can meet in one name.  ``options`` go to the writer.
    """
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_test_session(tmp_root: str | None = None) -> SparkSession:
    """local[*] session used by tests and scripts on one machine."""
    tmp_root = tmp_root or os.environ.get("POSTLENS_TMP", "/tmp")
    return build_session(master="local[*]", shuffle_partitions=8, read_partitions=8,
                         checkpoint_dir=os.path.join(tmp_root, "postlens-ckpt"))

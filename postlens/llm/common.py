"""Shared helpers: input columns, word rules, tables kept in the shared folder,
and distributed connected components."""

from __future__ import annotations

import ctypes
import gc
import itertools
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.session import checkpoint_root

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): the only columns the operators read, so extra
    columns of the input never clash with result columns."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_hash(text: str = "text") -> Column:
    """Hash of a text's bytes (null as empty): with the id it names a row."""
    return F.xxhash64(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))


def as_bytes(df: DataFrame) -> DataFrame:
    """The text as UTF-8 bytes (null as empty), the form the word rules work on:
    ``bytes.split()`` cuts at exactly [\\x20\\x09-\\x0D] and ``bytes.lower()``
    changes A-Z only."""
    return df.withColumn("text", F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def fold(id_column: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % n


def per_worker(key, make):
    """What ``make()`` gives, made once in each Python worker process: Spark reuses
    workers for many tasks, so vocabularies are loaded and caches filled once."""
    store = sys.modules.setdefault("_postlens_worker_store", types.ModuleType("_postlens_worker_store")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def release_worker(*but) -> None:
    """Drop what other operators' tasks left in this Python worker, all but the keys given, and hand freed
    memory back: a worker serves one operator after the other, and what one filled would stay while
    the next works."""
    store = vars(sys.modules.get("_postlens_worker_store") or types.ModuleType(""))
    left = [k for k in store if not (isinstance(k, str) and k.startswith("__")) and k not in but]
    for key in left:
        del store[key]
    if left:
        gc.collect()  # caches hold their makers and the reverse
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


#: Size of the filter of ``may_hold``, and places that a value sets in it.
FILTER_BITS, FILTER_HASHES = 1 << 23, 4


def bits_of(column: Column) -> list[Column]:
    """The places that a value sets in a filter of FILTER_BITS bits."""
    return [F.pmod(F.xxhash64(column, F.lit(k)), F.lit(FILTER_BITS)) for k in range(FILTER_HASHES)]


def may_hold(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The rows whose ``column`` (long) may be among the values of a table of one column, and few others:
    a filter of a fixed size, whatever the number of values, so that less is moved for the exact
    join that has to follow.  It is of no help, and no harm, for values by the hundred million."""
    value = F.col(values.columns[0])
    words = values.where(value.isNotNull()).select(F.explode(F.array(*bits_of(value))).alias("bit")) \
        .groupBy(F.floor(F.col("bit") / 32).cast("int").alias("word")) \
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 32).cast("int"))).alias("bits"))
    mask = np.zeros(FILTER_BITS // 32, np.uint32)
    for word, bits in words.collect():
        mask[word] = bits
    shared = rows.sparkSession.sparkContext.broadcast(mask)
    names = rows.columns

    def let_through(batches):
        held = shared.value
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            for k in range(FILTER_HASHES):
                at = batch.column(f"bit{k}").to_numpy(zero_copy_only=False)
                ok &= (held[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1
            yield batch.filter(pa.array(ok)).select(names)

    marked = rows.where(F.col(column).isNotNull()).select(*names, *[b.alias(f"bit{k}") for k, b in enumerate(bits_of(F.col(column)))])
    return marked.mapInArrow(let_through, rows.schema)


#: While a table is written: Spark removes the shuffle files when the write has ended, and Python
#: workers get batches of so many rows, which bounds what texts and sets take in memory.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
           "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


#: Kept tables after which the driver collects its garbage.
TIDY_EVERY, _kept = 8, itertools.count(1)


def tidy(spark: SparkSession) -> None:
    """Have the driver collect its garbage.  Of each finished query some MB stay there (broadcasts of its tasks
    and small tables, plans, map statuses), and the heap would rather grow than be cleaned; what no query needs
    any more is also removed from the executors only then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared checkpoint folder under a new name and read
    it back: the lineage is cut and the rows survive lost executors.  The table goes with ``forget``."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    if next(_kept) % TIDY_EVERY == 0:
        tidy(spark)
    return out


def forget(*tables: DataFrame) -> None:
    """Remove kept tables that nothing reads any more; others, and stores that the driver has no
    other access to than Spark's, are left as they are."""
    for table in tables:
        path = getattr(table, "kept_at", None)
        if path:
            try:
                fs, place = FileSystem.from_uri(path)
                fs.delete_dir(place)
            except (OSError, pa.ArrowException):
                pass


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of (a long, b long) edges: one row (node, root) per
    node that has an edge, root = smallest node reachable.

    Each round hooks every root to the smallest root it is linked with and then
    points every node at its root's root (so chains halve); all steps are joins
    and aggregates, nothing is collected but the number of changes.  Edges whose
    ends already share a root leave the edge table.
    """
    edges = keep(edges.where("a <> b").select("a", "b").distinct(), "edges")
    label = keep(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
                 .select("node", F.col("node").alias("root")), "label")
    for k in range(max_rounds):
        # edges between current roots; at first every node is its own
        if k:
            e = (edges.join(label.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
                 .join(label.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
                 .where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
            edges, old = keep(e, "edges"), edges
            forget(old)
        if edges.isEmpty():
            forget(edges)
            return label
        hook = (edges.select(F.greatest("a", "b").alias("old"), F.least("a", "b").alias("new"))
                .groupBy("old").agg(F.min("new").alias("new")))
        hook = table = keep(hook, "hook")
        # follow the hooks to their end: they always go to a smaller node
        while True:
            nxt = (hook.alias("x").join(hook.alias("y"), F.col("x.new") == F.col("y.old"), "left")
                   .select(F.col("x.old").alias("old"), F.coalesce("y.new", "x.new").alias("new"),
                           F.col("y.new").isNotNull().alias("moved")))
            nxt = keep(nxt, "hook")
            more = not nxt.where("moved").isEmpty()
            forget(table)
            hook, table = nxt.select("old", "new"), nxt
            if not more:
                break
        label, old = keep(label.join(hook, label["root"] == hook["old"], "left")
                          .select("node", F.coalesce("new", "root").alias("root")), "label"), label
        forget(old, table)
    raise RuntimeError("components did not settle")

"""Sharding by fixed virtual slots.

Records are hashed into thousands of virtual slots, bytes are summed per slot,
and a versioned slot-to-shard map places the slots.  The map is what is stored
and edited: rebalancing or adding a shard moves a few slots and adds a version,
records never change their slot.  Everything here is DataFrame work; the only
thing folded in one row is the map itself, whose size is the number of slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postlens.llm.common import id_and_text, keep, read

N_SLOTS = 4096
ROW_OVERHEAD = 16


def sized_rows(docs: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, copy_no, virtual_slot): one row per record.

    Records equal in id, size and checksum are counted first (map-side) and then
    numbered, and the number goes into the hash, so even copies of one record
    spread over all slots.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return (rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
            .select("doc_id", "size", "text_crc32", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
                    .alias("copy_no"))
            .withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "copy_no"),
                                               F.lit(n_slots)).cast("int")))


def slot_totals(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(virtual_slot, slot_bytes, slot_rows) for every slot, empty ones included."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))
    every = rows.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(found, "virtual_slot", "left").select(
        "virtual_slot", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("slot_bytes", "slot_rows")])


def _lightest(loads: Column) -> Column:
    return (F.array_position(loads, F.array_min(loads)) - 1).cast("int")


def place(totals: DataFrame, n_shards: int, version: int = 1) -> DataFrame:
    """The first map: slots by falling size, each to the shard with the fewest
    bytes so far; (version, virtual_slot, shard, slot_bytes, slot_rows)."""
    slots = totals.agg(F.sort_array(F.collect_list(F.struct((-F.col("slot_bytes")).alias("neg"), "virtual_slot",
                                                            "slot_rows"))).alias("slots"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"),
                     F.array().cast("array<int>").alias("shards"))

    def step(state: Column, slot: Column) -> Column:
        to = _lightest(state["loads"])
        loads = F.transform(state["loads"], lambda x, i: F.when(i == to, x - slot["neg"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.array_append(state["shards"], to).alias("shards"))

    placed = slots.select("slots", F.aggregate("slots", start, step)["shards"].alias("shards"))
    return (placed.select(F.explode(F.arrays_zip("slots", "shards")).alias("z"))
            .select(F.lit(version).alias("version"), F.col("z.slots.virtual_slot").alias("virtual_slot"),
                    F.col("z.shards").alias("shard"), (-F.col("z.slots.neg")).alias("slot_bytes"),
                    F.col("z.slots.slot_rows").alias("slot_rows")))


def rebalance(slot_map: DataFrame, totals: DataFrame, n_shards: int, tolerance: float = 0.02) -> DataFrame:
    """The next version of a map for new totals and perhaps more shards.

    Each shard keeps its slots, smallest first, up to (1 + tolerance) of the even
    share; what is beyond goes, largest first, to the shard with the fewest bytes.
    So a map that is still balanced is not edited, and a new shard only takes.
    """
    version = F.col("version") + 1
    old = slot_map.select("version", "virtual_slot", "shard").join(totals, "virtual_slot")
    share = F.sum("slot_bytes").over(W.partitionBy("version")) / n_shards * (1 + tolerance)
    run = F.sum("slot_bytes").over(W.partitionBy("version", "shard").orderBy("slot_bytes", "virtual_slot")
                                   .rowsBetween(W.unboundedPreceding, 0))
    marked = old.withColumn("stays", (run <= share) & (F.col("shard") < n_shards))
    slots = marked.groupBy("version").agg(F.sort_array(F.collect_list(F.struct(
        F.when(F.col("stays"), 0).otherwise(1).alias("moves"), (-F.col("slot_bytes")).alias("neg"),
        "virtual_slot", "shard", "slot_rows"))).alias("slots"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"),
                     F.array().cast("array<int>").alias("shards"))

    def step(state: Column, slot: Column) -> Column:
        to = F.when(slot["moves"] == 0, slot["shard"]).otherwise(_lightest(state["loads"]))
        loads = F.transform(state["loads"], lambda x, i: F.when(i == to, x - slot["neg"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.array_append(state["shards"], to).alias("shards"))

    placed = slots.select("version", "slots", F.aggregate("slots", start, step)["shards"].alias("shards"))
    return (placed.select("version", F.explode(F.arrays_zip("slots", "shards")).alias("z"))
            .select(version.alias("version"), F.col("z.slots.virtual_slot").alias("virtual_slot"),
                    F.col("z.shards").alias("shard"), (-F.col("z.slots.neg")).alias("slot_bytes"),
                    F.col("z.slots.slot_rows").alias("slot_rows")))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to a stored map; earlier versions stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the newest by default."""
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version).select("version", "virtual_slot", "shard", "slot_bytes", "slot_rows")


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Put sized rows into shards: adds shard and ``slot``, the row's place in its
    shard, gapless from 0.  A place is the virtual slot's start within the shard
    (a running sum over the map) plus the row's rank in its virtual slot, so no
    window spans more than one of the thousands of slots."""
    start = F.sum("slot_rows").over(W.partitionBy("shard").orderBy("virtual_slot")
                                    .rowsBetween(W.unboundedPreceding, -1))
    # one row per virtual slot: the size bound of the broadcast
    starts = slot_map.select("virtual_slot", "shard", F.coalesce(start, F.lit(0).cast("long")).alias("start"))
    rank = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", "copy_no")) - 1
    return (rows.withColumn("rank", rank).join(F.broadcast(starts), "virtual_slot")
            .withColumn("slot", F.col("start") + F.col("rank")))


def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, id_col: str = "doc_id",
          text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """Shards 0 to n_shards - 1 of nearly equal bytes (law ``bytes``): doc_id, size
    (UTF-8 bytes + 16), text_crc32, law, shard, slot, grown_shard (null: it belongs
    to the law ``key``), virtual_slot.

    A null text has no bytes and the checksum of the empty text; null ids and
    repeated rows are records like others (copies spread over the slots); an empty
    table gives an empty result.  ``map_path``: also store the map there.
    """
    rows = keep(sized_rows(docs, n_slots, id_col, text_col), "sized")
    slot_map = keep(place(slot_totals(rows, n_slots), n_shards), "slot-map")
    if map_path:
        save_map(slot_map, map_path)
    return assign(rows, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))

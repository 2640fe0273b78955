"""posts / comments built from the shared test tables.

The test data has no social-media tables, so ``posts`` and ``comments`` are
derived from ``documents``, ``orders``, ``events`` and ``conversations`` by a
fixed rule.  Each view exists twice, as a Spark plan and as DuckDB SQL, and the
two definitions below must stay in step: the SQL is the oracle side of every
correctness check.

posts: documents d JOIN orders o ON o_orderkey = doc_id JOIN events e ON
event_id = doc_id.  post_timestamp is the order date plus the event's time of
day (order dates are all midnight), likes are the floored order price,
the event type drives the picture/video flags, and urgent fulfilled orders
carry a location.

comments: conversations, one comment per turn.  The texts hold no emoji,
emoticons, URLs or mentions, so a suffix chosen by (conv_id + turn) % 8 is
appended; verification strings cycle through the messy literals seen in real
exports, and about one comment in 37 has no post_id.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .balance import balance_partitions

# FIXED VALUES: comment decorations by (conv_id + turn) % 8, and verification
# strings by (conv_id + turn) % 6 (5 -> null; role 'system' -> 'pending').
COMMENT_SUFFIXES = (" 😍😍 great", " 😭 awful", " it's 10:30", " https://a.b",
                    " :-)", " @you @me", " ❤ bad", "")
VERIFIED_VALUES = ("True", "1.0", "False", "0.0", "Not found")
NULL_POST_MOD = 37


def table(spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None) -> DataFrame:
    return balance_partitions(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"), partitions)


def _case(key: F.Column, values) -> F.Column:
    expr = None
    for i, v in enumerate(values):
        cond = key == F.lit(i)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr


def posts_view(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    d = table(spark, sf_dir, "documents", partitions).select("doc_id", "text", "source")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    j = d.join(o, d.doc_id == o.o_orderkey).join(e, d.doc_id == e.event_id)
    secs = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    located = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    return j.select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.col("source").alias("profile_name"),
        F.timestamp_add("SECOND", secs, F.col("o_orderdate")).alias("post_timestamp"),
        F.col("text").alias("post_text"),
        F.when(F.col("event_type") == "click", F.pmod(F.col("o_custkey"), F.lit(3)) + 2)
         .otherwise(F.lit(1)).cast("int").alias("nbr_pictures"),
        (F.col("event_type") == "click").alias("is_multiple_pictures"),
        F.when(located, F.concat(F.lit("https://maps.google.com/?cid="), F.col("o_custkey").cast("string")))
         .alias("google_maps_url"),
        F.when(located, F.concat(F.lit("loc"), F.pmod(F.col("o_custkey"), F.lit(5)).cast("string")))
         .alias("location"),
        F.floor("o_totalprice").cast("bigint").alias("nbr_likes"),
        F.floor("value").cast("bigint").alias("nbr_comments"),
        F.when(F.col("event_type") == "view", F.lit("True\r")).otherwise(F.lit("False\r")).alias("is_video"),
    )


def comments_view(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    return comments_from_conversations(table(spark, sf_dir, "conversations", partitions))


def comments_from_conversations(c: DataFrame) -> DataFrame:
    """Row-by-row mapping of conversation turns to comments."""
    k8 = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(8))
    k6 = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6))
    cid = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(
        cid.alias("comment_id"),
        F.pmod(F.col("conv_id") * 31 + F.col("turn") * 7, F.lit(1000)).alias("commenter_id"),
        F.when(F.col("role") == "system", F.lit("pending"))
         .otherwise(_case(k6, VERIFIED_VALUES)).alias("commenter_verified"),
        F.when(F.pmod(cid, F.lit(NULL_POST_MOD)) == NULL_POST_MOD - 1, F.lit(None).cast("string"))
         .otherwise(F.col("conv_id").cast("string")).alias("post_id"),
        F.concat(F.col("text"), _case(k8, COMMENT_SUFFIXES)).alias("comment_text"),
        F.timestamp_seconds(F.lit(1706745600) + F.col("conv_id") * 3600 + F.col("turn") * 60)
         .alias("comment_timestamp"),
    )


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_case(key: str, values) -> str:
    return "CASE " + key + " " + " ".join(
        f"WHEN {i} THEN {_sql_str(v)}" for i, v in enumerate(values)) + " END"


# DuckDB definitions of the same two views, used as CTEs by the oracle SQL.
POSTS_SQL = f"""
SELECT CAST(d.doc_id AS VARCHAR) AS post_id,
       d.source AS profile_name,
       o.o_orderdate + to_seconds(CAST(hour(e.ts) * 3600 + minute(e.ts) * 60 + second(e.ts) AS BIGINT))
         AS post_timestamp,
       d.text AS post_text,
       CAST(CASE WHEN e.event_type = 'click' THEN o.o_custkey % 3 + 2 ELSE 1 END AS INTEGER) AS nbr_pictures,
       (e.event_type = 'click') AS is_multiple_pictures,
       CASE WHEN o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'F'
            THEN 'https://maps.google.com/?cid=' || CAST(o.o_custkey AS VARCHAR) END AS google_maps_url,
       CASE WHEN o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'F'
            THEN 'loc' || CAST(o.o_custkey % 5 AS VARCHAR) END AS location,
       CAST(floor(o.o_totalprice) AS BIGINT) AS nbr_likes,
       CAST(floor(e.value) AS BIGINT) AS nbr_comments,
       CASE WHEN e.event_type = 'view' THEN 'True' || chr(13) ELSE 'False' || chr(13) END AS is_video
FROM documents d
JOIN orders o ON o.o_orderkey = d.doc_id
JOIN events e ON e.event_id = d.doc_id
"""

COMMENTS_SQL = f"""
SELECT conv_id * 1000 + turn AS comment_id,
       (conv_id * 31 + turn * 7) % 1000 AS commenter_id,
       CASE WHEN role = 'system' THEN 'pending'
            ELSE {_sql_case('(conv_id + turn) % 6', VERIFIED_VALUES)} END AS commenter_verified,
       CASE WHEN (conv_id * 1000 + turn) % {NULL_POST_MOD} = {NULL_POST_MOD - 1} THEN NULL
            ELSE CAST(conv_id AS VARCHAR) END AS post_id,
       text || {_sql_case('(conv_id + turn) % 8', COMMENT_SUFFIXES)} AS comment_text
FROM conversations
"""


def with_views(sql_body: str, posts: bool = True, comments: bool = True) -> str:
    """Prefix an oracle query with the posts/comments CTEs it needs."""
    ctes = []
    if posts:
        ctes.append(f"posts AS ({POSTS_SQL})")
    if comments:
        ctes.append(f"comments AS ({COMMENTS_SQL})")
    body = sql_body.strip()
    if re.match(r"(?i)with\s", body):
        # merge the caller's own CTE list with ours
        ctes.append(body[4:].lstrip())
        return "WITH " + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body

"""Typed schemas of the two inputs: posts and comments (1:N on post_id)."""

from pyspark.sql.types import (BooleanType, IntegerType, LongType, StringType,
                               StructField, StructType, TimestampType)

# Row index column written by the exporter; dropped at the source.
ROW_INDEX = "_c0"

POSTS_SCHEMA = StructType([
    StructField(ROW_INDEX, IntegerType(), True),
    StructField("post_id", StringType(), True),
    StructField("profile_name", StringType(), True),
    StructField("post_timestamp", TimestampType(), True),
    StructField("post_text", StringType(), True),
    StructField("nbr_pictures", IntegerType(), True),
    StructField("is_multiple_pictures", BooleanType(), True),
    StructField("google_maps_url", StringType(), True),
    StructField("location", StringType(), True),
    StructField("nbr_likes", LongType(), True),
    StructField("nbr_comments", LongType(), True),
    StructField("is_video", StringType(), True),
])

COMMENTS_SCHEMA = StructType([
    StructField(ROW_INDEX, IntegerType(), True),
    StructField("comment_id", LongType(), True),
    StructField("commenter_id", LongType(), True),
    StructField("commenter_verified", StringType(), True),
    StructField("post_id", StringType(), True),
    StructField("comment_text", StringType(), True),
    StructField("comment_timestamp", TimestampType(), True),
])

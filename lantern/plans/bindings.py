"""The catalog's tables as views of the driver tables. Every binding is arithmetic on keys, so SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_files(spark: SparkSession, d: str) -> DataFrame:
    """events as files: every seventh is missing, heights are 1, 2, 4 or 0."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("file_id"),
        F.when(F.col("event_id") % 2 == 0, "photo").otherwise("video").alias("media_type"),
        F.when(F.col("event_id") % 7 == 0, "missing").otherwise("active").alias("status"),
        F.col("ts").alias("taken_at"),
        F.when(F.col("event_id") % 11 != 0, (F.col("user_id") % 8).cast("int")).alias("width"),
        F.when(F.col("event_id") % 5 == 0, F.lit(0)).otherwise(F.expr("shiftleft(1, cast(event_id % 3 as int))")).alias("height"),
        F.col("user_id").alias("volume_id"),
        "event_type",
        (F.col("event_id") * 1000 + F.col("user_id")).alias("size_bytes"),
        (F.col("event_id") * 1_000_003).alias("mtime_ns"),
    )


def event_locked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("file_id"))


FILES_SQL = """files AS (SELECT event_id AS file_id, CASE WHEN event_id % 2 = 0 THEN 'photo' ELSE 'video' END AS media_type,
 CASE WHEN event_id % 7 = 0 THEN 'missing' ELSE 'active' END AS status, ts AS taken_at,
 CASE WHEN event_id % 11 <> 0 THEN CAST(user_id % 8 AS INTEGER) END AS width,
 CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(1 << CAST(event_id % 3 AS INTEGER) AS INTEGER) END AS height,
 user_id AS volume_id, event_type, event_id * 1000 + user_id AS size_bytes, event_id * 1000003 AS mtime_ns FROM events),
 locked AS (SELECT event_id AS file_id FROM events WHERE event_type = 'error'),
 visible AS (SELECT * FROM files WHERE status = 'active' AND taken_at IS NOT NULL AND file_id NOT IN (SELECT file_id FROM locked))"""

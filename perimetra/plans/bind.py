"""The tables of one folder, read as the domain's tables.

events are trajectories: a user is a track, seen by camera user_id % 6 on one day; value and the number k in props are
the point. orders are alerts, customers cameras, nations posts, regions sectors. embeddings are keyframes, label their clip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimetra.sources.store import settled  # noqa: F401

TRACK = ["camera_id", "track_id", "day"]

#: The same trajectories in SQL, for the statements of the queries.
POINTS_SQL = """
pts AS (
  SELECT CAST(user_id % 6 AS BIGINT) AS camera_id, user_id AS track_id, CAST(ts AS DATE) AS day, event_id AS seq,
    epoch_us(ts) / 1000000.0::DOUBLE AS t, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_type AS class_name
  FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """camera_id, track_id, day, seq, t (epoch seconds), x, y, class_name."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 6).alias("camera_id"),
        F.col("user_id").alias("track_id"),
        F.to_date(ts).alias("day"),
        F.col("event_id").alias("seq"),
        (F.unix_micros(ts) / 1e6).alias("t"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        F.col("event_type").alias("class_name"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, camera_id, stage, captured_at, total, priority, seq."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("camera_id"),
        F.col("o_orderstatus").alias("stage"),
        F.col("o_orderdate").cast("timestamp").alias("captured_at"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderkey").alias("seq"),
    )


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, sector, post_id."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"), F.col("c_nationkey").alias("post_id"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region_id"))

"""Views of the given tables in the engine's own shapes, each in Spark and, word for word, in SQL.

A track is a user's events by eight-hour frames: the first event of a frame gives its row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COURT_WIDTH, COURT_LENGTH, NET_Y = 6.10, 13.40, 6.70


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, frame_id, timestamp, x, y, visibility, confidence, event_id)"""
    e = table(spark, sf_dir, "events")
    time = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")  # whole seconds would be cut towards 2024
    eight_hours = F.lit(28_800_000_000)
    frame = F.call_function("div", time - F.pmod(time, eight_hours), eight_hours)
    order = F.col("event_id").isNull().alias("without_id")  # these come last
    rows = e.select(F.col("user_id").alias("k"), frame.alias("frame_id"), F.struct(order, "event_id", "event_type", "value", "props").alias("e"))
    first = rows.groupBy("k", "frame_id").agg(F.min("e").alias("e"))
    kind = F.col("e.event_type")
    confidence = F.when(kind == "view", 0.9).when(kind == "click", 0.6).when(kind == "purchase", 0.4).when(kind == "signup", 0.15).otherwise(0.5)
    return first.select(
        "k", "frame_id", (F.col("frame_id") * 0.4).alias("timestamp"), F.col("e.value").alias("x"), F.get_json_object("e.props", "$.k").cast("double").alias("y"),
        F.when(kind == "error", 0).otherwise(1).alias("visibility"), confidence.alias("confidence"), F.col("e.event_id").alias("event_id"), kind.alias("event_type"),
    )


TRACK = """
frames AS (
  SELECT user_id AS k, CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 28800.0) AS BIGINT) AS frame_id, event_id, event_type, value, props FROM events
), track AS (
  SELECT k, frame_id, frame_id * 0.4::DOUBLE AS timestamp, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y,
    CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS visibility,
    CASE event_type WHEN 'view' THEN 0.9::DOUBLE WHEN 'click' THEN 0.6::DOUBLE WHEN 'purchase' THEN 0.4::DOUBLE WHEN 'signup' THEN 0.15::DOUBLE ELSE 0.5::DOUBLE END AS confidence, event_id, event_type
  FROM frames QUALIFY row_number() OVER (PARTITION BY k, frame_id ORDER BY event_id) = 1
)"""


def player(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track with court_x, court_y, player_id, rally_id."""
    t = track(spark, sf_dir)
    t = t.withColumns({"court_x": F.col("y") / 99 * COURT_WIDTH, "court_y": F.col("x") % COURT_LENGTH})
    return t.withColumns({"player_id": F.when(F.col("court_y") >= NET_Y, "near").otherwise("far"), "rally_id": F.lpad(F.col("k").cast("string"), 3, "0")})


PLAYER = (
    TRACK
    + """, player AS (
  SELECT *, CASE WHEN court_y >= 6.7::DOUBLE THEN 'near' ELSE 'far' END AS player_id, lpad(CAST(k AS VARCHAR), 3, '0') AS rally_id
  FROM (SELECT *, y / 99 * 6.10::DOUBLE AS court_x, x % 13.40::DOUBLE AS court_y FROM track)
)"""
)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track with main_view_score, is_main_view and reject_reason."""
    t = track(spark, sf_dir).withColumn("main_view_score", F.least(F.lit(1.0), F.col("x") / 100))
    reason = F.when(F.col("event_type") == "error", "no_court").when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    return t.withColumns({"is_main_view": F.col("main_view_score") >= 0.5, "reject_reason": reason})


SAMPLES = (
    TRACK
    + """, samples AS (
  SELECT *, main_view_score >= 0.5::DOUBLE AS is_main_view, CASE event_type WHEN 'error' THEN 'no_court' WHEN 'view' THEN '' ELSE event_type END AS reject_reason
  FROM (SELECT *, least(1.0::DOUBLE, x / 100) AS main_view_score FROM track)
)"""
)

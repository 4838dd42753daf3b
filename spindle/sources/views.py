"""Views of the event stream as media features, the same expressions for Spark and for SQL.

Every event is a single-shot media item of its user's project; its features are
rational functions of its id, so both engines see the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PHOTO = "event_type IN ('purchase', 'error')"
MEDIA = {
    "project_id": "user_id",
    "media_id": "event_id",
    "source_id": "event_id % 50",
    "ts": "ts",
    "media_type": f"CASE WHEN {_PHOTO} THEN 'photo' ELSE 'video' END",
    "width": "CASE WHEN event_id % 3 = 0 THEN 1080 ELSE 1920 END",
    "height": "CASE WHEN event_id % 3 = 0 THEN 1920 ELSE 1080 END",
    "sharpness": "CAST((event_id * 37) % 101 AS DOUBLE) / 100",
    "exposure": "CAST((event_id * 53) % 97 AS DOUBLE) / 96",
    "stability": f"CASE WHEN {_PHOTO} THEN CAST(1 AS DOUBLE) ELSE CAST((event_id * 71) % 89 AS DOUBLE) / 88 END",
    "face_score": "CAST((event_id * 29) % 83 AS DOUBLE) / 82",
    "motion_intensity": f"CASE WHEN {_PHOTO} THEN CAST(0 AS DOUBLE) ELSE CAST((event_id * 43) % 79 AS DOUBLE) / 78 END",
    "duration_ms": f"CASE WHEN {_PHOTO} THEN CAST(4000 AS BIGINT) ELSE CAST(1000 + floor(value * 20) AS BIGINT) END",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def media(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """``events``: the table's rows, where they were dealt out beforehand."""
    return (table(spark, sf_dir, "events") if events is None else events).selectExpr(*[f"{e} AS {n}" for n, e in MEDIA.items()])


def media_sql() -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in MEDIA.items()) + " FROM events"

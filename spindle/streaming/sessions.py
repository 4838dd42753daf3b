"""Sessions over a stream: an extension, the same gap rule as the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_windows(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of each session, once the watermark has passed it."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    found = timed.groupBy(key, F.session_window("__ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("__ts").alias("last"))
    return found.select(key, F.col("w.start").alias("start"), F.col("last").alias("end"), "n")

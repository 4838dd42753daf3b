"""Joins of two tables on time: rows within intervals, and the nearest rows before and after.

Both deal a key's rows out by time, so a track or a project that holds a third of
all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], t: str, start: str, end: str, width: float = 60.0) -> DataFrame:
    """Every point with each interval of its keys that holds it, start <= t < end: the columns of both.

    An equi-join on buckets of time. Intervals have levels: at level n buckets
    are ``width * 2 ** n`` wide, and an interval is of the first level whose
    buckets are as wide as it, so it lies in two of them at most, however long it
    is. A point looks into one bucket of each level that there is (their number
    follows from the span of lengths, not of rows). Intervals that end before they begin hold
    nothing; null times and keys meet nothing.
    """
    length = F.col(end) - F.col(start)
    level = F.greatest(F.lit(0), F.ceil(F.log2(length / width))).cast("int")
    rows = intervals.filter(length > 0).withColumn("__level", level)
    levels = sorted(r[0] for r in rows.select("__level").distinct().collect())  # some dozens, whatever the input

    def bucket(value: Column, level: Column) -> Column:
        return F.floor(value / (F.pow(F.lit(2.0), level) * width)).cast("bigint")

    # ``end`` itself is outside; a bucket that only it touches is looked into in vain.
    rows = rows.withColumn("__bucket", F.explode(F.sequence(bucket(F.col(start), F.col("__level")), bucket(F.col(end), F.col("__level")))))
    each = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__bucket", bucket(F.col(t), F.col("__level")))
    return each.join(rows, [*keys, "__level", "__bucket"]).filter((F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))).drop("__level", "__bucket")


def first_interval(points: DataFrame, intervals: DataFrame, keys: Sequence[str], ids: Sequence[str], t: str, start: str, end: str, value: str, width: float = 60.0) -> DataFrame:
    """``points`` (one row for each ``ids``) with ``value`` of the first interval by its start that holds them; null outside all."""
    held = interval_join(points.select(*dict.fromkeys([*keys, *ids, t])), intervals.select(*keys, start, end, value), keys, t, start, end, width)
    first = held.groupBy(*ids).agg(F.min(F.struct(F.col(start), F.col(end), F.col(value).alias("__value"))).alias("__f"))
    return points.join(first.select(*ids, F.col("__f.__value").alias(value)), list(ids), "left")


def around(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, values: Sequence[str] = (), width: float = 60.0) -> DataFrame:
    """``left`` with structs ``before`` and ``after`` (t and ``values``): the last row of ``right`` earlier than t, the first one not earlier.

    Time is cut into buckets of ``width``. What a bucket's rows may need of
    earlier and later ones is one row of each, found over a table with a row per
    bucket; these are added to the bucket, and a window within it does the rest.
    Of rows of ``right`` at the same time the one with the least ``values`` counts
    as the first. Rows of ``left`` without a time have neither; rows of ``right`` without one are none.
    """
    row = F.struct(F.col(t).cast("double").alias("t"), *[F.col(v) for v in values])
    bucket = F.floor(F.col(t) / width).cast("bigint").alias("__bucket")
    own = [F.col(k) for k in keys]
    held = right.filter(F.col(t).isNotNull()).select(*own, bucket, row.alias("__row"))
    asked = left.select(*own, bucket, F.struct(*[F.col(c) for c in left.columns]).alias("__left"), F.col(t).cast("double").alias("__t"))

    ends = held.groupBy(*keys, "__bucket").agg(F.min("__row").alias("__min"), F.max("__row").alias("__max"))
    every = ends.unionByName(asked.select(*own, "__bucket").distinct(), allowMissingColumns=True)
    every = every.groupBy(*keys, "__bucket").agg(F.max("__min").alias("__min"), F.max("__max").alias("__max"))
    w = Window.partitionBy(*keys).orderBy("__bucket")
    earlier = F.last("__max", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    later = F.first("__min", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    every = every.withColumn("__earlier", earlier).withColumn("__later", later)
    carried = every.select(*own, "__bucket", F.explode(F.array("__earlier", "__later")).alias("__row")).filter("__row IS NOT NULL")

    both = held.unionByName(carried).withColumn("__t", F.col("__row.t")).unionByName(asked, allowMissingColumns=True)
    # At one time rows of ``left`` come first: what is before them is earlier, what is after is not.
    w = Window.partitionBy(*keys, "__bucket").orderBy("__t", F.col("__left").isNull(), F.col("__row"))
    before = F.last("__row", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__row", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    known = F.col("__t").isNotNull()
    out = both.withColumn("before", F.when(known, before)).withColumn("after", F.when(known, after)).filter("__left IS NOT NULL")
    return out.select("__left.*", "before", "after")


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, width: float = 60.0) -> DataFrame:
    """``left`` with ``near``, the nearest time of ``right``, the earlier of equals, and ``distance``; null where the key has none."""
    found = around(left, right, keys, t, width=width)
    back, on = F.col(t) - F.col("before.t"), F.col("after.t") - F.col(t)
    near = F.when(back.isNull() | (on < back), F.col("after.t")).otherwise(F.col("before.t"))
    return found.withColumn("near", near).withColumn("distance", F.abs(F.col("near") - F.col(t))).drop("before", "after")


def interpolated(left: DataFrame, curve: DataFrame, keys: Sequence[str], t: str, value: str, otherwise: float = 0.5, width: float = 60.0) -> DataFrame:
    """``left`` with ``value``: linear between the points of its key's curve, flat beyond its ends, ``otherwise`` without any."""
    found = around(left, curve, keys, t, [value], width)
    a, b = F.col("before"), F.col("after")
    between = a[value] + (b[value] - a[value]) * ((F.col(t) - a["t"]) / (b["t"] - a["t"]))
    there = F.when(a.isNull() & b.isNull(), F.lit(otherwise)).when(a.isNull(), b[value]).when(b.isNull(), a[value]).otherwise(between)
    return found.withColumn(value, F.when(F.col(t).isNotNull(), there)).drop("before", "after")

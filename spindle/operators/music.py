"""Structure of music tracks from their loudness, beats and chroma."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.operators import streams
from spindle.operators.sequence import exact_mean, islands, min_gap_fold


def downbeats(beats: Column) -> Column:
    """Every fourth beat, from the first."""
    return F.filter(beats, lambda _, i: i % 4 == 0)


def frames_a_second(rms: DataFrame, keys: Sequence[str], frame: str, t: str) -> DataFrame:
    """Per track the frames of about a second, by the time between its first two; 0.023 s where there is one frame."""
    w = Window.partitionBy(*keys).orderBy(frame)
    hops = rms.select(*keys, (F.lead(t).over(w) - F.col(t)).alias("__hop"), F.row_number().over(w).alias("__n")).filter("__n = 1")
    return hops.select(*keys, F.greatest(F.lit(1), (F.lit(1.0) / F.coalesce("__hop", F.lit(0.023))).cast("int")).alias("per_point"))


def energy_curve(rms: DataFrame, keys: Sequence[str], frame: str, t: str, value: str, per_point: int | None = None) -> DataFrame:
    """Mean loudness of blocks of ``per_point`` frames (by default a second's), as a share of the track's loudest; time of the block's first frame."""
    if per_point is None:
        rms = rms.join(frames_a_second(rms, keys, frame, t), list(keys))
    per_point = F.col("per_point") if per_point is None else F.lit(per_point)
    top = F.max(value).over(Window.partitionBy(*keys))
    share = F.when(top > 0, F.col(value) / top).otherwise(F.col(value))
    rows = rms.select(*keys, F.floor(F.col(frame) / per_point).cast("bigint").alias("block"), t, F.floor(share * 1000000 + 0.5).cast("bigint").alias("__v"))
    return rows.groupBy(*keys, "block").agg(F.min(t).alias("t"), (F.sum("__v").cast("double") / F.count("*") / 1000000).alias("energy"))


def high_energy_ranges(rms: DataFrame, keys: Sequence[str], frame: str, t: str, value: str, share: float = 0.75, least_sec: float = 2.0) -> DataFrame:
    """Runs above the track's percentile that last at least ``least_sec``."""
    bar = rms.groupBy(*keys).agg(F.percentile(value, share).alias("__bar"))  # a row for each track
    marked = rms.join(bar, list(keys)) if keys else rms.crossJoin(F.broadcast(bar))
    return islands(marked, keys, [frame], F.col(value) > F.col("__bar"), t).filter(F.col("end") - F.col("start") >= least_sec)


def merge_boundaries(points: Column, min_sec: float, most: int = 9) -> Column:
    """Kept by the fold from 0.0; of more than ``most``, as many at even places."""
    kept = min_gap_fold(points, min_sec, 0.0)
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(kept, (F.floor(i * (F.size(kept) - 1) / (most - 1)) + 1).cast("int")))
    return F.when(F.size(points) < 2, points).when(F.size(kept) > most, even).otherwise(kept)


def change_boundaries(rms: DataFrame, keys: Sequence[str], frame: str, t: str, value: str, duration: str | None = None, window: int = 50, share: float = 85.0, gap: float = 8.0) -> DataFrame:
    """(keys, bounds, duration): times where smoothed loudness changes most, at least ``gap`` apart, from 0.0.

    The window is at most a quarter of the track; beyond its ends it is silent.
    Tracks of under 10 frames, or without such a change, are of one piece.
    """
    length = F.col(duration) if duration else F.max(t).over(Window.partitionBy(*keys))
    rows = rms.select(*keys, F.col(frame).alias("__frame"), F.col(t).cast("double").alias("__t"), F.col(value).cast("double").alias("__v"), length.cast("double").alias("duration"))

    def one(part: dict) -> dict[str, list]:
        loud, times, end = np.asarray(part["__v"], float), part["__t"], float(part["duration"][0])
        wide, bounds = min(window, len(loud) // 4), [0.0]
        peaks = np.empty(0, np.int64)
        if len(loud) >= 10 and wide >= 3:
            change = np.abs(np.diff(np.convolve(loud, np.ones(wide) / wide, mode="same")))
            # Changes that are equal but for rounding are equal here: sums may be added up in any order.
            change = np.round(change / (change.max() or 1.0), 9)
            peaks = np.flatnonzero(change > np.round(np.percentile(change, share), 9))
        for p in peaks:
            if times[p] - bounds[-1] >= gap:
                bounds.append(float(times[p]))
        return {"bounds": [bounds if len(peaks) else [0.0, end]], "duration": [end]}

    return streams.per_key(rows, keys, [F.col("__frame").asc_nulls_last(), "__t"], one, "bounds array<double>, duration double")


def detect_sections(rms: DataFrame, keys: Sequence[str], frame: str, t: str, value: str, points: DataFrame | None = None, duration: str | None = None) -> DataFrame:
    """Labelled sections of each track: at its structural ``points`` (keys, points) merged to 6 s, else where its loudness changes."""
    bounds = change_boundaries(rms, keys, frame, t, value, duration)
    if points is not None:
        merged = points.select(*keys, merge_boundaries(F.col("points"), 6.0).alias("__merged"))
        bounds = bounds.join(merged, list(keys), "left").withColumn("bounds", F.coalesce("__merged", "bounds")).drop("__merged")
    return label_sections(sections(bounds, rms, keys, t, value), keys)


def chorus_repeats(found: DataFrame, chroma: DataFrame, keys: Sequence[str], t: str, vector: str, bar: float = 0.85) -> DataFrame:
    """(keys, idx, grp, repeat_index) of the choruses among labelled sections: alike ones by the cosine of their mean chroma."""
    own = found.filter("label = 'chorus'").select(*keys, "idx", "start", "end")
    # A track has few choruses: each frame finds its own in an array.
    arrays = own.groupBy(*keys).agg(F.collect_list(F.struct("idx", "start", "end")).alias("__c"))
    placed = chroma.join(arrays, list(keys)).withColumn("idx", F.get(F.filter("__c", lambda s: (s["start"] <= F.col(t)) & (F.col(t) < s["end"])), F.lit(0))["idx"]).filter("idx IS NOT NULL")
    means = placed.select(*keys, "idx", F.posexplode(vector).alias("__at", "__x")).groupBy(*keys, "idx", "__at").agg(exact_mean(F.col("__x").cast("double")).alias("__x"))
    vectors = means.groupBy(*keys, "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__x"))), lambda p: p["__x"]).alias("__v"))
    every = own.select(*keys, "idx").join(vectors, [*keys, "idx"], "left").withColumn("__v", unit(F.coalesce("__v", F.array().cast("array<double>"))))
    packed = every.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "__v"))).alias("__all"))
    out = packed.withColumn("__g", leader_groups(F.transform("__all", lambda a: a["__v"]), bar))
    return out.select(*keys, F.explode(F.zip_with("__all", "__g", lambda a, g: F.struct(a["idx"].alias("idx"), g["grp"].alias("grp"), g["repeat_index"].alias("repeat_index")))).alias("r")).select(*keys, "r.*")


def unit(vector: Column) -> Column:
    """A vector of length 1; one of zeros stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))


def sections(bounds: DataFrame, rms: DataFrame, keys: Sequence[str], t: str, value: str) -> DataFrame:
    """Sections (keys, idx, start, end, avg_energy, only) between bounds (keys, bounds, duration), energy over [start, end), 0.5 without any.

    A track all of whose sections are under a second is one section, ``only``.
    """
    every = F.array_sort(F.array_distinct(F.concat("bounds", F.array("duration"))))
    every = F.when(F.element_at(every, 1) > 0.5, F.concat(F.array(F.lit(0.0)), every)).otherwise(every)
    at = F.when(F.size("__all") > 1, F.sequence(F.lit(1), F.size("__all") - 1)).otherwise(F.array().cast("array<int>"))
    long = F.filter(F.transform(at, lambda i: F.struct(F.element_at("__all", i).alias("start"), F.element_at("__all", i + 1).alias("end"), F.lit(False).alias("only"))), lambda s: s["end"] - s["start"] >= 1.0)
    one = F.array(F.struct(F.lit(0.0).alias("start"), F.col("duration").alias("end"), F.lit(True).alias("only")))
    cut = bounds.withColumn("__all", every).withColumn("__long", long).select(*keys, F.explode(F.when(F.size("__long") > 0, F.col("__long")).otherwise(one)).alias("s"))
    cut = cut.select(*keys, "s.start", "s.end", "s.only")
    top = F.max(value).over(Window.partitionBy(*keys))
    share = rms.select(*keys, t, F.floor(F.when(top > 0, F.col(value) / top).otherwise(F.col(value)) * 1000000 + 0.5).cast("bigint").alias("__v"))
    # Sections don't overlap: a row's own is the last that begins at or before it, if that goes on so long.
    span = F.struct("start", "end")
    begins = cut.select(*keys, F.col("start").alias("__at"), F.lit(0).alias("__kind"), span.alias("__begun"), F.lit(None).cast("bigint").alias("__v"))
    placed = begins.unionByName(share.select(*keys, F.col(t).cast("double").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(begins.schema["__begun"].dataType).alias("__begun"), "__v"))
    before = Window.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("__mine", F.last("__begun", ignorenulls=True).over(before)).filter((F.col("__kind") == 1) & (F.col("__at") < F.col("__mine.end")))
    energy = placed.groupBy(*keys, F.col("__mine.start").alias("start")).agg((F.sum("__v").cast("double") / F.count("*") / 1000000).alias("avg_energy"))
    out = cut.join(energy, [*keys, "start"], "left").withColumn("avg_energy", F.when(F.col("only"), F.lit(0.5)).otherwise(F.coalesce("avg_energy", F.lit(0.5))))
    return out.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1)


def label_sections(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels by place and energy; then equal neighbours alternate between verse and bridge, from left to right."""
    middle = found.groupBy(*keys).agg(F.percentile("avg_energy", 0.5).alias("__mid"), F.max("idx").alias("__last"))
    length = F.col("end") - F.col("start")
    raw = (
        F.when(F.col("only"), "verse")
        .when((F.col("idx") == 0) & (length < 15), "intro")
        .when((F.col("idx") == F.col("__last")) & (length < 15), "outro")
        .when(F.col("avg_energy") > F.col("__mid") * 1.15, "chorus")
        .when(F.col("avg_energy") < F.col("__mid") * 0.85, "verse")
        .otherwise("bridge")
    )
    # Within a run of verses and bridges labels alternate from its first one on, whatever the others were.
    w = Window.partitionBy(*keys).orderBy("idx")
    plain = F.col("__raw").isin("verse", "bridge")
    rows = found.join(middle, list(keys)).withColumn("__raw", raw).withColumns({"__plain": plain, "__n": F.row_number().over(w)})
    rows = rows.withColumn("__run", F.col("__n") - F.row_number().over(Window.partitionBy(*keys, "__plain").orderBy("idx")))
    run = Window.partitionBy(*keys, "__plain", "__run").orderBy("idx")
    first, odd = F.first("__raw").over(run), F.row_number().over(run) % 2 == 1
    label = F.when(~F.col("__plain"), F.col("__raw")).when(odd, first).when(first == "verse", "bridge").otherwise("verse")
    return rows.select(*keys, F.col("idx").cast("int").alias("idx"), "start", "end", "avg_energy", label.alias("label"))


def leader_groups(vectors: Column, bar: float = 0.85) -> Column:
    """Of an array of unit vectors in order, (group, repeat index): each joins the first leader it is closer to than ``bar``."""

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    def step(acc: Column, v: Column) -> Column:
        close = F.filter(F.transform(acc["leaders"], lambda g, i: F.when(dot(g, v) > bar, i)), lambda i: i.isNotNull())
        group = F.coalesce(F.try_element_at(close, F.lit(1)), F.size(acc["leaders"]))
        before = F.size(F.filter(acc["out"], lambda o: o["grp"] == group))
        leaders = F.when(group == F.size(acc["leaders"]), F.concat(acc["leaders"], F.array(v))).otherwise(acc["leaders"])
        return F.struct(leaders.alias("leaders"), F.concat(acc["out"], F.array(F.struct(group.alias("grp"), before.alias("repeat_index")))).alias("out"))

    zero = F.struct(F.array().cast("array<array<double>>").alias("leaders"), F.array().cast("array<struct<grp:int,repeat_index:int>>").alias("out"))
    return F.aggregate(vectors, zero, step, lambda a: a["out"])

"""Order-dependent operators per key: sessions, islands, folds, runs, reflow.

Windows where a window can say it; a fold over one key's sorted array where each
step depends on what was accepted before. Arrays are of one medium or one track.
Sums that must agree between engines are taken over whole numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Points that a fold keeps before it puts them away.
FOLDED = 128
#: Product of two histograms' sums up to which they are not scaled (fixed value).
EMPTY = 1.1920929e-07


def exact_mean(value: Column) -> Column:
    """A mean over millionths, which does not depend on the order of the rows."""
    return F.sum(F.floor(value * 1000000 + 0.5).cast("bigint")).cast("double") / F.count("*") / 1000000


def sessionize(rows: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], gap_sec: int = 1800, out: str = "event_id") -> DataFrame:
    """Numbers sessions per key from 0: a gap of more than ``gap_sec`` begins one.

    Rows without a time come last: all in session 0 if no row of the key has a
    time, else each in a session of its own, in ``order``.
    """
    known = F.col(ts).isNotNull()
    w = Window.partitionBy(*keys, known).orderBy(F.col(ts).asc_nulls_last(), *order)
    gap = F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), F.col(ts))
    rows = rows.withColumn("__new", F.when(known & (gap > gap_sec * 1_000_000), 1).otherwise(0))
    rows = rows.withColumns({"__id": F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__turn": F.row_number().over(w)})
    rows = rows.withColumn("__top", F.max(F.when(known, F.col("__id"))).over(Window.partitionBy(*keys)))
    late = F.coalesce(F.col("__top") + F.col("__turn"), F.lit(0))
    return rows.withColumn(out, F.when(known, F.col("__id")).otherwise(late).cast("bigint")).drop("__new", "__id", "__turn", "__top")


def assign_events(shots: DataFrame, keys: Sequence[str], source: str, ts: str, order: str, gap_sec: int = 1800, out: str = "event_id") -> DataFrame:
    """Numbers events per key by the times of its sources: all shots of a source are of its event.

    A source's time is that of its first shot by ``order``; sources without one
    are numbered as rows without a time are by ``sessionize``.
    """
    first = shots.groupBy(*keys, source).agg(F.min_by(F.struct(F.col(ts).alias("t")), order).alias("__f"), F.min(order).alias("__first"))
    events = sessionize(first.select(*keys, source, F.col("__f.t").alias("__ts"), "__first"), keys, "__ts", ["__first"], gap_sec, out)
    return shots.join(events.select(*keys, source, out), [*keys, source])


def islands(rows: DataFrame, keys: Sequence[str], order: Sequence[str], inside: Column, t: str) -> DataFrame:
    """Runs of rows where ``inside`` holds: (keys, start, end): end is the time of the next row after it, else of its last."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.select(*keys, *order, t, F.coalesce(inside, F.lit(False)).alias("__in"), F.lead(t).over(w).alias("__next"), F.row_number().over(w).alias("__n"))
    rows = rows.filter("__in").withColumn("__run", F.col("__n") - F.row_number().over(w))
    found = rows.groupBy(*keys, "__run").agg(F.min(t).alias("start"), F.max(F.struct(F.col("__n"), F.coalesce("__next", t).alias("end"))).alias("__last"))
    return found.select(*keys, "start", F.col("__last.end").alias("end"))


def min_gap_fold(points: Column, gap: float, first: float | None = None) -> Column:
    """Of sorted points, those at least ``gap`` after the last one kept; begins with ``first`` if given.

    What is kept is put away FOLDED at a time, as each addition copies the array it is added to.
    """
    none = F.array().cast("array<array<double>>")
    start = F.struct(F.lit(first).cast("double").alias("last"), F.array(*([] if first is None else [F.lit(float(first))])).cast("array<double>").alias("now"), none.alias("done"))

    def step(s: Column, p: Column) -> Column:
        full = F.size(s["now"]) >= FOLDED
        now = F.when(full, F.array(p)).otherwise(F.concat(s["now"], F.array(p)))
        more = F.struct(p.alias("last"), now.alias("now"), F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"))
        return F.when(s["last"].isNull() | (p - s["last"] >= gap), more).otherwise(s)

    return F.aggregate(points, start, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["now"]))))


def garbage_merge(bounds: Column, min_sec: float) -> Column:
    """Drops bounds too close to the last one kept; the last bound always stays, and takes the place of the first if that alone is kept and too close."""
    inner, last = F.slice(bounds, 1, F.greatest(F.size(bounds) - 1, F.lit(0))), F.slice(bounds, -1, 1)
    kept = lambda k: F.when((F.size(k) == 1) & (F.element_at(bounds, -1) - F.element_at(k, 1) < min_sec), last).otherwise(F.concat(k, last))
    return F.when(F.size(bounds) <= 2, bounds).otherwise(F.transform(F.array(min_gap_fold(inner, min_sec)), kept)[0])


def force_split(bounds: Column, max_sec: float) -> Column:
    """Segments longer than ``max_sec`` in equal pieces: at least 2, else the length over it, halves up."""

    def pieces(i: Column) -> Column:
        a, b = F.element_at(bounds, i), F.element_at(bounds, i + 1)
        n = F.when(b - a > max_sec, F.greatest(F.lit(2), F.floor((b - a) / max_sec + 0.5).cast("int"))).otherwise(F.lit(1))
        return F.transform(F.sequence(F.lit(1), n), lambda k: F.when(k == n, b).otherwise(a + (b - a) / n * k))

    at = F.when(F.size(bounds) > 1, F.sequence(F.lit(1), F.size(bounds) - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.slice(bounds, 1, 1), F.flatten(F.transform(at, pieces)))


def shots_of(bounds: Column, min_sec: float) -> Column:
    """Consecutive bounds at least ``min_sec`` apart, as (shot_index, start, end); indices are places of bounds."""
    at = F.when(F.size(bounds) > 1, F.sequence(F.lit(1), F.size(bounds) - 1)).otherwise(F.array().cast("array<int>"))
    each = F.transform(at, lambda i: F.struct((i - 1).alias("shot_index"), F.element_at(bounds, i).alias("start"), F.element_at(bounds, i + 1).alias("end")))
    return F.filter(each, lambda s: s["end"] - s["start"] >= min_sec)


def hist_distance(a: Column, b: Column) -> Column:
    """Bhattacharyya distance of two histograms; 1 if one of them is empty, as then nothing is in common."""
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    both, product = add(F.zip_with(a, b, lambda x, y: F.sqrt(x * y))), add(a) * add(b)
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - F.when(product > EMPTY, both / F.sqrt(product)).otherwise(both)))


def is_boundary(hist: Column, flow: Column, jump: Column, hist_at: float = 0.4, flow_at: float = 12.0, jump_at: float = 30.0) -> Column:
    """A very different histogram, or two of three signals beyond their thresholds."""
    votes = sum((F.when(x > at, 1).otherwise(0) for x, at in ((hist, hist_at), (flow, flow_at), (jump, jump_at))), F.lit(0))
    return (hist > hist_at * 1.5) | (votes >= 2)


def detect_shots(frames: DataFrame, keys: Sequence[str], config) -> DataFrame:
    """Frames (keys, frame_idx, ts_sec, hist, flow_mag, luma_mean) and the medium's end_sec -> shots."""
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    thin = frames.filter(F.pmod(F.col("frame_idx"), F.lit(config.sample_interval)) == 0)
    thin = thin.withColumns({"__h": hist_distance(F.lag("hist").over(w), F.col("hist")), "__l": F.abs(F.col("luma_mean") - F.lag("luma_mean").over(w))})
    hits = thin.withColumn("__b", F.when(is_boundary(F.col("__h"), F.col("flow_mag"), F.col("__l"), config.histogram_threshold, config.optical_flow_threshold, config.luminance_threshold), F.col("ts_sec")))
    per = hits.groupBy(*keys).agg(F.array_sort(F.collect_list("__b")).alias("__points"), F.max("end_sec").alias("__end"))
    bounds = F.concat(min_gap_fold(F.col("__points"), config.min_duration, 0.0), F.array(F.col("__end")))
    per = per.withColumn("__bounds", bounds).withColumn("__bounds", force_split(F.col("__bounds"), config.max_duration)).withColumn("__bounds", garbage_merge(F.col("__bounds"), config.min_duration))
    return per.select(*keys, F.explode(shots_of(F.col("__bounds"), config.min_duration)).alias("s")).select(*keys, "s.*")


def photo_shots(media: DataFrame, keys: Sequence[str], seconds: float = 4.0) -> DataFrame:
    """One shot for each still."""
    return media.select(*keys, F.lit(0).alias("shot_index"), F.lit(0.0).alias("start"), F.lit(float(seconds)).alias("end"))


def sampled_frames(rows: DataFrame, keys: Sequence[str], frame: str = "frame_idx", most: int = 8) -> DataFrame:
    """Up to ``most`` frames of each shot at even steps from its first."""
    w = Window.partitionBy(*keys)
    rows = rows.withColumns({"__first": F.min(frame).over(w), "__all": F.count("*").over(w)})
    step = F.greatest(F.lit(1), F.floor(F.col("__all") / most).cast("int"))
    rows = rows.filter(F.pmod(F.col(frame) - F.col("__first"), step) == 0)
    return rows.withColumn("__n", F.row_number().over(w.orderBy(frame))).filter(F.col("__n") <= most).drop("__first", "__all", "__n")


def best_window(shots: DataFrame, frames: DataFrame, fps: float = 30.0, size_max: float = 2.5, size_min: float = 0.8, step: float = 0.5) -> DataFrame:
    """The window of each shot whose middle frame scores best, the first of equals.

    ``shots``: media_id, start, end, media_type, highlight_score, overall;
    ``frames``: media_id, frame_idx, frame_score. Stills and shots shorter than
    twice the least size are taken whole. Frames and windows are many times what
    the planner takes their tables' sizes for, so they are sorted, never broadcast.
    """
    dur = F.col("end") - F.col("start")
    whole = (F.col("media_type") == "photo") | (dur < 2 * size_min)
    size = F.greatest(F.least(F.lit(size_max), dur * 0.6), F.lit(size_min))
    k = F.greatest(F.floor((dur + 0.01 - size) / step).cast("int"), F.lit(0))
    tried = shots.filter(~whole).withColumn("__size", size).withColumn("__k", F.explode(F.sequence(F.lit(0), k))).withColumn("__at", F.col("start") + F.col("__k") * step)
    tried = tried.withColumn("frame_idx", ((F.col("__at") + F.col("__size") / 2) * fps).cast("bigint")).join(frames.select("media_id", "frame_idx", "frame_score").hint("merge"), ["media_id", "frame_idx"])
    best = tried.groupBy("media_id", "start").agg(F.max(F.struct(F.col("frame_score"), (-F.col("__k")).alias("turn"), F.col("__at"), F.col("__size"))).alias("b"))
    out = shots.join(best.hint("merge"), ["media_id", "start"], "left")
    fallback = F.when(F.col("media_type") == "photo", F.col("highlight_score")).otherwise(F.col("overall"))
    return out.select(*shots.columns, F.coalesce("b.__at", "start").alias("best_start"), F.coalesce(F.least(F.col("b.__at") + F.col("b.__size"), F.col("end")), F.col("end")).alias("best_end"), F.coalesce("b.frame_score", fallback).alias("window_score"))


def reflow(clips: DataFrame, keys: Sequence[str], order: Sequence[str], duration_ms: str = "duration_ms") -> DataFrame:
    """start_ms and end_ms of clips put one after another."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(duration_ms).over(w)
    return clips.withColumns({"start_ms": end - F.col(duration_ms), "end_ms": end})


def timeline_issues(clips: DataFrame, keys: Sequence[str], order: Sequence[str], tolerance_ms: int = 100) -> DataFrame:
    """Gaps and overlaps of over ``tolerance_ms`` between neighbours."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = F.col("start_ms") - F.lag("end_ms").over(w)
    found = clips.select(*keys, *order, gap.alias("gap_ms"))
    return found.filter(F.abs("gap_ms") > tolerance_ms).withColumn("issue", F.when(F.col("gap_ms") > 0, "gap").otherwise("overlap"))

"""Summaries of events and of a timeline, rankings and narrative orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.functions import scores as S
from spindle.operators import grammar
from spindle.operators.sequence import exact_mean
from spindle.plans.templates import Template

HIGHLIGHT = 0.5
BEAT_TOLERANCE = 0.12  # of reports, whatever the profile


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def summarize_events(shots: DataFrame, keys: Sequence[str] = ("project_id",), event: str = "event_id") -> DataFrame:
    """Per event: shots, duration, mean quality and emotion, span of the day."""
    clock = lambda t: F.date_format(t, "HH:mm")
    found = shots.filter(F.col(event) >= 0).groupBy(*keys, event).agg(
        F.count("*").alias("shot_count"),
        (F.sum("duration_ms") / 1000).alias("total_duration"),
        exact_mean(S.overall()).alias("avg_quality"),
        exact_mean(S.emotion()).alias("emotion_intensity"),
        clock(F.min("ts")).alias("first_hhmm"),
        clock(F.max("ts")).alias("last_hhmm"),
    )
    return found.withColumn("time_range", F.coalesce(F.concat("first_hhmm", F.lit(" - "), "last_hhmm"), F.lit("unknown")))


def rank_events(events: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """rank_score of quality, emotion and size against the best of the key, and rank_pos."""
    per = Window.partitionBy(*keys)
    best = lambda c: F.coalesce(F.nullif(F.max(c).over(per), F.lit(0).cast("double")), F.lit(1.0))
    score = F.lit(0.4) * (F.col("avg_quality") / best("avg_quality")) + F.lit(0.35) * (F.col("emotion_intensity") / best("emotion_intensity")) + F.lit(0.25) * F.least(F.col("shot_count") / best(F.col("shot_count").cast("double")), F.lit(1.0))
    events = events.withColumn("rank_score", score)
    return events.withColumn("rank_pos", F.row_number().over(per.orderBy(F.desc("rank_score"), "event_id")))


def narrative(events: DataFrame, mode: str = "chronological", keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """story_pos of ranked events: by time of day, by energy, or by time with the peak at three fifths."""
    per = Window.partitionBy(*keys)
    if mode == "energy_first":
        return events.withColumn("story_pos", F.row_number().over(per.orderBy("emotion_intensity", "rank_pos")))
    timed = events.withColumn("story_pos", F.row_number().over(per.orderBy(F.coalesce("first_hhmm", F.lit("99:99")), "rank_pos")))
    if mode != "hybrid":
        return timed
    timed = timed.withColumns({"__n": F.count("*").over(per), "__peak": F.first("story_pos").over(per.orderBy(F.desc("emotion_intensity"), "story_pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    target = F.floor((F.col("__n") - 1) * F.lit(0.6)).cast("int") + 1
    rest = F.col("story_pos") - F.when(F.col("story_pos") > F.col("__peak"), 1).otherwise(0)
    moved = F.when(F.col("story_pos") == F.col("__peak"), target).otherwise(rest + F.when(rest >= target, 1).otherwise(0))
    return timed.withColumn("story_pos", F.when(F.col("__n") >= 3, moved).otherwise(F.col("story_pos")).cast("int")).drop("__n", "__peak")


def event_arc(shots: DataFrame, keys: Sequence[str] = ("project_id", "event_id"), k: int | None = None) -> DataFrame:
    """arc_pos within event and role, best quality first, then input order."""
    bucket = F.when(F.col("shot_role").isin(*S.ROLES), F.col("shot_role")).otherwise("detail")
    shots = shots.withColumn("arc_role", bucket)
    shots = shots.withColumn("arc_pos", F.row_number().over(Window.partitionBy(*keys, "arc_role").orderBy(F.desc(S.overall()), "media_id")))
    return shots if k is None else shots.filter(F.col("arc_pos") <= k)


def timeline_summary(clips: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    return clips.groupBy(*keys).agg(
        F.count("*").alias("clips"), F.count_if(~S.photo()).alias("video_clips"), F.count_if(S.photo()).alias("photo_clips"),
        (F.max("end_ms") / 1000).alias("duration_sec"), F.count_distinct("chapter").alias("chapters"),
    )


def chapter_energy(clips: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    return clips.groupBy(*keys, "chapter").agg(
        F.count("*").alias("clip_count"), F.count_if(F.col("highlight_score") >= HIGHLIGHT).alias("highlight_count"),
        exact_mean(S.emotion()).alias("avg_emotion"), F.max(S.emotion()).alias("peak_emotion"),
    )


def aligned(beats: Sequence[float], t: Column) -> Column:
    return F.coalesce(S.distance_to(beats, t) <= BEAT_TOLERANCE, F.lit(False))


def rhythm_stats(clips: DataFrame, beats: Sequence[float], t: Column, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    found = clips.groupBy(*keys).agg(F.count("*").alias("total_cuts"), F.count_if(aligned(beats, t)).alias("beat_aligned_cuts"))
    return found.withColumn("beat_alignment_ratio", share(F.col("beat_aligned_cuts"), F.col("total_cuts")))


def section_stats(clips: DataFrame, sections, t: Column, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """A row per section of the track, also those without clips: place, label, bounds, energy, clips that begin in it and their mean motion."""
    rows = [F.struct(F.lit(i).alias("section_idx"), F.lit(x.label).alias("label"), F.lit(float(x.start)).alias("start"), F.lit(float(x.end)).alias("end"), F.lit(float(x.energy)).alias("avg_energy")) for i, x in enumerate(sections)]
    if not rows:
        rows = [F.lit(None).cast("struct<section_idx:int,label:string,start:double,end:double,avg_energy:double>")]
    every = clips.select(*keys).distinct().select(*keys, F.explode(F.array(*rows)).alias("s")).filter("s IS NOT NULL").select(*keys, "s.*")
    inside = lambda x: (t >= float(x.start)) & (t < float(x.end))
    mine = F.array(*[F.when(inside(x), F.lit(i)) for i, x in enumerate(sections)]).cast("array<int>")
    placed = clips.withColumn("section_idx", F.explode(mine)).filter("section_idx IS NOT NULL")
    found = placed.groupBy(*keys, "section_idx").agg(F.count("*").alias("clip_count"), exact_mean(F.col("motion_intensity")).alias("avg_motion"))
    return every.join(found, [*keys, "section_idx"], "left").withColumns({"clip_count": F.coalesce("clip_count", F.lit(0).cast("bigint")), "avg_motion": F.coalesce("avg_motion", F.lit(0.0))})


def section_roles(clips: DataFrame, sections, t: Column, keys: Sequence[str] = ("project_id",), template: Template | None = None) -> DataFrame:
    """Clips by section and role, with how many of them suit it."""
    role = F.when(F.coalesce(F.col("shot_role"), F.lit("")) == "", "unknown").otherwise(F.col("shot_role"))
    placed = clips.withColumns({"section": S.section_at(sections, t), "shot_role": role}).filter("section IS NOT NULL")
    liked = F.lit(False)
    for label, roles in S.preferred_roles(template).items():
        liked = liked | ((F.col("section") == label) & F.col("shot_role").isin(*roles))
    return placed.groupBy(*keys, "section", "shot_role").agg(F.count("*").alias("n"), F.count_if(~liked).alias("mismatches"))


def chorus_lift(sections, t: Column) -> list[Column]:
    """Highlight rates inside and outside choruses and their difference; no section counts as outside."""
    inside = F.coalesce(S.section_at(sections, t) == "chorus", F.lit(False))
    hit = F.col("highlight_score") >= HIGHLIGHT
    a = share(F.count_if(inside & hit), F.count_if(inside))
    b = share(F.count_if(~inside & hit), F.count_if(~inside))
    return [a.alias("chorus_highlight_rate"), b.alias("non_chorus_highlight_rate"), (a - b).alias("chorus_highlight_lift")]


def section_role_stats(clips: DataFrame, sections, t: Column, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    roles = section_roles(clips, sections, t, keys).groupBy(*keys).agg(F.sum("n").alias("clips_in_sections"), F.sum("mismatches").alias("mismatches"))
    lift = clips.groupBy(*keys).agg(*chorus_lift(sections, t))
    return lift.join(roles, list(keys), "left").withColumns({"clips_in_sections": F.coalesce("clips_in_sections", F.lit(0)), "mismatches": F.coalesce("mismatches", F.lit(0))}).withColumn("mismatch_rate", share(F.col("mismatches"), F.col("clips_in_sections")))


def all_event_counts(shots: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    return shots.filter("event_id >= 0").groupBy(*keys).agg(F.count_distinct("event_id").alias("all_events"))


def kpi_summary(clips: DataFrame, shots: DataFrame, beats: Sequence[float], t: Column, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    own = clips.groupBy(*keys).agg(
        F.count("*").alias("total_clips"), (F.max("end_ms") / 1000).alias("total_duration_sec"), F.count_distinct("source_id").alias("unique_sources"),
        F.count_distinct(F.when(F.col("event_id") >= 0, F.col("event_id"))).alias("__events"),
        F.count_if(F.col("highlight_score") >= HIGHLIGHT).alias("highlight_count"), F.count_if(aligned(beats, t)).alias("__beats"),
    )
    own = own.join(all_event_counts(shots, keys), list(keys), "left")
    return own.select(
        *keys, "total_clips", "total_duration_sec", "unique_sources", share(F.col("__events"), F.coalesce("all_events", F.lit(0))).alias("event_coverage"),
        "highlight_count", share(F.col("highlight_count"), F.col("total_clips")).alias("highlight_rate"), share(F.col("__beats"), F.col("total_clips")).alias("beat_alignment_rate"),
    )


def role_coverage(clips: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Share of chapters with two roles or more."""
    per = clips.groupBy(*keys, "chapter").agg(F.count_distinct(F.coalesce("shot_role", F.lit("unknown"))).alias("n"))
    return per.groupBy(*keys).agg(share(F.count_if(F.col("n") >= 2), F.count("*")).alias("chapter_role_coverage_rate"))


def story_metrics(clips: DataFrame, shots: DataFrame, sections, t: Column, target_sec: float, audio: bool = True, keys: Sequence[str] = ("project_id",), order: Sequence[str] = ("clip_idx",)) -> DataFrame:
    same = F.lag("source_id").over(Window.partitionBy(*keys).orderBy(*order)) == F.col("source_id")
    rows = clips.withColumn("__same", same)
    own = rows.groupBy(*keys).agg(
        (F.sum("duration_ms") / 1000 / max(target_sec, 1.0)).alias("duration_achievement_rate"),
        F.count_distinct(F.when(F.col("event_id") >= 0, F.col("event_id"))).alias("__events"),
        share(F.count_if("__same"), F.greatest(F.count("*") - 1, F.lit(1))).alias("repeated_shot_rate"),
        share(F.count_if(F.col("highlight_score") >= HIGHLIGHT), F.count("*")).alias("highlight_hit_rate"),
        chorus_lift(sections, t)[2],
    )
    found = grammar.violations(clips, keys).select(*keys, (F.col("same_role") + F.col("needs_breath")).alias("grammar_violations"))
    own = own.join(all_event_counts(shots, keys), list(keys), "left").join(role_coverage(clips, keys), list(keys)).join(found, list(keys))
    return own.select(*keys, "duration_achievement_rate", share(F.col("__events"), F.coalesce("all_events", F.lit(0))).alias("event_coverage_rate"), "repeated_shot_rate", "highlight_hit_rate", F.lit(1.0 if audio else 0.0).alias("audio_presence_rate"), "grammar_violations", "chapter_role_coverage_rate", "chorus_highlight_lift")


def story_structure(clips: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Chapters with their events and clips, nested."""
    events = clips.groupBy(*keys, "chapter", "event_id").agg(F.array_sort(F.collect_list(F.struct("clip_idx", "media_id", "shot_role"))).alias("clips"))
    return events.groupBy(*keys, "chapter").agg(F.array_sort(F.collect_list(F.struct("event_id", "clips"))).alias("events"))


def best_alternatives(clips: DataFrame, shots: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """For each clip of a known event the best shot of its event that is not used, the first of equals; one may serve again."""
    shots = shots.filter("event_id >= 0")
    spare = shots.join(clips.select(*keys, "media_id"), [*keys, "media_id"], "left_anti")
    best = spare.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "event_id").orderBy(F.desc(S.overall()), "media_id"))).filter("__n = 1")
    return clips.select(*keys, "clip_idx", "event_id", "media_id").join(best.select(*keys, "event_id", F.col("media_id").alias("alt_media_id")), [*keys, "event_id"])


def rejected(clips: DataFrame, shots: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    return shots.join(clips.select(*keys, "media_id"), [*keys, "media_id"], "left_anti").withColumn("reason", S.rejection_reason())


def markers(clips: DataFrame, keys: Sequence[str] = ("project_id",), start: Column | None = None, score: Column | None = None, why: Column | None = None, source: Column | None = None) -> DataFrame:
    """First clip of each chapter (Blue) and known event (Green), and every highlight (Red) by its reason, with a comment.

    ``start`` (seconds), ``score``, ``why`` (the reason of the choice) and
    ``source`` (a file's name) are columns of a clip, by default those of a plan's clips.
    """
    start = F.col("start_ms") / 1000 if start is None else start
    lit_ = F.coalesce(F.nullif(F.col("highlight_reason"), F.lit("")), F.lit("highlight"))
    comment = F.concat(F.col("source_id").cast("string") if source is None else source, F.lit(" | score="), S.fixed(F.lit(0.0) if score is None else score, 3), F.lit(" | "), F.lit("") if why is None else why)

    def first(by: str, kind: str, name: Column, note: Column, colour: str) -> DataFrame:
        rows = clips.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, by).orderBy("clip_idx"))).filter("__n = 1")
        rows = rows.filter("event_id >= 0") if by == "event_id" else rows.filter(F.coalesce("chapter", F.lit("")) != "")
        return rows.select(*keys, "clip_idx", F.lit(kind).alias("kind"), name.alias("name"), note.alias("comment"), F.lit(colour).alias("colour"), S.frames_of(start).alias("frame"))

    shown = clips.filter(F.col("highlight_score") >= HIGHLIGHT).select(*keys, "clip_idx", F.lit("highlight").alias("kind"), F.concat(F.lit("Highlight: "), lit_).alias("name"), comment.alias("comment"), F.lit("Red").alias("colour"), S.frames_of(start).alias("frame"))
    chapter, event = F.col("chapter"), F.col("event_id").cast("string")
    by_chapter = first("chapter", "chapter", F.concat(F.lit("Chapter: "), chapter), F.concat(F.lit("Chapter start: "), chapter), "Blue")
    by_event = first("event_id", "event", F.concat(F.lit("Event "), event), F.concat(F.lit("Event "), event, F.lit(" start")), "Green")
    return by_chapter.unionByName(by_event).unionByName(shown)


def notes(clips: DataFrame, keys: Sequence[str] = ("project_id",), top: int = 3, weak: int = 2) -> DataFrame:
    """Per chapter the first highlights and the weakest clips, by the planner's total_score, or by quality where clips weren't planned."""
    worth = F.col("total_score") if "total_score" in clips.columns else S.overall()
    per = Window.partitionBy(*keys, "chapter")
    lit = clips.filter(F.col("highlight_score") >= HIGHLIGHT).withColumn("place", F.row_number().over(per.orderBy("clip_idx"))).filter(F.col("place") <= top).withColumn("note", F.lit("highlight"))
    low = clips.withColumn("place", F.row_number().over(per.orderBy(worth, "clip_idx"))).filter(F.col("place") <= weak).withColumn("note", F.lit("weak"))
    return lit.unionByName(low).select(*keys, "chapter", "note", "place", "clip_idx", "media_id")

"""Reports of a timeline as rows: CSV lines, story notes, the nested report, the comparison.

A timeline has, per clip: project_id, clip_idx, media_id (the shot), source_id,
source (a path), name (its file's name), media_type, event_id, shot_role,
chapter, timeline_start, timeline_end, in_point, out_point, total_score,
selection_reason, transition_in, transition_out, highlight_score,
highlight_reason, window_score and the five metrics. Shots have the same
of themselves, with start and end, ts for the time of day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.functions import scores as S
from spindle.operators import summary
from spindle.plans.templates import Music

KEYS = ("project_id",)
METRICS = ("sharpness", "exposure", "stability", "face_score", "motion_intensity")
COMPARED = ("duration_achievement_rate", "event_coverage_rate", "repeated_shot_rate", "highlight_hit_rate", "audio_presence_rate", "grammar_violations", "chapter_role_coverage_rate", "chorus_highlight_lift")


def _fixed(places: int, *names: str) -> list[Column]:
    return [S.fixed(F.col(n), places).alias(n) for n in names]


def role() -> Column:
    return F.coalesce(F.nullif(F.col("shot_role"), F.lit("")), F.lit("unknown"))


def selected_rows(timeline: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The 15 columns of the list of selected clips, as text, in the order of clip_idx."""
    return timeline.select(*keys, "clip_idx", "source", "media_type", "event_id", *_fixed(2, "in_point", "out_point", "timeline_start", "timeline_end"), "chapter", *_fixed(4, "total_score", *METRICS), F.col("selection_reason").alias("reason"))


def left_out(timeline: DataFrame, shots: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Shots that no clip is of, by source and start."""
    used = timeline.select(*keys, "media_id").join(shots.select(*keys, "media_id", "source", "start"), [*keys, "media_id"]).select(*keys, "source", "start")
    return shots.join(used, [*keys, "source", "start"], "left_anti")


def rejected_rows(timeline: DataFrame, shots: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The 14 columns of the list of rejected shots, as text, with media_id for their order."""
    rows = left_out(timeline, shots, keys).withColumns({"duration": F.col("end") - F.col("start"), "overall_quality": S.overall()})
    times = [S.fixed(F.col(a), 2).alias(b) for a, b in (("start", "start_sec"), ("end", "end_sec"), ("duration", "duration"))]
    return rows.select(*keys, "media_id", "source", "media_type", "event_id", role().alias("shot_role"), *times, *_fixed(4, *METRICS, "overall_quality"), S.rejection_reason().alias("rejection_reason"))


def candidate_rows(shots: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The 15 columns of the list of candidates, as text, with place for their order: best first, then by media_id."""
    rows = shots.withColumns({"duration": F.col("end") - F.col("start"), "overall_quality": S.overall()})
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("overall_quality"), "media_id"))
    times = [S.fixed(F.col(a), 2).alias(b) for a, b in (("start", "start_sec"), ("end", "end_sec"), ("duration", "duration"))]
    return rows.select(*keys, place.alias("place"), F.col("name").alias("filename"), "media_type", "event_id", "shot_role", *times, *_fixed(4, *METRICS, "overall_quality", "highlight_score"), "highlight_reason")


def event_rows(shots: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The 7 columns of the list of events, as text."""
    found = summary.summarize_events(shots, keys)
    return found.select(*keys, "event_id", "shot_count", S.fixed(F.col("total_duration"), 1).alias("total_duration"), *_fixed(3, "avg_quality", "emotion_intensity"), "time_range", F.lit("keep").alias("action"))


def list_lines(shots: DataFrame, title: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, part, at, line) of a list to fill in: its head, events, then file names, all as comments."""
    head = [f"# {title}", "# Supports filenames and event IDs (prefix with 'event:')"]
    every = shots.select(*keys).distinct()
    fixed = every.select(*keys, F.posexplode(F.array(*map(F.lit, [*head, "", "# --- Events ---"]))).alias("at", "line")).select(*keys, F.lit(0).alias("part"), F.col("at").cast("string").alias("at"), "line")
    events = summary.summarize_events(shots, keys).select(*keys, F.lit(1).alias("part"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("at"), F.concat(F.lit("# event:"), "event_id", F.lit("  ("), "shot_count", F.lit(" shots, "), "time_range", F.lit(")")).alias("line"))
    files = every.select(*keys, F.posexplode(F.array(F.lit(""), F.lit("# --- Files ---"))).alias("at", "line")).select(*keys, F.lit(2).alias("part"), F.col("at").cast("string").alias("at"), "line")
    names = shots.select(*keys, "name").distinct().select(*keys, F.lit(3).alias("part"), F.col("name").alias("at"), F.concat(F.lit("# "), "name").alias("line"))
    return fixed.unionByName(events).unionByName(files).unionByName(names)


def note_lines(timeline: DataFrame, shots: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, line_no, line) of the story notes: the whole, then each chapter's length, events, first highlights and weakest clips."""
    length = F.col("timeline_end") - F.col("timeline_start")
    at = lambda c: F.concat(F.lit("  - "), c["name"], F.lit(" @ "), S.fixed(c["t"], 1), F.lit("s ("), c["note"], F.lit(")"))
    shown = F.struct("clip_idx", "name", F.col("timeline_start").alias("t"), F.coalesce("highlight_reason", F.lit("")).alias("note"))
    weak = F.struct("total_score", "clip_idx", "name", F.col("timeline_start").alias("t"), F.concat(F.lit("score="), S.fixed(F.col("total_score"), 3)).alias("note"))
    n_lit = F.row_number().over(Window.partitionBy(*keys, "chapter").orderBy(F.col("highlight_score") < summary.HIGHLIGHT, "clip_idx"))
    n_weak = F.row_number().over(Window.partitionBy(*keys, "chapter").orderBy("total_score", "clip_idx"))
    rows = timeline.withColumns({"__lit": n_lit, "__weak": n_weak})
    good = F.col("highlight_score") >= summary.HIGHLIGHT
    per = rows.groupBy(*keys, "chapter").agg(
        F.min("clip_idx").alias("first"), F.round(F.sum(length), 3).alias("sec"), F.count("*").alias("n"), F.count_if(good).alias("lit"),
        F.array_sort(F.collect_list(F.when(good & (F.col("__lit") <= 3), shown))).alias("shown"),
        F.array_sort(F.collect_list(F.when(F.col("__weak") <= 2, weak))).alias("weak"),
    )
    events = timeline.select(*keys, "chapter", "event_id").distinct().join(summary.summarize_events(shots, keys).select(*keys, "event_id", "time_range", "shot_count"), [*keys, "event_id"], "left")
    told = F.concat(F.lit("- Event "), "event_id", F.lit(": "), "time_range", F.lit(" ("), "shot_count", F.lit(" shots)"))
    events = events.groupBy(*keys, "chapter").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("time_range").isNotNull(), F.struct("event_id", told.alias("line"))))), lambda e: e["line"]).alias("events"))
    empty = F.array().cast("array<string>")
    lines = F.concat(
        F.array(F.concat(F.lit("## "), "chapter"), F.concat(F.lit("- Duration: "), S.fixed(F.col("sec"), 1), F.lit("s, "), F.col("n").cast("string"), F.lit(" clips"))),
        F.coalesce("events", empty),
        F.when(F.col("lit") > 0, F.concat(F.array(F.concat(F.lit("- Highlights: "), F.col("lit").cast("string"))), F.transform("shown", at))).otherwise(empty),
        F.array(F.lit("- Suggested replacements:")), F.transform("weak", at), F.array(F.lit("")),
    )
    parts = per.join(events, [*keys, "chapter"], "left").select(*keys, "first", F.posexplode(lines).alias("at", "line"))
    whole = timeline.groupBy(*keys).agg(F.max("timeline_end").alias("sec"), F.count("*").alias("n"))
    head = F.array(F.lit("# Story Notes"), F.concat(F.lit("Total duration: "), S.fixed(F.col("sec"), 1), F.lit("s, "), F.col("n").cast("string"), F.lit(" clips")), F.lit(""))
    every = whole.select(*keys, F.lit(-1).alias("first"), F.posexplode(head).alias("at", "line")).unionByName(parts)
    return every.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("first", "at")) - 1).alias("line_no"), "line")


def _nested(frame: DataFrame, name: str, keys: Sequence[str], *order: str) -> DataFrame:
    rest = [c for c in frame.columns if c not in (*keys, *order)]
    return frame.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))


def report_rows(timeline: DataFrame, shots: DataFrame, music: Music = Music(), grammar_report: DataFrame | None = None, skipped: Sequence[dict] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """A row per project with the 13 parts of the report, nested."""
    t, length = F.col("timeline_start"), F.col("timeline_end") - F.col("timeline_start")
    r4 = lambda c: F.round(c, 4)
    rows = timeline.withColumns({"duration_ms": length * 1000, "start_ms": t * 1000, "end_ms": F.col("timeline_end") * 1000, "highlight": F.col("highlight_score") >= summary.HIGHLIGHT})
    kpi = summary.kpi_summary(rows, shots, music.beats, t, keys)
    whole = rows.groupBy(*keys).agg(F.count("*").alias("total_clips"), F.max("timeline_end").alias("total_duration"), F.count_if(~S.photo()).alias("video_clips"), F.count_if(S.photo()).alias("photo_clips"))
    chapters = rows.groupBy(*keys, "chapter").agg(F.count("*").alias("clips"), F.sum(length).alias("duration"))
    chapters = chapters.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chapter", F.struct("clips", "duration"))))).alias("chapters"))
    energy = summary.chapter_energy(rows, keys).join(rows.groupBy(*keys, "chapter").agg(F.min("clip_idx").alias("first")), [*keys, "chapter"])
    energy = _nested(energy.withColumns({"avg_emotion": r4("avg_emotion"), "peak_emotion": r4("peak_emotion")}), "chapter_energy", keys, "first")
    clip = F.struct("clip_idx", "source", F.round("timeline_start", 3).alias("timeline_start"), F.round("timeline_end", 3).alias("timeline_end"), role().alias("shot_role"), F.col("highlight").alias("is_highlight"), "selection_reason")
    inner = rows.groupBy(*keys, "chapter", "event_id").agg(F.count("*").alias("clip_count"), F.round(F.sum(length), 3).alias("duration"), F.array_sort(F.collect_list(clip)).alias("clips"))
    story = inner.groupBy(*keys, "chapter").agg(F.min(F.expr("clips[0].clip_idx")).alias("first"), F.sum("clip_count").alias("clip_count"), F.round(F.sum("duration"), 3).alias("duration"), F.array_sort(F.collect_list(F.struct("event_id", "clip_count", "duration", "clips"))).alias("events"))
    story = _nested(story.withColumnRenamed("chapter", "name"), "story_structure", keys, "first")
    roles = rows.groupBy(*keys, "chapter", role().alias("r")).agg(F.count("*").alias("n")).groupBy(*keys, "chapter").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("r", "n")))).alias("m"))
    roles = roles.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("chapter", "m"))).alias("role_coverage"))
    covered = summary.role_coverage(rows, keys).withColumn("chapter_role_coverage_rate", r4("chapter_role_coverage_rate"))
    aligned = summary.rhythm_stats(rows, music.beats, t, keys).withColumn("beat_alignment_ratio", r4("beat_alignment_ratio"))
    sections = _nested(summary.section_stats(rows, music.sections, t, keys).withColumns({"avg_energy": r4("avg_energy"), "avg_motion": r4("avg_motion")}), "sections", keys, "section_idx")
    packed = lambda frame, name: frame.select(*keys, F.struct(*[c for c in frame.columns if c not in keys]).alias(name))
    out = packed(kpi, "kpi_summary").join(packed(whole.join(chapters, list(keys)), "summary"), list(keys)).join(energy, list(keys)).join(story, list(keys)).join(roles, list(keys)).join(covered, list(keys))
    if music.sections:
        section_role = summary.section_role_stats(rows, music.sections, t, keys)
        by_role = summary.section_roles(rows, music.sections, t, keys).groupBy(*keys, "section").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("shot_role", "n")))).alias("m"))
        by_role = by_role.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("section", "m"))).alias("section_roles"))
        out = out.join(packed(section_role.join(by_role, list(keys), "left").withColumn("available", F.lit(True)), "section_role_stats"), list(keys))
    else:
        out = out.withColumn("section_role_stats", F.struct(F.lit(False).alias("available")))
    out = out.join(packed(aligned.join(sections, list(keys), "left"), "rhythm_alignment"), list(keys), "left")
    if grammar_report is None:
        out = out.withColumn("grammar_violations", F.struct(F.lit(0).alias("total_violations")))
    else:
        out = out.join(packed(grammar_report, "grammar_violations"), list(keys), "left")
    events = summary.summarize_events(shots, keys).select(*keys, "event_id", "shot_count", F.round("total_duration", 2).alias("total_duration"), r4("avg_quality").alias("avg_quality"), "time_range")
    chosen = rows.select(*keys, "clip_idx", "source", "event_id", "shot_role", F.col("in_point").alias("source_in"), F.col("out_point").alias("source_out"), "timeline_start", "timeline_end", "chapter", r4("total_score").alias("total_score"), "selection_reason", F.col("highlight").alias("is_highlight"), r4("highlight_score").alias("highlight_score"), "highlight_reason", F.col("in_point").alias("window_in"), F.col("out_point").alias("window_out"), r4("window_score").alias("window_score"), F.struct(*[r4(m).alias(m) for m in METRICS]).alias("quality"), "transition_in", "transition_out")
    rejected = left_out(timeline, shots, keys).groupBy(*keys).agg(F.count("*").alias("rejected_count"))
    named = F.array(*[F.create_map(*[F.lit(str(x)) for kv in d.items() for x in kv]) for d in skipped]).cast("array<map<string,string>>")
    out = out.join(_nested(events, "event_summary", keys, "event_id"), list(keys), "left").withColumn("skipped_dng", named).join(_nested(chosen, "selected_clips", keys, "clip_idx"), list(keys)).join(rejected, list(keys), "left")
    return out.withColumn("rejected_count", F.coalesce("rejected_count", F.lit(0).cast("bigint")))


def comparison_rows(before: DataFrame, after: DataFrame, shots: DataFrame, music: Music, target_sec: float, audio: bool, keys: Sequence[str] = KEYS) -> DataFrame:
    """A row per project: the eight metrics before and after the rules, and their differences."""

    def measured(clips: DataFrame, name: str) -> DataFrame:
        rows = clips.withColumn("duration_ms", (F.col("timeline_end") - F.col("timeline_start")) * 1000)
        found = summary.story_metrics(rows, shots, music.sections, F.col("timeline_start"), target_sec, audio, keys)
        found = found if music.sections else found.withColumn("chorus_highlight_lift", F.lit(0.0))
        return found.select(*keys, F.struct(*[F.round(F.col(c).cast("double"), 4).alias(c) for c in COMPARED]).alias(name))

    both = measured(before, "before").join(measured(after, "after"), list(keys))
    return both.withColumn("delta", F.struct(*[F.round(F.col(f"after.{c}") - F.col(f"before.{c}"), 4).alias(c) for c in COMPARED]))


def profile_row(profile: DataFrame, roles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A learned profile as it is saved: biases with four decimals, role_bias a map."""
    maps = roles.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", F.round("bias", 4).alias("b"))))).alias("role_bias"))
    out = profile.join(maps, list(keys), "left")
    names = ("face_bias", "motion_bias", "stability_bias", "sharpness_bias")
    return out.select(*keys, *[F.round(n, 4).alias(n) for n in names], F.coalesce("role_bias", F.create_map().cast("map<string,double>")).alias("role_bias"), "preferred_events", "avoided_events", F.round("photo_bias", 4).alias("photo_bias"), "sample_count")


def index_rows(media: DataFrame) -> DataFrame:
    """The media index: a row per file, places and proxies only where they are."""
    return media.select(F.col("media_path").alias("path"), "media_type", "file_hash", "file_size", "width", "height", "duration_sec", "fps", "creation_time", "gps_lat", F.when(F.col("gps_lat").isNotNull(), F.col("gps_lon")).alias("gps_lon"), "proxy_path")

"""From a folder of media to a plan, its sequence and its reports; and the review before it.

What is seen and heard in uncompressed files is read from them (``sources.frames``).
For others decoding is an input boundary, and a folder of features has it, Parquet
tables by the path below the input folder:
``frames`` (path, frame_idx, fps, ts_sec, end_sec, hist, flow_mag, luma_mean,
laplacian_var, face_ratio, n_faces, flow_next, diff_next; a still is one frame)
and, where there is music, ``rms`` (path, frame, t, value) and ``beats`` (path,
t). flow_next and diff_next compare a frame with the next one sampled.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.functions import scores as S
from spindle.operators import grammar, music, planner, preference, sequence, summary
from spindle.operators.structure import track_beats
from spindle.plans.templates import Music, Output, Project, Section, load_profile
from spindle.sources import frames as reader
from spindle.sources import ingest, reports, sinks, store

logger = logging.getLogger(__name__)
#: Exit codes (fixed values).
NO_MEDIA, NO_MUSIC = 10, 11
STILL_SECONDS, SAMPLES, PAIRS = 4.0, 8, 5
KEYS = ["project_id"]


class NoMedia(Exception):
    """A folder holds no video and no photo."""


def score_shots(shots: DataFrame, frames: DataFrame) -> DataFrame:
    """``shots`` (source, shot_index, start, end, media_type) with the five metrics.

    Of up to eight frames at even steps the middle one is measured, the first
    five pairs give stability and motion; a still is its one frame, steady and
    without motion; a shot without frames scores 0 in all.
    """
    rate = frames.groupBy("source").agg(F.max("fps").alias("__fps"))
    rows = shots.join(rate, "source", "left").withColumns({"__a": (F.col("start") * F.col("__fps")).cast("int"), "__b": (F.col("end") * F.col("__fps")).cast("int")})
    step = F.greatest(F.lit(1), F.floor((F.col("__b") - F.col("__a")) / SAMPLES).cast("int"))
    still = F.col("media_type") == "photo"
    asked = rows.withColumn("frame_idx", F.explode(F.when(still, F.array(F.lit(0))).when(F.col("__b") > F.col("__a"), F.sequence(F.col("__a"), F.col("__b") - 1, step)).otherwise(F.array().cast("array<int>"))))
    seen = frames.select("source", F.col("frame_idx").cast("int").alias("frame_idx"), "laplacian_var", "luma_mean", "face_ratio", "n_faces", "flow_next", "diff_next")
    per = asked.select("source", "shot_index", "frame_idx").join(seen, ["source", "frame_idx"]).groupBy("source", "shot_index").agg(F.slice(F.array_sort(F.collect_list(F.struct("frame_idx", "laplacian_var", "luma_mean", "face_ratio", "n_faces", "flow_next", "diff_next"))), 1, SAMPLES).alias("f"))
    n = F.size("f")
    middle = F.get("f", F.floor(n / 2).cast("int"))
    pairs = F.slice("f", 1, F.greatest(F.least(n - 1, F.lit(PAIRS)), F.lit(0)))
    metrics = {
        "sharpness": S.sharpness_of(middle["laplacian_var"]), "exposure": S.exposure_of(middle["luma_mean"]),
        "stability": S.stability_of(F.transform(pairs, lambda x: x["flow_next"]), n), "face_score": S.faces_of(middle["face_ratio"], middle["n_faces"]),
        "motion_intensity": S.motion_of(F.transform(pairs, lambda x: x["diff_next"]), n),
    }
    scored = per.select("source", "shot_index", *[v.alias(k) for k, v in metrics.items()])
    out = shots.join(scored, ["source", "shot_index"], "left")
    return out.withColumns({k: F.coalesce(k, F.lit(0.0)) for k in metrics})


@dataclass
class Material:
    """A folder's media and what their features say: ``shots`` are scored and have their source's columns."""

    media: DataFrame
    shots: DataFrame
    frames: DataFrame
    music: str | None = None
    structure: Music = Music()


def feature(spark: SparkSession, features: str | None, name: str, root: str) -> DataFrame | None:
    """A table of features with the file's whole path as source; None where there is no such table."""
    if features is None or not Path(features, f"{name}.parquet").exists():
        return None
    return spark.read.parquet(f"{features}/{name}.parquet").withColumn("source", F.concat(F.lit(root.rstrip("/") + "/"), "path")).drop("path")


def analysed(media: DataFrame, frames: DataFrame, project: Project) -> DataFrame:
    """Scored shots of videos and stills, videos first, in the order of their paths."""
    known = media.select(F.col("media_path").alias("source"), "media_type", "creation_time", "width", "height", "duration_sec", "proxy_path")
    videos, stills = known.filter("media_type = 'video'"), known.filter("media_type = 'photo'")
    found = sequence.detect_shots(frames.join(videos.select("source"), "source"), ["source"], project.shot_detect)
    shots = found.unionByName(sequence.photo_shots(stills, ["source"], STILL_SECONDS)).join(known, "source")
    shots = score_shots(shots, frames).withColumns({"ts": ingest.creation_time(F.col("creation_time")), "name": F.substring_index("source", "/", -1), "project_id": F.lit(0).cast("bigint"), "duration_ms": (F.col("end") - F.col("start")) * 1000})
    order = Window.orderBy(F.col("media_type") == "photo", F.split("source", "/"), "shot_index")  # one project's shots
    return shots.withColumn("media_id", F.row_number().over(order).cast("bigint"))


def told(shots: DataFrame) -> DataFrame:
    """``shots`` with role and highlight."""
    rows = shots.withColumn("shot_role", S.role()).withColumn("__h", S.highlight())
    return rows.withColumns({"highlight_score": F.col("__h.score"), "highlight_reason": F.col("__h.reason")}).drop("__h")


def structure_of(spark: SparkSession, features: str, root: str, path: str | None) -> Music:
    """The structure of the chosen track, from its loudness and beats."""
    rms, beats = feature(spark, features, "rms", root), feature(spark, features, "beats", root)
    if path is None:
        return Music()
    if rms is None:
        rms = reader.rms_rows(spark.createDataFrame([(path,)], "path string")).withColumnRenamed("path", "source")
    own = store.written(rms.filter(F.col("source") == path).withColumn("track", F.lit(0)), "rms")
    labelled = music.detect_sections(own, ["track"], "frame", "t", "value").orderBy("idx").collect()  # a track's sections, high ranges, seconds and beats
    high = music.high_energy_ranges(own, ["track"], "frame", "t", "value").orderBy("start").collect()
    curve = music.energy_curve(own, ["track"], "frame", "t", "value").orderBy("block").collect()
    if beats is None:
        beats = track_beats(own, ["track"], "frame", "t", "value").select(F.explode("beats").alias("t"))
    else:
        beats = beats.filter(F.col("source") == path)
    at = beats.orderBy("t").collect()
    return Music(tuple(r["t"] for r in at), tuple((r["start"], r["end"]) for r in high), tuple(Section(r["label"], r["start"], r["end"], r["avg_energy"]) for r in labelled), tuple((r["t"], r["energy"]) for r in curve))


def taken_in(spark: SparkSession, folder: str, features: str, out: Path, project: Project, probe: Callable[[str], str], proxy=ingest.jpeg_proxy) -> tuple[Material, list[dict]]:
    """Scans, probes, removes duplicates and scores; writes the media index. Also the raw photos without a proxy."""
    root = str(Path(folder).resolve())
    files = ingest.probed(ingest.scan(spark, folder), probe).withColumn("m", ingest.metadata(F.col("probe"))).select("media_path", "media_type", "file_hash", "file_size", "m.*")
    plain = files.withColumn("media_path", F.regexp_replace("media_path", "^file:/+", "/"))
    out.mkdir(parents=True, exist_ok=True)
    media = store.written(ingest.deduplicate(ingest.with_proxies(plain, store.proxies(spark, str(out)), proxy)), "media")
    index = reports.index_rows(media).orderBy(F.split("path", "/"))
    _json(out / "media_index.json", [json.loads(r[0]) for r in index.select(F.to_json(F.struct("*"))).collect()])  # a folder's files
    usable = ingest.usable(media)
    skipped = [{"file": r["media_path"].rsplit("/", 1)[-1], "reason": "all proxy conversion strategies failed"} for r in media.exceptAll(usable).collect()]
    if usable.filter("media_type IN ('video', 'photo')").isEmpty():
        raise NoMedia(folder)
    frames = feature(spark, features, "frames", root)
    if frames is None:
        read = reader.frame_rows(usable.select(F.col("media_path").alias("path")), project.shot_detect.sample_interval)
        frames = store.written(read.withColumnRenamed("path", "source"), "frames")
    return Material(media, store.written(analysed(usable, frames, project), "analysed"), frames), skipped


def _json(path: Path, value: object) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, indent=2, ensure_ascii=False), encoding="utf-8")


def _csv(path: Path, rows: DataFrame, *order: str | Column) -> None:
    """One project's rows as a CSV file; keys and the columns of the order that are no part of it are left out."""
    path.parent.mkdir(parents=True, exist_ok=True)
    rows.orderBy(*order).drop("project_id", *[o for o in order if o in ("clip_idx", "media_id", "place")]).toPandas().to_csv(path, index=False, lineterminator="\r\n")


def _lines(path: Path, rows: DataFrame, *order: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f"{r['line']}\n" for r in rows.orderBy(*order).collect()), encoding="utf-8")


def _listed(spark: SparkSession, path: str | None) -> DataFrame:
    """(event_id, name) of a list file; none where there is no file."""
    if path is None or not Path(path).exists():
        return spark.createDataFrame([], "event_id bigint, name string")
    return ingest.read_list(spark, path)


def any_of(lists: DataFrame) -> Column:
    """Whether a shot's name or event is on a list, a small file."""
    rows = lists.collect()
    return F.col("name").isin([r["name"] for r in rows if r["name"]]) | F.col("event_id").isin([r["event_id"] for r in rows if r["event_id"] is not None])


def review(spark: SparkSession, folder: str, features: str, output: str, project: Project, probe: Callable[[str], str] = ingest.ffprobe) -> None:
    """Candidates, events and lists to fill in, as files below output/review."""
    out = Path(output)
    material, _ = taken_in(spark, folder, features, out, project, probe)
    shots = store.written(told(sequence.assign_events(material.shots, KEYS, "source", "ts", "media_id")), "shots")
    _csv(out / "review" / "candidates.csv", reports.candidate_rows(shots), "place")
    _csv(out / "review" / "events.csv", reports.event_rows(shots), "event_id")
    for name, title in (("favorites", "Favorites: uncomment items to force-include them"), ("exclude", "Exclude: uncomment items to force-exclude them")):
        _lines(out / "review" / f"{name}_template.txt", reports.list_lines(shots, title), "part", "at")


def timeline_of(clips: DataFrame, shots: DataFrame) -> DataFrame:
    """Planned clips with what reports say of their shots."""
    return clips.join(shots.select("project_id", "media_id", "source", "name", "highlight_reason", "window_score"), ["project_id", "media_id"])


def alternates_of(timeline: DataFrame, shots: DataFrame) -> DataFrame:
    """For each clip the best unused shot of its event, from its start, for as long as the clip at most."""
    free = reports.left_out(timeline, shots)
    best = summary.best_alternatives(timeline, free.unionByName(shots.join(timeline.select("project_id", "media_id"), ["project_id", "media_id"], "left_semi")))
    own = free.select("project_id", F.col("media_id").alias("alt_media_id"), F.col("source"), F.col("name"), F.col("start").alias("in_point"), F.col("end").alias("__end"))
    rows = best.select("project_id", "clip_idx", "alt_media_id").join(own, ["project_id", "alt_media_id"]).join(timeline.select("project_id", "clip_idx", "timeline_start", "timeline_end"), ["project_id", "clip_idx"])
    return rows.withColumns({"out_point": F.least(F.col("in_point") + F.col("timeline_end") - F.col("timeline_start"), "__end"), "transition_in": F.lit("cut"), "transition_out": F.lit("cut"), "transition_duration": F.lit(0.0)})


def run(spark: SparkSession, folder: str, features: str, output: str, project: Project, seed: int | None = None, fast_preview: bool = False, favourites: str | None = None, exclude: str | None = None, probe: Callable[[str], str] = ingest.ffprobe) -> DataFrame:
    """The whole flow; gives the final clips and writes profile, sequence and reports below ``output``."""
    out = Path(output)
    project = replace(project, seed=project.seed if seed is None else seed)
    if fast_preview:
        project = replace(project, output=Output("1280x720", project.output.fps, 6))
    material, skipped = taken_in(spark, folder, features, out, project, probe)
    track = ingest.music_path(material.media, folder, project.music.file)
    liked, unliked = _listed(spark, favourites), _listed(spark, exclude)
    lists = not (liked.isEmpty() and unliked.isEmpty())
    every = material.shots.withColumn("event_id", F.lit(-1).cast("bigint"))
    # Events are not known yet, so here the lists' names count; events count in what is learned.
    shots = preference.apply_lists(every, liked.withColumn("event_id", F.lit(None).cast("bigint")), unliked.withColumn("event_id", F.lit(None).cast("bigint")), ["name", "event_id"]).drop("event_id", "is_favourite") if lists else every.drop("event_id")
    shots = store.written(told(sequence.assign_events(shots, KEYS, "source", "ts", "media_id")), "told")
    frames = material.frames.select("source", "frame_idx", "fps", S.frame_quality(S.sharpness_of(F.col("laplacian_var")), S.exposure_of(F.col("luma_mean")), F.col("n_faces")).alias("frame_score"))
    shots = shots.withColumn("overall", S.overall())
    rate = frames.groupBy("source").agg(F.max("fps").alias("fps"))
    seen = frames.drop("fps").join(shots.select("source", "media_id"), "source").select("media_id", "frame_idx", "frame_score")
    shots = sequence.best_window(shots.join(rate, "source", "left"), seen, fps=F.coalesce("fps", F.lit(30.0))).drop("fps")
    shots = store.written(shots, "shots")
    structure = structure_of(spark, features, str(Path(folder).resolve()), track)
    saved = out / "user_profile.json"
    wanted = shots.withColumn("preference", F.lit(0.0))
    if lists:
        unliked_before = told(sequence.assign_events(material.shots, KEYS, "source", "ts", "media_id")).withColumn("overall", S.overall()).filter(any_of(unliked))
        mark = F.when(any_of(liked), "favourite")
        pool = shots.withColumn("mark", mark).unionByName(unliked_before.withColumn("mark", F.lit("excluded")), allowMissingColumns=True)
        learned = reports.profile_row(preference.learn(pool), preference.learn_roles(pool))
        _json(saved, json.loads(learned.drop("project_id").select(F.to_json(F.struct("*"))).first()[0]))
    row = ingest.load_profile_row(spark, str(saved))
    if row is not None:
        profile = spark.createDataFrame([row], ingest.PROFILE)
        wanted = shots.crossJoin(F.broadcast(profile)).withColumn("preference", preference.adjustment(F.try_element_at("role_bias", "shot_role"))).drop(*profile.columns)  # one row
    ready = wanted.withColumns({"input_idx": F.col("media_id").cast("int"), "emotion": S.emotion(), "at": F.unix_micros(F.col("ts")), "hhmm": F.date_format("ts", "HH:mm")})
    numbers = shots.select("source").distinct().withColumn("source_id", F.dense_rank().over(Window.orderBy("source")).cast("bigint"))
    ready = ready.join(numbers, "source")
    planned = store.written(planner.plan(ready, project, structure), "planned")
    clips, told_rules = grammar.apply(planned)
    clips, told_rules = store.written(clips, "clips"), store.written(told_rules, "rules")
    for r in sequence.timeline_issues(clips.withColumns({"start_ms": F.col("timeline_start") * 1000, "end_ms": F.col("timeline_end") * 1000}), KEYS, ["clip_idx"]).collect():
        logger.warning("%s of %.2f s before clip %d", r["issue"], abs(r["gap_ms"]) / 1000, r["clip_idx"])
    timeline, before = store.written(timeline_of(clips, shots), "timeline"), store.written(timeline_of(planned, shots), "before")
    sources = material.media.withColumnRenamed("media_path", "source")
    why = {"start": F.col("timeline_start"), "score": F.col("total_score"), "why": F.col("selection_reason"), "source": F.col("name")}
    marks = summary.markers(timeline, KEYS, **why)
    xml = sinks.sequence_xml(sinks.xml_rows(timeline, sources), sinks.xml_rows(alternates_of(timeline, shots), sources), marks, track)
    (out / "premiere").mkdir(parents=True, exist_ok=True)
    (out / "premiere" / "sequence.xml").write_text(xml, encoding="utf-8")
    report = out / "report"
    whole = reports.report_rows(timeline, shots, structure, told_rules, skipped).drop("project_id")
    _json(report / "report.json", json.loads(whole.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]))
    _csv(report / "selected_clips.csv", reports.selected_rows(timeline), "clip_idx")
    _csv(report / "rejected_clips.csv", reports.rejected_rows(timeline, shots), "media_id")
    _lines(report / "story_notes.md", reports.note_lines(timeline, shots), "line_no")
    compared = reports.comparison_rows(before, timeline, shots, structure, project.target_duration_sec, track is not None).drop("project_id")
    facts = json.loads(compared.select(F.to_json(F.struct("*"))).first()[0])
    _json(report / "comparison.json", {"baseline": "before the rules", "target_duration_sec": project.target_duration_sec, "audio_probe": audio(track, probe)} | facts)
    return clips


def audio(track: str | None, probe: Callable[[str], str]) -> dict:
    """What is known of a music file's sound."""
    if track is None or not Path(track).exists():
        return {"exists": False}
    try:
        streams = json.loads(probe(track)).get("streams")
    except (OSError, ValueError):
        return {"exists": True, "probe_error": "probe_exception"}
    if streams is None:
        return {"exists": True, "probe_error": "ffprobe_failed"}
    first = next((s for s in streams if s.get("codec_type") == "audio"), None)
    if first is None:
        return {"exists": True, "audio_stream_found": False}
    return {"exists": True, "audio_stream_found": True, "codec": first.get("codec_name"), "channels": first.get("channels"), "sample_rate": first.get("sample_rate")}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, probe: Callable[[str], str] = ingest.ffprobe) -> int:
    """The commands run, review and version; gives the exit code."""
    import argparse

    from spindle import __version__

    parser = argparse.ArgumentParser(prog="spindle", description="Plans a cut of a folder of media.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version", help="show the version")
    for name in ("run", "review"):
        c = commands.add_parser(name)
        for short, long in (("-i", "--input"), ("-p", "--profile"), ("-o", "--output")):
            c.add_argument(short, long, required=True)
        c.add_argument("--features", help="folder of feature tables; by default <input>/features")
        c.add_argument("-w", "--max-workers", type=int, default=1, help="threads of a local session")
        c.add_argument("-v", "--verbose", action="store_true")
        if name == "run":
            c.add_argument("-s", "--seed", type=int)
            c.add_argument("--dry-run", action="store_true", help="reports only; nothing is ever rendered here")
            c.add_argument("--fast-preview", action="store_true")
            c.add_argument("--favorites")
            c.add_argument("--exclude")
    a = parser.parse_args(arguments)
    if a.command == "version":
        print(f"spindle {__version__}")
        return 0
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO)
    for what in (a.input, a.profile):
        if not Path(what).exists():
            print(f"does not exist: {what}")
            return 1
    own = spark or SparkSession.builder.master(f"local[{a.max_workers}]").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    features = a.features or str(Path(a.input) / "features")
    try:
        if a.command == "review":
            review(own, a.input, features, a.output, load_profile(a.profile), probe)
        else:
            clips = run(own, a.input, features, a.output, load_profile(a.profile), a.seed, a.fast_preview, a.favorites, a.exclude, probe)
            if not a.dry_run:
                sinks.write_json(sinks.render_commands(clips, load_profile(a.profile).output, a.seed or 0), str(Path(a.output) / "draft"))
    except NoMedia as e:
        logger.error("no usable media in %s", e)
        return NO_MEDIA
    except ingest.MusicNotFound as e:
        logger.error("%s", e)
        return NO_MUSIC
    return 0

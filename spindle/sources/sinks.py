"""Reports as files: JSON, CSV, text and the editor's XML.

Rows are made and written by Spark; only the XML of one project, a few hundred
clips, is put together on the driver.
"""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath
from urllib.parse import quote
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.functions import scores as S
from spindle.plans.templates import Output


def write_json(frame: DataFrame, path: str, whole: bool = False) -> None:
    """Rows as JSON; null fields are left out unless ``whole``."""
    frame.write.mode("overwrite").option("ignoreNullFields", not whole).json(path)


def write_csv(frame: DataFrame, path: str, two: tuple[str, ...] = (), four: tuple[str, ...] = ()) -> None:
    """Rows as CSV with a header; columns of ``two`` and ``four`` with so many decimals."""
    out = frame.withColumns({c: F.format_string("%.2f", c) for c in two} | {c: F.format_string("%.4f", c) for c in four})
    out.write.mode("overwrite").option("header", True).csv(path)


def render_commands(clips: DataFrame, output: Output = Output(), seed: int = 0) -> DataFrame:
    """What a renderer would be called with, clip by clip; rendering itself is outside."""
    size = f"{output.width}:{output.height}"
    fit = F.lit(f"scale={size}:force_original_aspect_ratio=decrease,pad={size}:(ow-iw)/2:(oh-ih)/2")
    rate = F.lit(f"-b:v {output.draft_bitrate_mbps}M")
    length = F.col("timeline_end") - F.col("timeline_start")
    moved = S.pan_zoom_filter(F.col("__motion"), length, output.width, output.height, output.fps)
    still = F.concat_ws(" ", F.lit("-loop 1 -vf"), F.concat(fit, F.lit(","), moved), rate, F.lit("-t"), length.cast("string"))
    cut = F.concat_ws(" ", F.lit("-ss"), F.col("in_point").cast("string"), F.lit("-t"), (F.col("out_point") - F.col("in_point")).cast("string"), F.lit("-vf"), fit, rate, F.lit("-an"))
    return clips.withColumn("__motion", S.pan_zoom(seed)).select("project_id", "clip_idx", "media_id", F.when(S.photo(), still).otherwise(cut).alias("arguments"))


def clip_items(clips: DataFrame, fps: int = 30) -> DataFrame:
    """Rows of the editor's clip items, all in frames; file ids count sources as they first appear."""
    from pyspark.sql.window import Window

    first = F.min("clip_idx").over(Window.partitionBy("project_id", "source_id"))
    rows = clips.withColumn("__first", first)
    rows = rows.withColumn("file_no", F.dense_rank().over(Window.partitionBy("project_id").orderBy("__first")))
    frame = lambda c: S.frames_of(F.col(c), fps)
    return rows.select("project_id", "clip_idx", "media_id", "source_id", "file_no", (F.col("clip_idx") == F.col("__first")).alias("file_is_new"), frame("timeline_start").alias("start"), frame("timeline_end").alias("end"), frame("in_point").alias("in"), frame("out_point").alias("out"), S.effect_name(F.col("transition_in")).alias("effect"))


def _add(parent: ET.Element, **texts: object) -> ET.Element:
    """Child elements with these texts, in this order; gives the parent back."""
    for tag, text in texts.items():
        ET.SubElement(parent, tag.rstrip("_")).text = str(text)
    return parent


def _rate(parent: ET.Element, fps: int) -> ET.Element:
    _add(ET.SubElement(parent, "rate"), timebase=fps, ntsc="FALSE")
    return parent


def _timecode(parent: ET.Element, fps: int) -> None:
    _add(_rate(ET.SubElement(parent, "timecode"), fps), string="00:00:00:00", frame=0, displayformat="NDF")


def _picture(parent: ET.Element, fps: int, width: int, height: int) -> None:
    _add(_rate(ET.SubElement(parent, "samplecharacteristics"), fps), width=width, height=height, anamorphic="FALSE", pixelaspectratio="Square", fielddominance="none")


class Bin:
    """The files of a sequence, numbered as they first appear: the first mention describes a file, later ones only name it."""

    def __init__(self, fps: int):
        self.fps, self.numbers = fps, {}

    def item(self, track: ET.Element, r, item_id: str, name: str, enabled: bool) -> ET.Element:
        new = r["source"] not in self.numbers
        number = self.numbers.setdefault(r["source"], len(self.numbers) + 1)
        item = ET.SubElement(track, "clipitem", id=item_id)
        _rate(_add(item, masterclipid=f"masterclip-{number}", name=name, enabled="TRUE" if enabled else "FALSE"), self.fps)
        _add(item, start=r["start"], end=r["end"], in_=r["in"], out=r["out"])
        file = ET.SubElement(item, "file", id=f"file-{number}")
        if new:
            shown = PurePosixPath(r["proxy_path"] or r["source"])
            _rate(_add(file, name=shown.name, pathurl=f"file://{quote(str(shown))}"), self.fps)
            _add(file, duration=r["file_frames"])
            _timecode(file, self.fps)
            _picture(ET.SubElement(ET.SubElement(file, "media"), "video"), self.fps, r["width"] or 1920, r["height"] or 1080)
        return item


def _transition(item: ET.Element, kind: str, frames: int, at_start: bool, fps: int) -> None:
    black = kind in ("fade_from_black", "fade_to_black")
    part = _add(_rate(ET.SubElement(item, "transitionitem"), fps), start=0 if at_start else -1, end=frames, alignment="start" if at_start else "end")
    _add(ET.SubElement(part, "effect"), name="Dip to Black" if black else "Cross Dissolve", effectid="DipToColorDissolve" if black else "CrossDissolve", effecttype="transition", mediatype="video")


def xml_rows(timeline: DataFrame, sources: DataFrame, fps: int = 30) -> DataFrame:
    """Clips in frames with what is known of their files: ``sources`` has source, proxy_path, width, height, duration_sec."""
    frame = lambda c: S.frames_of(F.col(c), fps)
    known = sources.select("source", "proxy_path", "width", "height", "duration_sec")
    rows = timeline.drop("width", "height", "duration_sec", "proxy_path").join(known, "source", "left")
    long = F.when(F.col("duration_sec") > 0, F.col("duration_sec")).otherwise(F.col("out_point"))
    return rows.select("clip_idx", "source", "name", "proxy_path", "width", "height", frame("timeline_start").alias("start"), frame("timeline_end").alias("end"), frame("in_point").alias("in"), frame("out_point").alias("out"), S.frames_of(long, fps).alias("file_frames"), "transition_in", "transition_out", frame("transition_duration").alias("transition_frames"))


def sequence_xml(clips: DataFrame, alternates: DataFrame | None = None, markers: DataFrame | None = None, music: str | None = None, name: str = "Sequence", fps: int = 30) -> str:
    """One project's sequence as XML: clips on V1, alternates (not enabled) on V2, markers in three layers, the music.

    ``clips`` and ``alternates`` are of xml_rows, ``markers`` of summary.markers.
    """
    rows = clips.orderBy("clip_idx").collect()  # a sequence: some hundred clips
    length, files = max((r["end"] for r in rows), default=0), Bin(fps)
    root = ET.Element("xmeml", version="5")
    seq = ET.SubElement(root, "sequence")
    _rate(_add(seq, uuid=uuid.uuid4(), name=name, duration=length), fps)
    _timecode(seq, fps)
    media = ET.SubElement(seq, "media")
    video = ET.SubElement(media, "video")
    _picture(ET.SubElement(video, "format"), fps, 1920, 1080)
    track = ET.SubElement(video, "track")
    for n, r in enumerate(rows, 1):
        item = files.item(track, r, f"clipitem-{n}", PurePosixPath(r["name"]).stem, True)
        for kind, at_start in ((r["transition_in"], True), (r["transition_out"], False)):
            if kind != "cut":
                _transition(item, kind, r["transition_frames"], at_start, fps)
    if alternates is not None:
        track = ET.SubElement(video, "track")
        for n, r in enumerate(alternates.orderBy("clip_idx").collect(), len(rows) + 1):
            files.item(track, r, f"clipitem-alt-{n}", f"[ALT] {PurePosixPath(r['name']).stem}", False)
    layers = {"chapter": 0, "event": 1, "highlight": 2}
    for r in sorted(markers.collect() if markers is not None else [], key=lambda r: (layers[r["kind"]], r["clip_idx"])):
        _add(ET.SubElement(seq, "marker"), name=r["name"], comment=r["comment"], in_=r["frame"], out=-1, color=r["colour"])
    if music:
        sound = ET.SubElement(media, "audio")
        _add(ET.SubElement(ET.SubElement(sound, "format"), "samplecharacteristics"), depth=16, samplerate=48000)
        item = ET.SubElement(ET.SubElement(sound, "track"), "clipitem", id="music-1")
        _rate(_add(item, masterclipid="masterclip-music-1", name=PurePosixPath(music).stem, enabled="TRUE"), fps)
        _add(item, start=0, end=length, in_=0, out=length)
        file = ET.SubElement(item, "file", id="music-file-1")
        _rate(_add(file, name=PurePosixPath(music).name, pathurl=f"file://{quote(music)}"), fps)
        _timecode(file, fps)
        audio = ET.SubElement(ET.SubElement(file, "media"), "audio")
        _add(ET.SubElement(audio, "samplecharacteristics"), depth=16, samplerate=48000)
        _add(audio, channelcount=2)
    ET.indent(root, space="  ")
    return ET.tostring(root, encoding="unicode", xml_declaration=True)

"""The commands from a folder to files, with made-up features and a probe that reads none."""

import csv
import json
import random
import re
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from spindle.plans import studio
from spindle.sources import ingest


def made_up_probe():
    """A probe that is sent to workers as it is, as they don't know this module."""

    def probe(path):
        import json
        import re

        name = path.rsplit("/", 1)[-1]
        at = int((re.findall(r"\d+", name) or ["0"])[0])
        kind = "audio" if path.endswith("mp3") else "video"
        tags = {"creation_time": f"2024-05-0{1 + at // 4}T10:{at:02d}:00.000000Z"}
        return json.dumps({"streams": [{"codec_type": kind, "codec_name": "x", "channels": 2, "sample_rate": "48000", "width": 1920, "height": 1080, "r_frame_rate": "10/1"}], "format": {"duration": "12.0", "tags": tags}})

    return probe


probe = made_up_probe()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("media"), random.Random(3)
    names = [f"v{i}.mov" for i in range(8)] + ["p8.jpg", "p9.png", "raw7.dng", "song.mp3"]
    for n in names:
        (root / n).write_text(f"content of {n}")
    (root / "copy1.mov").write_text("content of v1.mov")
    frames = []
    for n in names[:8]:
        for f in range(120):
            cut = f // 24 % 2
            frames.append((n, f, 10.0, f / 10, 12.0, [1.0, 0.0] if cut else [0.0, 1.0], rng.uniform(0, 5), 90.0 + 60 * cut, rng.uniform(0, 700), rng.uniform(0, 0.1), rng.randrange(3), rng.uniform(0, 8), rng.uniform(0, 40)))
    frames += [(n, 0, 1.0, 0.0, 0.0, [1.0], 0.0, 120.0, 300.0, 0.05, 1, None, 0.0) for n in names[8:10]]
    schema = "path string, frame_idx int, fps double, ts_sec double, end_sec double, hist array<double>, flow_mag double, luma_mean double, laplacian_var double, face_ratio double, n_faces int, flow_next double, diff_next double"
    features = tmp_path_factory.mktemp("features")
    spark.createDataFrame(frames, schema).write.parquet(str(features / "frames.parquet"))
    spark.createDataFrame([("song.mp3", i, i / 2, 1.0 if 40 <= i < 80 else 0.2 + 0.001 * i) for i in range(160)], "path string, frame int, t double, value double").write.parquet(str(features / "rms.parquet"))
    spark.createDataFrame([("song.mp3", i / 2) for i in range(160)], "path string, t double").write.parquet(str(features / "beats.parquet"))
    (root.parent / "profile.yaml").write_text("project_type: growth\ntarget_duration_sec: 60\n")
    return root, features, root.parent / "profile.yaml"


def test_run_writes_all_files(spark, folder, tmp_path, monkeypatch):
    root, features, profile = folder
    (tmp_path / "fav.txt").write_text("v2.mov\n")
    (tmp_path / "exc.txt").write_text("# no\nv3.mov\n")
    done = studio.main(["run", "-i", str(root), "-p", str(profile), "-o", str(tmp_path / "out"), "--features", str(features), "--favorites", str(tmp_path / "fav.txt"), "--exclude", str(tmp_path / "exc.txt"), "-s", "4"], spark, probe)
    out = tmp_path / "out"
    assert done == 0
    index = json.loads((out / "media_index.json").read_text())
    assert len(index) == 12 and [r["path"] for r in index] == sorted(r["path"] for r in index) and "gps_lat" not in index[0]  # copy1.mov is the first of the two
    report = json.loads((out / "report" / "report.json").read_text())
    assert set(report) == {"kpi_summary", "summary", "chapter_energy", "story_structure", "role_coverage", "chapter_role_coverage_rate", "section_role_stats", "rhythm_alignment", "grammar_violations", "event_summary", "skipped_dng", "selected_clips", "rejected_count"}
    assert report["skipped_dng"][0]["file"] == "raw7.dng" and report["section_role_stats"]["available"] and {s["label"] for s in report["rhythm_alignment"]["sections"]}
    selected = list(csv.DictReader((out / "report" / "selected_clips.csv").open(newline="")))
    rejected = list(csv.DictReader((out / "report" / "rejected_clips.csv").open(newline="")))
    assert len(selected) == report["summary"]["total_clips"] == len(report["selected_clips"]) > 5 and len(rejected) == report["rejected_count"]
    assert len(selected[0]) == 15 and (not rejected or len(rejected[0]) == 14) and not any("v3.mov" in r["source"] for r in selected)
    assert re.fullmatch(r"\d+\.\d\d", selected[0]["in_point"]) and re.fullmatch(r"\d\.\d{4}", selected[0]["sharpness"])
    xml = ET.parse(out / "premiere" / "sequence.xml").getroot()
    tracks = xml.findall("./sequence/media/video/track")
    assert len(tracks) == 2 and len(tracks[0]) == len(selected) and all(i.findtext("enabled") == "FALSE" for i in tracks[1])
    assert {m.findtext("color") for m in xml.findall("./sequence/marker")} >= {"Blue", "Green"} and xml.find("./sequence/media/audio/track/clipitem").findtext("name") == "song"
    files = [i.find("file") for i in tracks[0]]
    assert all((f.find("pathurl") is not None) == (f.get("id") not in [g.get("id") for g in files[:k]]) for k, f in enumerate(files))
    assert tracks[0][0].find("transitionitem/effect/name").text == "Dip to Black"
    profile_row = json.loads((out / "user_profile.json").read_text())
    assert profile_row["sample_count"] > 0 and ingest.load_profile_row(spark, str(out / "user_profile.json"))["face_bias"] == profile_row["face_bias"]
    compared = json.loads((out / "report" / "comparison.json").read_text())
    assert len(compared["delta"]) == 8 and compared["audio_probe"]["channels"] == 2
    notes = (out / "report" / "story_notes.md").read_text()
    assert notes.startswith("# Story Notes\nTotal duration: ") and "## opening" in notes
    assert spark.read.json(str(out / "draft")).count() == len(selected)


def test_review_writes_lists(spark, folder, tmp_path):
    root, features, profile = folder
    assert studio.main(["review", "-i", str(root), "-p", str(profile), "-o", str(tmp_path), "--features", str(features)], spark, probe) == 0
    rows = list(csv.DictReader((tmp_path / "review" / "candidates.csv").open(newline="")))
    best = [float(r["overall_quality"]) for r in rows]
    assert len(rows[0]) == 15 and best == sorted(best, reverse=True)
    events = list(csv.DictReader((tmp_path / "review" / "events.csv").open(newline="")))
    assert list(events[0]) == ["event_id", "shot_count", "total_duration", "avg_quality", "emotion_intensity", "time_range", "action"] and len(events) == 3 and events[0]["time_range"] == "10:00 - 10:03"
    lines = (tmp_path / "review" / "favorites_template.txt").read_text().splitlines()
    assert lines[0].startswith("# Favorites") and f"# event:0  ({events[0]['shot_count']} shots, 10:00 - 10:03)" in lines and lines[-1] == "# v7.mov" and "# p8.jpg" in lines


def test_commands_say_what_is_wrong(spark, folder, tmp_path, capsys):
    root, features, profile = folder
    assert studio.main(["version"]) == 0 and capsys.readouterr().out.startswith("spindle ")
    assert studio.main(["run", "-i", str(tmp_path / "none"), "-p", str(profile), "-o", str(tmp_path / "o")], spark, probe) == 1
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "song.mp3").write_text("x")
    assert studio.main(["review", "-i", str(tmp_path / "in"), "-p", str(profile), "-o", str(tmp_path / "o")], spark, probe) == studio.NO_MEDIA
    (tmp_path / "p.yaml").write_text("music: {file: missing.mp3}\n")
    assert studio.main(["run", "-i", str(root), "-p", str(tmp_path / "p.yaml"), "-o", str(tmp_path / "o2"), "--features", str(features)], spark, probe) == studio.NO_MUSIC
    assert ingest.load_profile_row(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "bad.json").write_text("{")
    assert ingest.load_profile_row(spark, str(tmp_path / "bad.json")) is None and ingest.tools(("no-such-tool",)) == {"no-such-tool": False} and ingest.ffprobe("none.mov") == "{}"


def test_middle_frames_are_measured(spark):
    shots = spark.createDataFrame([("a", 0, 0.0, 2.0, "video"), ("a", 1, 5.0, 6.0, "video"), ("b", 0, 0.0, 4.0, "photo")], "source string, shot_index int, start double, end double, media_type string")
    frames = spark.createDataFrame([("a", i, 10.0, 100.0 * i, 128.0, 0.0, 0, None if i % 2 else 10.0, float(i)) for i in range(20)] + [("b", 0, 1.0, 250.0, 20.0, 0.01, 2, None, None)], "source string, frame_idx int, fps double, laplacian_var double, luma_mean double, face_ratio double, n_faces int, flow_next double, diff_next double")
    got = {(r["source"], r["shot_index"]): r for r in studio.score_shots(shots, frames).collect()}
    a, none, b = got["a", 0], got["a", 1], got["b", 0]
    # 20 frames in steps of 2: the first 8 are 0, 2, ... 14, the middle one 8, the first five pairs begin at 0 to 8.
    assert a["sharpness"] == 1.0 and a["exposure"] == 1.0 and a["stability"] == 0.5 and a["motion_intensity"] == 4.0 / 40 and a["face_score"] == 0.0
    assert (none["sharpness"], none["stability"]) == (0.0, 0.0)
    assert (b["sharpness"], b["exposure"], b["stability"], b["motion_intensity"]) == (0.5, 0.5, 1.0, 0.0) and b["face_score"] == pytest.approx(0.3)
    assert spark.range(1).select(F.lit(1)).count() == 1

"""Kernels over pixels against plain loops and known shifts; files read frame by frame; the flow from such files alone."""

import math
import random
import struct
import wave
import zlib

import duckdb
import numpy as np
import pytest

from spindle.functions import pixels
from spindle.plans import catalog, studio, templates, track_queries
from spindle.sources import frames

SF = "/root/testdata/sf0.001"


def picture(seed, height=120, width=160):
    """Smooth random blobs of colour."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    out = np.zeros((height, width, 3))
    for _ in range(height * width // 60):
        cy, cx, size = rng.uniform(0, height), rng.uniform(0, width), rng.uniform(1.5, 4)
        out += np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * size**2))[..., None] * rng.uniform(-120, 120, 3)
    return np.clip(out + 128, 0, 255).astype(np.uint8)


def test_colour_kernels_are_plain_loops():
    rng = np.random.default_rng(1)
    p = rng.integers(0, 256, (9, 11, 3)).astype(np.uint8)
    p[0, :3] = [[0, 0, 0], [255, 255, 255], [7, 7, 7]]
    counts = [0.0] * 3000
    for b, g, r in p.reshape(-1, 3).astype(int).tolist():
        top, low = max(b, g, r), min(b, g, r)
        if top == low:
            hue = 0.0
        elif top == r:
            hue = 60 * (g - b) / (top - low)
        elif top == g:
            hue = 60 * (2 + (b - r) / (top - low))
        else:
            hue = 60 * (4 + (r - g) / (top - low))
        hue = round((hue + 360 if hue < 0 else hue) / 2) % 180
        sat = round(255 * (top - low) / top) if top else 0
        counts[int(hue * 50 / 180) * 60 + int(sat * 60 / 256)] += 1
    length = math.sqrt(sum(c * c for c in counts))
    assert pixels.histogram(p).tolist() == pytest.approx([c / length for c in counts])
    g = [[(1868 * int(b) + 9617 * int(k) + 4899 * int(r) + 8192) >> 14 for b, k, r in row] for row in p]
    assert pixels.grey(p).tolist() == g
    at = lambda y, x: g[abs(y) if y < 9 else 16 - y][abs(x) if x < 11 else 20 - x]
    edges = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(9) for x in range(11)]
    mean = sum(edges) / len(edges)
    assert pixels.laplacian_variance(p) == pytest.approx(sum((e - mean) ** 2 for e in edges) / len(edges))
    one = np.full((1, 1, 3), 9, np.uint8)
    assert pixels.laplacian_variance(one) == 0 and pixels.flow(one, one) is None and pixels.histogram(one).max() == 1


def test_queries_over_pictures(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = catalog.QUERIES["picture_edges"](spark, SF).select("laplacian_var", "luma_mean", "vec_id").collect()
    want = con.sql(f"SELECT laplacian_var, luma_mean, vec_id FROM ({catalog.ORACLES['picture_edges']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and want
    filled = {r["vec_id"]: r["bins"] for r in track_queries.picture_colours(spark, SF).collect()}
    row = spark.read.parquet(f"{SF}/embeddings.parquet").first()
    g = [int(min(abs(x), 1.0) * 255) for x in row["embedding"]]
    bins = set()
    for y in range(8):
        for x in range(8):
            b, k, r = g[8 * y + x], g[8 * x + y], g[8 * y + 7 - x]
            top, low = max(b, k, r), min(b, k, r)
            hue = 0 if top == low else 60 * ((k - b) / (top - low) if top == r else 2 + (b - r) / (top - low) if top == k else 4 + (r - k) / (top - low))
            bins.add(int(round((hue + 360 if hue < 0 else hue) / 2) % 180 * 50 / 180) * 60 + int((round(255 * (top - low) / top) if top else 0) * 60 / 256))
    assert filled[row["vec_id"]] == ",".join(map(str, sorted(bins)))


@pytest.mark.parametrize("dx, dy", [(0, 0), (1, 0), (3, -2), (7, 5), (-12, 4)])
def test_known_shifts_are_found(dx, dy):
    big = picture(3, 200, 240)
    a, b = big[40:160, 40:200], big[40 - dy : 160 - dy, 40 - dx : 200 - dx]
    assert pixels.flow(a, b) == pytest.approx(math.hypot(dx, dy), abs=0.3)
    points = pixels.corners(a)
    assert pixels.FEWEST <= len(points) <= pixels.CORNERS
    assert all(math.dist(p, q) >= pixels.APART for i, p in enumerate(points) for q in points[:i])


def test_few_corners_give_no_flow():
    flat = np.full((60, 60), 90, np.uint8)
    dot = flat.copy()
    dot[20:30, 20:30] = 200
    assert pixels.flow(flat, flat) is None and pixels.flow(dot, dot) is None


def write_png(path, p, kinds=(0, 1, 2, 3, 4)):
    """A PNG whose rows take turns in how they are filtered."""
    rgb = p[..., ::-1].astype(int)
    height, width, n = rgb.shape
    flat = rgb.reshape(height, width * n)
    body = b""
    for y in range(height):
        k = kinds[y % len(kinds)]
        up = flat[y - 1] if y else np.zeros(width * n, int)
        left, corner = np.r_[np.zeros(n, int), flat[y][:-n]], np.r_[np.zeros(n, int), up[:-n]]
        est = left + up - corner
        da, db, dc = abs(est - left), abs(est - up), abs(est - corner)
        guess = [0, left, up, (left + up) // 2, np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))][k]
        body += bytes([k]) + ((flat[y] - guess) & 255).astype(np.uint8).tobytes()
    box = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    packed = zlib.compress(body)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + box(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + box(b"IDAT", packed[:50]) + box(b"IDAT", packed[50:]) + box(b"IEND", b""))


def write_mov(path, pictures, fps=10):
    height, width, _ = pictures[0].shape
    box = lambda kind, *data: struct.pack(">I4s", 8 + sum(map(len, data)), kind) + b"".join(data)
    start = 8 + 8 + 8
    size = width * height * 3
    described = struct.pack(">I4s", 86, b"raw ") + bytes(6) + struct.pack(">H", 1) + bytes(16) + struct.pack(">HH", width, height) + bytes(46) + struct.pack(">Hh", 24, -1)
    chunks = [start + size * i for i in range(0, len(pictures), 3)]
    tables = box(b"stsd", struct.pack(">II", 0, 1), described) + box(b"stts", struct.pack(">IIII", 0, 1, len(pictures), 1)) + box(b"stsz", struct.pack(">III", 0, size, len(pictures)))
    last = len(pictures) - 3 * (len(chunks) - 1)
    runs = [(1, 3, 1)] * (len(chunks) > 1) + ([(len(chunks), last, 1)] if last != 3 or len(chunks) == 1 else [])
    tables += box(b"stsc", struct.pack(">II", 0, len(runs)), *(struct.pack(">III", *r) for r in runs)) + box(b"stco", struct.pack(f">II{len(chunks)}I", 0, len(chunks), *chunks))
    media = box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, fps, len(pictures), 0, 0)) + box(b"hdlr", bytes(8) + b"vide" + bytes(13)) + box(b"minf", box(b"stbl", tables))
    path.write_bytes(box(b"ftyp", b"qt  " + bytes(4)) + box(b"mdat", *(p[..., ::-1].tobytes() for p in pictures)) + box(b"moov", box(b"trak", box(b"mdia", media))))


def write_wav(path, samples, rate=22050):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.repeat((np.clip(samples, -1, 1) * 32767).astype("<i2"), 2).tobytes())


def test_frames_of_files(spark, tmp_path):
    pictures = [picture(i // 5, 48, 64) for i in range(11)]
    write_mov(tmp_path / "a.mov", pictures)
    write_png(tmp_path / "b.png", pictures[0])
    (tmp_path / "c.mov").write_bytes((tmp_path / "a.mov").read_bytes()[:-40])
    (tmp_path / "d.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"x" * 30)
    (tmp_path / "e.mov").write_bytes(b"")
    files = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in ("a.mov", "b.png", "c.mov", "d.png", "e.mov", "gone.mov", "f.txt")], "path string")
    rows = frames.frame_rows(files, back=3, size=4).orderBy("path", "frame_idx").collect()
    assert [(r["path"][-5:], r["frame_idx"]) for r in rows] == [("a.mov", i) for i in range(11)] + [("b.png", 0)]
    for r in rows[:11]:
        p, i = pictures[r["frame_idx"]], r["frame_idx"]
        assert (r["fps"], r["ts_sec"], r["end_sec"], r["luma_mean"]) == (10.0, i / 10, 1.1, pixels.grey(p).mean()) and r["hist"] == pixels.histogram(p).tolist()
        assert r["flow_mag"] == ((pixels.flow(pictures[i - 3], p) or 0.0) if i >= 3 else 0.0)
        assert r["diff_next"] == (pixels.difference(p, pictures[i + 1]) if i < 10 else 0.0)
    assert rows[-1]["hist"] == pixels.histogram(pictures[0]).tolist() and rows[-1]["laplacian_var"] == pixels.laplacian_variance(pictures[0])


@pytest.mark.parametrize("rate", [22050, 44100, 16000])
def test_loudness_of_files(spark, tmp_path, rate):
    rng = random.Random(rate)
    sound = np.array([rng.uniform(-1, 1) * (0.2 + 0.8 * (i // 9000 % 2)) for i in range(30_000)])
    write_wav(tmp_path / "a.wav", sound, rate)
    (tmp_path / "b.wav").write_bytes(b"RIFF")
    rows = frames.rms_rows(spark.createDataFrame([(f"{tmp_path}/a.wav",), (f"{tmp_path}/b.wav",)], "path string"), size=7).orderBy("frame").collect()
    heard, scale = (np.clip(sound, -1, 1) * 32767).astype(int) / 32768, rate / 22050
    long = round(2048 * scale)
    assert len(rows) == 1 + int(30_000 / scale) // 512
    for r in rows:
        a = round(r["frame"] * 512 * scale) - long // 2
        part = [heard[i] if 0 <= i < len(heard) else 0.0 for i in range(a, a + long)]
        assert r["value"] == pytest.approx(math.sqrt(sum(x * x for x in part) / long), abs=1e-9) and r["t"] == r["frame"] * 512 / 22050


def test_run_needs_no_tables_of_features(spark, tmp_path):
    """Three movies with a cut each, a still and a track with clicks: shots and beats are found in the files."""
    root = tmp_path / "media"
    root.mkdir()
    for k in range(3):
        blue, red = ((picture(10 * k + i, 60, 80) * np.array(tint)).astype(np.uint8) for i, tint in enumerate(((1.0, 0.2, 0.1), (0.1, 0.2, 1.0))))
        write_mov(root / f"v{k}.mov", [blue] * 20 + [red] * 20)
    write_png(root / "still.png", picture(99, 40, 40))
    clicks = np.zeros(22050 * 30)
    for i in range(59):
        clicks[int((0.25 + i * 0.5) * 22050) :][:400] = 0.9
    write_wav(root / "song.wav", clicks)
    seen = studio.taken_in(spark, str(root), None, tmp_path / "out", templates.Project(), lambda p: "{}")[0]
    shots = seen.shots.filter("media_type = 'video'").orderBy("source", "shot_index").collect()
    assert [(r["source"][-6:], r["start"], r["end"]) for r in shots] == [(f"v{k}.mov", a, b) for k in range(3) for a, b in ((0.0, 2.1), (2.1, 4.0))]
    found = studio.structure_of(spark, None, str(root), f"{root}/song.wav")
    assert len(found.beats) > 50 and all(min(abs(b - 0.25 - i * 0.5) for i in range(59)) < 0.06 for b in found.beats) and found.curve
    clips = studio.run(spark, str(root), None, str(tmp_path / "out"), templates.Project(target_duration_sec=10), probe=lambda p: "{}")
    assert clips.count() >= 3 and (tmp_path / "out").exists()

"""Joins of two tables on time, beats and sections of tracks, and plans on a track per project, against plain loops."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators import joins, planner, structure
from spindle.plans import catalog, templates, track_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["interval_pairs", "section_of_clip", "nearest_beat_of_track", "energy_of_track"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want)) and want


def test_interval_join_is_a_plain_loop(spark):
    """A key with a third of all rows, intervals of a moment and of a thousand buckets, ends that touch, empty and null ones."""
    rng = random.Random(1)
    key = lambda: "hot" if rng.random() < 0.34 else rng.choice("abc")
    points = [(i, key(), rng.choice((rng.uniform(-50, 2000), float(rng.randrange(0, 2000, 10))))) for i in range(400)] + [(1000, "a", None), (1001, None, 5.0)]
    cuts = [(j, key(), a, a + rng.choice((0.0, -5.0, 0.001, 10.0, 35.0, 900.0, 12000.0))) for j in range(120) for a in [float(rng.randrange(-100, 2000, 5))]] + [(500, "a", None, 5.0), (501, "a", 1.0, None), (502, None, 0.0, 9.0)]
    p = spark.createDataFrame(points, "id int, k string, t double")
    c = spark.createDataFrame(cuts, "cut int, k string, a double, b double")
    found = joins.interval_join(p, c, ["k"], "t", "a", "b", 10.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = sorted((i, j) for i, k, t in points for j, m, a, b in cuts if k is not None and k == m and t is not None and a is not None and b is not None and a <= t < b)
    assert sorted((r["id"], r["cut"]) for r in found.collect()) == want and len(want) > 500
    first = joins.first_interval(p, c, ["k"], ["id"], "t", "a", "b", "cut", 10.0).collect()
    by_id = {i: min((a, b, j) for j, m, a, b in cuts if (i, j) in set(want) and m == k)[2] for i, k, _ in points if any(x == i for x, _ in want)}
    assert {r["id"]: r["cut"] for r in first} == {i: by_id.get(i) for i, _, _ in points}
    assert joins.interval_join(p.limit(0), c, ["k"], "t", "a", "b").count() == 0 and joins.interval_join(p, c.limit(0), ["k"], "t", "a", "b").count() == 0


@pytest.mark.parametrize("width", [0.5, 7.0, 1e6])
def test_nearest_and_interpolated_are_plain_loops(spark, width):
    rng = random.Random(2)
    key = lambda: "hot" if rng.random() < 0.4 else rng.choice("abcd")
    left = [(i, key(), rng.choice((rng.uniform(0, 60), float(rng.randrange(60))))) for i in range(200)] + [(900, "none", 3.0), (901, "a", None)]
    right = [(key(), float(rng.randrange(0, 60, 3)), rng.randrange(10) / 10) for _ in range(80)] + [("late", 1.0, 0.5), ("a", None, 0.1)]
    a, b = spark.createDataFrame(left, "id int, k string, t double"), spark.createDataFrame(right, "k string, t double, e double")
    near, curve = {}, {}
    for i, k, t in left:
        own = sorted((x, e) for m, x, e in right if m == k and x is not None)
        near[i] = min((abs(x - t), x) for x, _ in own)[1] if own and t is not None else None
        before, after = [p for p in own if t is not None and p[0] < t], [p for p in own if t is not None and p[0] >= t]
        if t is None:
            curve[i] = None
        elif not own:
            curve[i] = 0.5
        elif not before or not after:
            curve[i] = (after or before[-1:])[0][1]
        else:
            (t0, e0), (t1, e1) = before[-1], after[0]
            curve[i] = e0 + (e1 - e0) * ((t - t0) / (t1 - t0))
    got = joins.nearest(a, b, ["k"], "t", width).collect()
    assert {r["id"]: r["near"] for r in got} == near and len(got) == len(left)
    assert all(r["distance"] == (None if near[r["id"]] is None else abs(near[r["id"]] - r["t"])) for r in got)
    assert {r["id"]: r["e"] for r in joins.interpolated(a, b, ["k"], "t", "e", width=width).collect()} == curve


def plain_beats(loud, rate):
    """Tempo and beat frames, a loop at a time."""
    level = [10 * math.log10(max(v * v, 1e-10)) for v in loud]
    level = [max(x, max(level) - 80) for x in level]
    onset = [0.0] + [max(0.0, y - x) for x, y in zip(level, level[1:])]
    if len(loud) < 2 or not any(onset):
        return 0.0, []
    lags = range(1, min(len(onset), max(2, int(8 * rate))))
    wide = [x + 0.5 * ((onset[i - 1] if i else 0) + (onset[i + 1] if i + 1 < len(onset) else 0)) for i, x in enumerate(onset)]
    zero = sum(x * x for x in wide)
    weigh = lambda lag: math.log1p(1e6 * sum(wide[i] * wide[i + lag] for i in range(len(wide) - lag)) / zero) - 0.5 * math.log2(60 * rate / lag / 120) ** 2
    bpm = 60 * rate / max(lags, key=weigh)
    period = max(1, round(60 * rate / bpm))
    mean = sum(onset) / len(onset)
    spread = math.sqrt(sum((x - mean) ** 2 for x in onset) / (len(onset) - 1)) or 1.0
    local = [sum(onset[j] / spread * math.exp(-0.5 * ((j - i) * 32 / period) ** 2) for j in range(max(0, i - period), min(len(onset), i + period + 1))) for i in range(len(onset))]
    score, back, started = [], [], False
    for i, own in enumerate(local):
        tried = [(-100 * math.log(s / period) ** 2 + (score[i - s] if i - s >= 0 else 0.0), -s) for s in range(2 * period, max(1, round(period / 2)) - 1, -1)]
        best = max(tried, key=lambda x: x[0])
        score.append(own + best[0])
        started = started or own >= 0.01 * max(local)
        back.append(i + best[1] if started and i + best[1] >= 0 else -1)
    peaks = [i for i in range(1, len(score)) if score[i] > score[i - 1] and (i == len(score) - 1 or score[i] >= score[i + 1])]
    if not peaks:
        return bpm, []
    at = max(i for i in peaks if 2 * score[i] > np.median([score[k] for k in peaks]))
    chain = []
    while at >= 0:
        chain.insert(0, at)
        at = back[at]
    s = [local[i] for i in chain]
    smooth = [s[i] + 0.5 * ((s[i - 1] if i else 0) + (s[i + 1] if i + 1 < len(s) else 0)) for i in range(len(s))]
    bar = 0.5 * math.sqrt(sum(x * x for x in smooth) / len(smooth))
    strong = [i for i, x in enumerate(smooth) if x > bar]
    return bpm, chain[strong[0] : strong[-1] + 1] if strong else []


def test_beats_are_those_of_a_plain_loop(spark):
    rows = track_queries.loudness(spark, SF).collect()
    loud = {}
    for r in sorted(rows, key=lambda r: r["frame"]):
        loud.setdefault(r["project_id"], []).append(r["v"])
    got = {r["project_id"]: r for r in structure.track_beats(track_queries.loudness(spark, SF), ["project_id"], "frame", "t", "v").collect()}
    assert set(got) == set(loud)
    for k, v in loud.items():
        bpm, at = plain_beats(v, 10.0)
        assert got[k]["tempo"] == pytest.approx(bpm) and got[k]["beats"] == pytest.approx([i / 10 for i in at])
    assert sum(len(r["beats"]) for r in got.values()) > 50


@pytest.mark.parametrize("bpm", [90, 120, 150])
def test_clicks_are_found_within_a_frame(spark, bpm):
    rate, rng = 43.0, random.Random(bpm)
    clicks = [0.3 + i * 60 / bpm for i in range(40)]
    level = [0.01 + 0.002 * rng.random() for _ in range(int((clicks[-1] + 1) * rate))]
    for c in clicks:
        level[round(c * rate)] = 1.0
    rms = spark.createDataFrame([(1, i, i / rate, v) for i, v in enumerate(level)] + [(2, 0, 0.0, 1.0)] + [(3, i, i / rate, 0.0) for i in range(50)], "track int, frame int, t double, v double")
    got = {r["track"]: r for r in structure.track_beats(rms, ["track"], "frame", "t", "v").collect()}
    assert abs(got[1]["tempo"] - bpm) < 5 and (got[2]["tempo"], got[2]["beats"]) == (0.0, []) == (got[3]["tempo"], got[3]["beats"])
    assert all(min(abs(b - c) for c in clicks) <= 1 / rate + 1e-9 for b in got[1]["beats"]) and len(got[1]["beats"]) >= 38


def plain_segments(vectors, k):
    parts = [[i] for i in range(len(vectors))]

    def added(a, b):
        x, y = np.mean([vectors[i] for i in a], axis=0), np.mean([vectors[i] for i in b], axis=0)
        return float(((x - y) ** 2).sum()) * len(a) * len(b) / (len(a) + len(b))

    while len(parts) > k:
        at = min(range(len(parts) - 1), key=lambda i: added(parts[i], parts[i + 1]))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [p[0] for p in parts]


def test_segments_are_those_of_a_plain_loop(spark):
    rows = track_queries.chroma(spark, SF)
    by_track = {}
    for r in sorted(rows.collect(), key=lambda r: r["frame"]):
        scale = lambda v: np.array(v, float) / (np.abs(v).max() or 1.0)
        by_track.setdefault(r["label"], []).append(np.r_[scale(r["pitch"]), scale(r["timbre"])])
    got = {r["label"]: r["points"] for r in structure.structural_points(rows, ["label"], "frame", "t", ["pitch", "timbre"], "end").collect()}
    assert got == {k: [2.0 * i for i in plain_segments(v, max(4, min(8, int(2.0 * len(v) / 20))))] for k, v in by_track.items()}
    rng = np.random.default_rng(3)
    for _ in range(20):
        blocks = np.repeat(rng.normal(size=(5, 6)) * 10, rng.integers(2, 9, 5), axis=0)
        v = blocks + rng.normal(size=blocks.shape) * 0.01
        starts = [0, *(i for i in range(1, len(v)) if abs(blocks[i] - blocks[i - 1]).any())]
        assert structure.segments(v, 5) == starts == plain_segments(v, 5)
    assert structure.segments(np.zeros((3, 2)), 8) == [0, 1, 2] and structure.segments(np.zeros((0, 2)), 4) == []
    bounds = [r["start"] for r in track_queries.structural_sections(spark, SF).filter("track = 0").orderBy("idx").collect()]
    assert bounds and set(bounds) <= {0.0, *got[0]}


def test_each_project_is_planned_on_its_own_track(spark):
    """Two songs and none: each project's plan is that of the song given alone."""
    shots = catalog.plan_input(spark, SF).filter("project_id IN (1, 2, 3)").cache()
    quiet = templates.Music(tuple(i * 0.7 for i in range(500)), (), (templates.Section("verse", 0.0, 400.0, 0.2),), ((0.0, 0.1), (400.0, 0.1)))
    songs = {1: templates.TRACK, 2: quiet}
    rows = [(k, list(m.beats), [(x.label, x.start, x.end, x.energy) for x in m.sections], list(m.high), list(m.curve)) for k, m in songs.items()] + [(77, [1.0], None, None, None)]
    tracks = spark.createDataFrame(rows, "project_id bigint, beats array<double>, sections array<struct<label:string,start:double,end:double,energy:double>>, high array<struct<start:double,end:double>>, curve array<struct<t:double,energy:double>>")
    told = lambda frame: [tuple(r) for r in frame.orderBy("project_id", "clip_idx").collect()]
    got = told(planner.plan(shots, "growth", tracks=tracks))
    want = [r for k in (1, 2, 3) for r in told(planner.plan(shots.filter(F.col("project_id") == k), "growth", songs.get(k, templates.Music())))]
    assert got == want and len(got) > 20
    assert told(planner.plan(shots.unionByName(shots.withColumn("project_id", F.lit(None).cast("bigint"))), "growth", tracks=tracks)) == got


def test_structure_of_tracks_feeds_plans(spark):
    found = track_queries.plan_of_tracks(spark, SF)
    assert found.count() > 20 and found.filter("project_id IS NULL").isEmpty()

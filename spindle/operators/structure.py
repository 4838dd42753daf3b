"""Beats and sections of tracks from their frames: tempo, beat tracking, segmentation, and a row of structure per track.

A track is minutes of sound, some ten thousand frames; tracks run in parallel.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.operators import music, streams

# Fixed values of beat tracking: decibels below the loudest that count, prior of the tempo (beats a minute, octaves),
# longest lag in seconds, weight of an even period, share of the strongest onset and of the median score that count as a beat.
TOP_DB, TEMPO, OCTAVES, LAG_SEC, TIGHTNESS, WEAK, LAST = 80.0, 120.0, 1.0, 8.0, 100.0, 0.01, 0.5


def onset_strength(loud: np.ndarray) -> np.ndarray:
    """Rise of the level in decibels from frame to frame, 0 where it falls."""
    power = np.maximum(np.asarray(loud, float) ** 2, 1e-10)
    level = 10 * np.log10(power)
    level = np.maximum(level, level.max(initial=-np.inf) - TOP_DB)
    return np.maximum(0.0, np.diff(level, prepend=level[:1]))


def tempo(onset: np.ndarray, rate: float) -> float:
    """Beats a minute: the lag at which onsets are most alike, weighted by how usual its tempo is; 0 without onsets.

    Onsets are spread to their neighbours first, as a period is seldom a whole number of frames.
    """
    n = min(len(onset), max(2, int(LAG_SEC * rate)))
    if len(onset) < 2 or not onset.any():
        return 0.0
    wide = np.convolve(onset, (0.5, 1.0, 0.5))[1:-1]
    alike = np.array([float(wide[: len(wide) - lag] @ wide[lag:]) for lag in range(n)])
    lags = np.arange(1, n)
    bpm = 60.0 * rate / lags
    usual = -0.5 * (np.log2(bpm / TEMPO) / OCTAVES) ** 2
    return float(bpm[int(np.argmax(np.log1p(1e6 * alike[1:] / alike[0]) + usual))])


def beat_frames(onset: np.ndarray, rate: float, bpm: float) -> np.ndarray:
    """Frames of beats: the chain of strong onsets at steps near the period that scores most, traced back from its last beat.

    Dynamic programming: a frame's score is its onset strength, smoothed, plus
    the best score of a frame half to two periods earlier, less a penalty for an
    uneven step. Weak onsets at either end are no beats.
    """
    if bpm <= 0 or not onset.any():
        return np.zeros(0, np.int64)
    period = max(1, round(60.0 * rate / bpm))
    spread = float(onset.std(ddof=1)) if len(onset) > 1 else 0.0
    level = onset / spread if spread > 0 else onset
    width = np.arange(-period, period + 1)
    local = np.convolve(level, np.exp(-0.5 * (width * 32.0 / period) ** 2))[period : period + len(level)]
    steps = np.arange(-2 * period, -max(1, round(period / 2)) + 1)
    penalty = -TIGHTNESS * np.log(-steps / period) ** 2
    score, back, started = np.empty(len(local)), np.full(len(local), -1), False
    for i, own in enumerate(local):
        before = i + steps
        tried = penalty + np.where(before >= 0, score[np.maximum(before, 0)], 0.0)
        best = int(np.argmax(tried))
        score[i] = own + tried[best]
        started = started or own >= WEAK * local.max()
        if started and before[best] >= 0:
            back[i] = before[best]
    inner = np.r_[False, (score[1:-1] > score[:-2]) & (score[1:-1] >= score[2:]), False] if len(score) > 2 else np.zeros(len(score), bool)
    if len(score) > 1:
        inner[-1] = score[-1] > score[-2]
    if not inner.any():
        return np.zeros(0, np.int64)
    at = int(np.flatnonzero(inner & (score * 2 > np.median(score[inner])))[-1]) if (inner & (score * 2 > np.median(score[inner]))).any() else int(np.flatnonzero(inner)[-1])
    chain = []
    while at >= 0:
        chain.append(at)
        at = int(back[at])
    found = np.array(chain[::-1], np.int64)
    smooth = np.convolve(local[found], np.array([0.0, 0.5, 1.0, 0.5, 0.0]))[2 : 2 + len(found)]
    strong = np.flatnonzero(smooth > LAST * np.sqrt(np.mean(smooth**2)))
    return found[strong[0] : strong[-1] + 1] if len(strong) else found[:0]


def track_beats(rms: DataFrame, keys: Sequence[str], frame: str, t: str, value: str) -> DataFrame:
    """(keys, tempo, beats) of each track from its loudness; ``beats`` are times.

    The rate is that of the first two frames. Tracks of one frame, or that never grow louder, have tempo 0 and no beats.
    """
    rows = rms.select(*keys, F.col(frame).alias("__frame"), F.col(t).cast("double").alias("__t"), F.col(value).cast("double").alias("__v"))

    def one(part: dict) -> dict[str, list]:
        times = np.asarray(part["__t"], float)
        hop = times[1] - times[0] if len(times) > 1 else 0.0
        onset = onset_strength(part["__v"])
        bpm = tempo(onset, 1.0 / hop) if hop > 0 else 0.0
        at = beat_frames(onset, 1.0 / hop, bpm) if hop > 0 else np.zeros(0, np.int64)
        return {"tempo": [bpm], "beats": [times[at].tolist()]}

    return streams.per_key(rows, keys, [F.col("__frame").asc_nulls_last(), "__t"], one, "tempo double, beats array<double>")


def segments(vectors: np.ndarray, k: int) -> list[int]:
    """First frames of ``k`` segments: of all neighbours those merge, again and again, whose merging adds least to the squared distance from their means.

    A heap over a linked list: each merge renews the costs of two pairs; old entries are known by their count of merges. Of equal costs the earlier pair goes first.
    """
    n = len(vectors)
    total, size = [np.asarray(v, float) for v in vectors], [1] * n
    after, before, age = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n

    def cost(a: int, b: int) -> float:
        gap = total[a] / size[a] - total[b] / size[b]
        return float(gap @ gap) * size[a] * size[b] / (size[a] + size[b])

    heap = [(cost(i, i + 1), i, i + 1, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    left, gone = n, [False] * n
    while left > max(k, 1) and heap:
        _, a, b, age_a, age_b = heapq.heappop(heap)
        if gone[a] or gone[b] or age[a] != age_a or age[b] != age_b:
            continue
        total[a], size[a], age[a], gone[b] = total[a] + total[b], size[a] + size[b], age[a] + 1, True
        after[a] = after[b]
        if after[b] < n:
            before[after[b]] = a
            heapq.heappush(heap, (cost(a, after[a]), a, after[a], age[a], age[after[a]]))
        if before[a] >= 0:
            heapq.heappush(heap, (cost(before[a], a), before[a], a, age[before[a]], age[a]))
        left -= 1
    return [i for i in range(n) if not gone[i]]


def peak_scaled(vector: np.ndarray) -> np.ndarray:
    """A vector by its greatest component; one of zeros stays."""
    top = np.abs(vector).max(initial=0)
    return vector / top if top > 0 else vector


def structural_points(frames: DataFrame, keys: Sequence[str], frame: str, t: str, vectors: Sequence[str], duration: str) -> DataFrame:
    """(keys, points): times at which segments of like frames begin, of each track.

    ``vectors`` are columns of arrays (say, chroma and timbre), each scaled by
    its peak and put one after another. There are a segment for 20 seconds, 4 to
    8, or one for each frame if there are fewer. Frames without a vector are left out.
    """
    names = [f"__v{i}" for i in range(len(vectors))]
    known = frames.filter(" AND ".join(f"`{v}` IS NOT NULL" for v in vectors))
    rows = known.select(*keys, F.col(frame).alias("__frame"), F.col(t).cast("double").alias("__t"), F.col(duration).cast("double").alias("__end"), *[F.col(v).cast("array<double>").alias(n) for v, n in zip(vectors, names, strict=True)])

    def one(part: dict) -> dict[str, list]:
        stacked = np.array([np.concatenate([peak_scaled(np.asarray(v, float)) for v in row]) for row in zip(*(part[n] for n in names), strict=True)])
        k = max(4, min(8, int(part["__end"][0] / 20)))
        return {"points": [sorted({float(part["__t"][i]) for i in segments(stacked, k)})]}

    return streams.per_key(rows, keys, [F.col("__frame").asc_nulls_last(), "__t"], one, "points array<double>")


def track_structure(rms: DataFrame, keys: Sequence[str], frame: str, t: str, value: str, beats: DataFrame | None = None, points: DataFrame | None = None, duration: str | None = None) -> DataFrame:
    """A row for each track: (keys, tempo, beats, sections, high, curve), as ``planner.plan`` takes them for each project.

    ``beats`` (keys, beats) and ``points`` (keys, points) if they are known; beats are tracked otherwise, and sections found by loudness.
    """
    found = track_beats(rms, keys, frame, t, value)
    if beats is not None:
        found = found.drop("beats").join(beats.select(*keys, "beats"), list(keys), "left")
    labelled = music.detect_sections(rms, keys, frame, t, value, points, duration)
    in_order = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    parts = labelled.groupBy(*keys).agg(F.transform(in_order("idx", "label", "start", "end", F.col("avg_energy").alias("energy")), lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["energy"].alias("energy"))).alias("sections"))
    high = music.high_energy_ranges(rms, keys, frame, t, value).groupBy(*keys).agg(in_order("start", "end").alias("high"))
    curve = music.energy_curve(rms, keys, frame, t, value).groupBy(*keys).agg(in_order("t", "energy").alias("curve"))
    for part in (parts, high, curve):
        found = found.join(part, list(keys), "left")
    return found

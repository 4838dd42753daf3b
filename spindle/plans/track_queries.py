"""Queries over two tables: clips and the intervals, beats, curves and tracks of their projects.

Times are seconds, and a project's track is derived from its own events, so each
project has another. Vectors serve as frames of a track, and as small pictures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.functions import pixels
from spindle.operators import joins, music, planner, structure
from spindle.plans import catalog
from spindle.plans.catalog import KEY, query
from spindle.plans.templates import PROFILES
from spindle.sources.views import media, media_sql, table

LABELS = ("intro", "verse", "chorus", "bridge", "outro")
HOUR, DAY = 3600, 86_400
_T = f"m AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM ({media_sql()}))"


def timed(s: SparkSession, d: str) -> DataFrame:
    return media(s, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))


def opened(s: SparkSession, d: str) -> DataFrame:
    """An interval of 1 to 40 hours from each still: they overlap."""
    rows = timed(s, d).filter("media_type = 'photo'")
    return rows.select("project_id", F.col("media_id").alias("interval_id"), F.col("t").alias("start"), (F.col("t") + (F.col("media_id") % 40 + 1) * HOUR).alias("end"))


def track_sections(s: SparkSession, d: str) -> DataFrame:
    """A section from every seventh medium to the next one; the last is a day long."""
    rows = timed(s, d).filter("media_id % 7 = 0")
    after = F.lead("t").over(Window.partitionBy("project_id").orderBy("t", "media_id"))
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("media_id") % 5 + 1).cast("int"))
    return rows.select("project_id", F.col("t").alias("start"), F.coalesce(after, F.col("t") + DAY).alias("end"), label.alias("section"))


def others(s: SparkSession, d: str) -> DataFrame:
    return timed(s, d).filter("media_id % 5 <> 0").select("project_id", "media_id", "t")


def fifths(s: SparkSession, d: str) -> DataFrame:
    """Every fifth medium: a beat, and a point of the curve."""
    return timed(s, d).filter("media_id % 5 = 0").select("project_id", "t", (F.col("media_id") % 11 / F.lit(10.0)).alias("energy"))


query("interval_pairs", f"""WITH {_T}, i AS (SELECT project_id, media_id AS interval_id, t AS a, t + (media_id % 40 + 1) * {HOUR} AS b FROM m WHERE media_type = 'photo')
SELECT media_id, interval_id FROM m JOIN i ON m.project_id = i.project_id AND t >= a AND t < b""")(
    lambda s, d: joins.interval_join(timed(s, d).select("project_id", "media_id", "t"), opened(s, d), KEY, "t", "start", "end", HOUR).select("media_id", "interval_id")
)
_NAMES = ", ".join(f"'{x}'" for x in LABELS)
query("section_of_clip", f"""WITH {_T}, i AS (SELECT project_id, t AS a, coalesce(lead(t) OVER (PARTITION BY project_id ORDER BY t, media_id), t + {DAY}) AS b, [{_NAMES}][media_id % 5 + 1] AS label FROM m WHERE media_id % 7 = 0)
SELECT media_id, arg_min(label, (a, b, label)) AS section FROM m LEFT JOIN i ON m.project_id = i.project_id AND t >= a AND t < b GROUP BY media_id""")(
    lambda s, d: joins.first_interval(timed(s, d).select("project_id", "media_id", "t"), track_sections(s, d), KEY, ["media_id"], "t", "start", "end", "section", HOUR).select("media_id", "section")
)
_SIDES = f"""{_T}, l AS (SELECT project_id, media_id, t FROM m WHERE media_id % 5 <> 0), r AS (SELECT project_id, t, media_id % 11 / 10e0 AS energy FROM m WHERE media_id % 5 = 0),
x AS (SELECT l.media_id, l.t, max(CASE WHEN r.t < l.t THEN {{'t': r.t, 'e': r.energy}} END) AS p, min(CASE WHEN r.t >= l.t THEN {{'t': r.t, 'e': r.energy}} END) AS n FROM l LEFT JOIN r ON l.project_id = r.project_id GROUP BY ALL)"""
query("nearest_beat_of_track", f"WITH {_SIDES}, y AS (SELECT *, CASE WHEN p IS NULL OR n.t - t < t - p.t THEN n.t ELSE p.t END AS near FROM x) SELECT media_id, near, abs(near - t) AS distance FROM y")(
    lambda s, d: joins.nearest(others(s, d), fifths(s, d), KEY, "t", DAY).select("media_id", "near", "distance")
)
query("energy_of_track", f"WITH {_SIDES} SELECT media_id, CASE WHEN p IS NULL AND n IS NULL THEN 5e-1 WHEN p IS NULL THEN n.e WHEN n IS NULL THEN p.e ELSE p.e + (n.e - p.e) * ((t - p.t) / (n.t - p.t)) END AS energy FROM x")(
    lambda s, d: joins.interpolated(others(s, d), fifths(s, d), KEY, "t", "energy", width=DAY).select("media_id", "energy")
)


def loudness(s: SparkSession, d: str) -> DataFrame:
    """Events of a user as ten loudness frames a second of the user's track."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(s, d, "events").select(F.col("user_id").alias("project_id"), at.alias("frame"), F.col("value").alias("v")).withColumn("t", F.col("frame") / 10)


@query("track_beats")
def track_beats(s: SparkSession, d: str) -> DataFrame:
    """Tempo and beats of each track."""
    found = structure.track_beats(loudness(s, d), KEY, "frame", "t", "v")
    return found.select("project_id", F.round("tempo", 6).alias("tempo"), F.posexplode_outer("beats").alias("beat", "t"))


def chroma(s: SparkSession, d: str) -> DataFrame:
    """Vectors of a label as a frame in two seconds of the label's track: twelve components of pitch, the others of timbre, a first one for loudness."""
    at = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = table(s, d, "embeddings").select("label", at.alias("frame"), "embedding").withColumn("t", F.col("frame") * F.lit(2.0))
    end = F.count("*").over(Window.partitionBy("label")) * F.lit(2.0)
    return rows.withColumns({"end": end, "pitch": F.slice("embedding", 1, 12), "timbre": F.slice("embedding", 13, 52), "v": F.abs(F.col("embedding")[0]).cast("double")})


@query("structural_sections")
def structural_sections(s: SparkSession, d: str) -> DataFrame:
    """Labelled sections of each track at the bounds that its vectors give."""
    rows = chroma(s, d)
    points = structure.structural_points(rows, ["label"], "frame", "t", ["pitch", "timbre"], "end")
    found = music.detect_sections(rows.withColumnRenamed("label", "track"), ["track"], "frame", "t", "v", points.withColumnRenamed("label", "track"), "end")
    return found.select("track", "idx", "start", "end", F.col("label"), F.round("avg_energy", 6).alias("avg_energy"))


@query("plan_of_tracks")
def plan_of_tracks(s: SparkSession, d: str) -> DataFrame:
    """Plans of all projects, each on its own track."""
    tracks = structure.track_structure(loudness(s, d), KEY, "frame", "t", "v")
    return planner.plan(catalog.plan_input(s, d), PROFILES["growth"], tracks=tracks)


# Vectors as pictures of 8 x 8.
def picture_kernels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges and brightness of a grey picture, and the shares of colours of one whose channels are the picture, turned and mirrored."""
    for b in batches:
        rows = []
        for i, v in zip(b["vec_id"], b["embedding"], strict=True):
            grey = np.floor(np.minimum(np.abs(np.asarray(v, np.float64)), 1.0) * 255).astype(np.uint8).reshape(8, 8)
            hist = pixels.histogram(np.stack([grey, grey.T, grey[:, ::-1]], axis=2))
            rows.append((i, pixels.laplacian_variance(grey), float(grey.mean()), np.flatnonzero(hist).astype(np.int32), float(hist.max())))
        yield pd.DataFrame(rows, columns=["vec_id", "laplacian_var", "luma_mean", "bins", "most"])


@query("picture_colours")
def picture_colours(s: SparkSession, d: str) -> DataFrame:
    """The bins of hue and saturation that each vector's coloured picture fills, and the share of the fullest."""
    return pictures(s, d).select("vec_id", F.array_join("bins", ",").alias("bins"), F.round("most", 6).alias("most"))


def pictures(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings").filter(F.size("embedding") == 64).select("vec_id", "embedding")
    return rows.mapInPandas(picture_kernels, "vec_id bigint, laplacian_var double, luma_mean double, bins array<int>, most double")


_BESIDE = "(CASE WHEN k {0} < 0 THEN 1 WHEN k {0} > 7 THEN 6 ELSE k {0} END)"
_CELL = lambda r, c: f"a[({_BESIDE.format(r).replace('k', 'y')} * 8 + {_BESIDE.format(c).replace('k', 'x')}) + 1]"
query("picture_edges", f"""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(least(abs(x::DOUBLE), 1e0) * 255) AS BIGINT)) AS a FROM embeddings WHERE len(embedding) = 64),
g AS (SELECT vec_id, a, i // 8 AS y, i % 8 AS x FROM p, (SELECT unnest(range(64)) AS i)),
e AS (SELECT vec_id, {_CELL('- 0', '- 0')} AS own, {_CELL('- 1', '- 0')} + {_CELL('+ 1', '- 0')} + {_CELL('- 0', '- 1')} + {_CELL('- 0', '+ 1')} - 4 * {_CELL('- 0', '- 0')} AS d FROM g)
SELECT vec_id, round((64 * sum(d * d) - sum(d) * sum(d)) / 4096e0, 6) AS laplacian_var, round(sum(own) / 64e0, 6) AS luma_mean FROM e GROUP BY vec_id""")(
    lambda s, d: pictures(s, d).select("vec_id", F.round("laplacian_var", 6).alias("laplacian_var"), F.round("luma_mean", 6).alias("luma_mean"))
)

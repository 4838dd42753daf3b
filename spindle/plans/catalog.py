"""Registered queries over derived views, and the SQL they are checked against.

Each query uses the library's operators on whole tables; the SQL beside it says
the same in DuckDB's words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.functions import scores as S
from spindle.operators import grammar, music, planner, preference, sequence, streams, summary
from spindle.plans.templates import GROWTH, PROFILES, TEMPLATES, TRACK, ShotDetect
from spindle.sources import ingest, reports, store
from spindle.sources.views import media, media_sql, table

DAY = 86_400
KEY = ["project_id"]


def shots(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    """Media with role and highlight."""
    rows = media(spark, d, events).withColumn("shot_role", S.role()).withColumn("__h", S.highlight())
    return rows.withColumns({"highlight_score": F.col("__h.score"), "highlight_reason": F.col("__h.reason")}).drop("__h")


def sessions(spark: SparkSession, d: str, gap: int = DAY, events: DataFrame | None = None) -> DataFrame:
    return sequence.sessionize(shots(spark, d, events), KEY, "ts", ["media_id"], gap)


def clips(spark: SparkSession, d: str) -> DataFrame:
    """Every project's shots as one timeline, in the order of time."""
    w = Window.partitionBy(*KEY)
    rows = sessions(spark, d).withColumn("clip_idx", F.row_number().over(w.orderBy("ts", "media_id")) - 1)
    rows = sequence.reflow(rows, KEY, ["clip_idx"]).withColumn("__n", F.count("*").over(w))
    return rows.withColumns({"chapter": S.chapter_at(GROWTH, F.col("clip_idx") / F.col("__n")), "t": (F.col("start_ms") % 60000) / 1000, "shot_start": (F.col("media_id") % 7 * 10).cast("double"), "shot_end": F.col("media_id") % 7 * 10 + F.col("duration_ms") / 1000}).drop("__n")


# The same views in SQL; numbers with an exponent are doubles there.
_EST = "CASE WHEN width > height THEN 3e-1 ELSE 0e0 END + CASE WHEN face_score < 2e-1 THEN 3e-1 ELSE 0e0 END + 2e-1 * exposure + 2e-1 * (1e0 - motion_intensity) + CASE WHEN media_type = 'photo' THEN 1e-1 ELSE 0e0 END"
_ACT = "6e-1 * motion_intensity + CASE WHEN motion_intensity > 4e-1 THEN 2e-1 ELSE 0e0 END + 2e-1 * (1e0 - stability)"
_REA = "6e-1 * face_score + CASE WHEN face_score > 3e-1 THEN 2e-1 ELSE 0e0 END + 2e-1 * (1e0 - motion_intensity)"
_DET = "3e-1 * sharpness + 3e-1 * (1e0 - motion_intensity) + 2e-1 * (1e0 - face_score) + 2e-1 * stability + CASE WHEN media_type = 'photo' THEN 15e-2 ELSE 0e0 END"
_OVERALL = "(sharpness * 2e-1 + exposure * 2e-1 + stability * 2e-1 + face_score * 2e-1 + motion_intensity * 2e-1)"
_EMOTION = "((face_score + motion_intensity) / 2e0)"


def _mean(x: str) -> str:
    return f"(sum(CAST(floor(({x}) * 1000000 + 5e-1) AS BIGINT))::DOUBLE / count(*) / 1000000)"


_SHOTS = f"""
WITH m AS ({media_sql()}),
r AS (SELECT *, {_EST} AS est, {_ACT} AS act, {_REA} AS rea, {_DET} AS det,
  CASE WHEN face_score >= 6e-1 THEN 6e-1 * face_score + 2e-1 * motion_intensity + 2e-1 * exposure ELSE 0e0 END AS h1,
  CASE WHEN face_score >= 5e-1 AND stability >= 7e-1 THEN 5e-1 * face_score + 3e-1 * stability + 2e-1 * sharpness ELSE 0e0 END AS h2,
  CASE WHEN motion_intensity >= 5e-1 AND sharpness >= 5e-1 THEN 4e-1 * motion_intensity + 3e-1 * sharpness + 3e-1 * exposure ELSE 0e0 END AS h3,
  CASE WHEN media_type = 'photo' AND face_score >= 3e-1 THEN 5e-1 * face_score + 3e-1 * sharpness + 2e-1 * exposure ELSE 0e0 END AS h4 FROM m),
s AS (SELECT * EXCLUDE (est, act, rea, det, h1, h2, h3, h4),
  CASE WHEN est >= greatest(act, rea, det) THEN 'establishing' WHEN act >= greatest(rea, det) THEN 'action' WHEN rea >= det THEN 'reaction' ELSE 'detail' END AS shot_role,
  least(greatest(h1, h2, h3, h4), 1e0) AS highlight_score,
  concat_ws(', ', CASE WHEN h1 > 0 THEN 'interaction' END, CASE WHEN h2 > greatest(0e0, h1) THEN 'gaze' END, CASE WHEN h3 > greatest(0e0, h1, h2) THEN 'action_moment' END, CASE WHEN h4 > greatest(0e0, h1, h2, h3) THEN 'posed_photo' END) AS highlight_reason FROM r)"""


def _sessions(gap: int = DAY) -> str:
    return f"""{_SHOTS},
g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY project_id ORDER BY ts, media_id), ts) > {gap * 1000000} THEN 1 ELSE 0 END AS brk FROM s),
e AS (SELECT * EXCLUDE brk, CAST(sum(brk) OVER (PARTITION BY project_id ORDER BY ts, media_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event_id FROM g)"""


_CLIPS = f"""{_sessions()},
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY ts, media_id) - 1 AS INTEGER) AS clip_idx, count(*) OVER (PARTITION BY project_id) AS n,
  CAST(sum(duration_ms) OVER (PARTITION BY project_id ORDER BY ts, media_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_ms FROM e),
c AS (SELECT * EXCLUDE n, end_ms - duration_ms AS start_ms, (end_ms - duration_ms) % 60000 / 1000e0 AS t,
  CASE WHEN clip_idx::DOUBLE / n < 1e-1 THEN 'opening' WHEN clip_idx::DOUBLE / n < 1e-1 + 45e-2 THEN 'learning' WHEN clip_idx::DOUBLE / n < 1e-1 + 45e-2 + 3e-1 THEN 'highlights' ELSE 'closing' END AS chapter,
  (media_id % 7 * 10)::DOUBLE AS shot_start, media_id % 7 * 10 + duration_ms / 1000e0 AS shot_end FROM o)"""
_EVENTS = f"""{_sessions()},
v AS (SELECT project_id, event_id, count(*) AS shot_count, sum(duration_ms) / 1000e0 AS total_duration, {_mean(_OVERALL)} AS avg_quality, {_mean(_EMOTION)} AS emotion_intensity,
  strftime(min(ts), '%H:%M') AS first_hhmm, strftime(max(ts), '%H:%M') AS last_hhmm, strftime(min(ts), '%H:%M') || ' - ' || strftime(max(ts), '%H:%M') AS time_range FROM e GROUP BY ALL),
k AS (SELECT *, 4e-1 * (avg_quality / coalesce(nullif(max(avg_quality) OVER p, 0), 1)) + 35e-2 * (emotion_intensity / coalesce(nullif(max(emotion_intensity) OVER p, 0), 1)) + 25e-2 * least(shot_count / max(shot_count) OVER p, 1e0) AS rank_score FROM v WINDOW p AS (PARTITION BY project_id)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY rank_score DESC, event_id) AS INTEGER) AS rank_pos FROM k)"""


def _case(label: str, first: str = "t") -> str:
    return f"CASE {' '.join(f'WHEN {first} >= {s.start}e0 AND {first} < {s.end}e0 THEN {chr(39)}{s.label}{chr(39)}' for s in TRACK.sections)} END AS {label}"


_LABELLED = f"{_CLIPS}, l AS (SELECT *, {_case('section')} FROM c)"
_BEAT_D = "abs(t - least(greatest(round(t * 2), 0), 119) / 2e0)"
_FIT = f"CASE WHEN {_BEAT_D} <= 12e-2 THEN 1e0 WHEN {_BEAT_D} <= 12e-2 * 3 THEN 7e-1 ELSE 3e-1 END"
_ENERGY = "CASE WHEN t <= 0 THEN 125e-3 " + " ".join(f"WHEN t <= {t1}e0 THEN {e0}e0 + ({e1}e0 - {e0}e0) * ((t - {t0}e0) / {t1 - t0}e0)" for (t0, e0), (t1, e1) in zip(TRACK.curve, TRACK.curve[1:], strict=False)) + " ELSE 0e0 END"
_STORY = """CASE chapter WHEN 'opening' THEN 4e-1 * stability + 4e-1 * face_score + 2e-1 * exposure
  WHEN 'learning' THEN 3e-1 * stability + 3e-1 * sharpness + 2e-1 * motion_intensity + 2e-1 * face_score
  WHEN 'highlights' THEN 5e-1 * face_score + 3e-1 * motion_intensity + 2e-1 * sharpness
  WHEN 'closing' THEN CASE WHEN media_type = 'photo' THEN 8e-1 ELSE 4e-1 * stability + 3e-1 * exposure + 3e-1 * face_score END
  WHEN 'departure' THEN 3e-1 * stability + 3e-1 * motion_intensity + 2e-1 * exposure + 2e-1 * face_score
  WHEN 'exploration' THEN least(1e0, 3e-1 * sharpness + 3e-1 * motion_intensity + 2e-1 * exposure + 2e-1 * stability + CASE WHEN width > height THEN 1e-1 ELSE 0e0 END)
  WHEN 'interaction' THEN 5e-1 * face_score + 3e-1 * stability + 2e-1 * sharpness
  WHEN 'ending' THEN CASE WHEN media_type = 'photo' THEN 7e-1 ELSE 4e-1 * exposure + 3e-1 * stability + 3e-1 * sharpness END ELSE 5e-1 END"""
_SECTION = """coalesce(greatest(0e0, least(1e0, CASE section
  WHEN 'chorus' THEN 3e-1 * motion_intensity + 4e-1 * highlight_score + 1e-1 * (1e0 - stability) + CASE WHEN shot_role = 'action' THEN 35e-2 WHEN shot_role = 'reaction' AND highlight_score >= 5e-1 THEN 2e-1 ELSE 0e0 END + CASE WHEN highlight_score >= 6e-1 THEN 15e-2 ELSE 0e0 END
  WHEN 'verse' THEN 3e-1 * stability + 2e-1 * sharpness + 1e-1 * exposure + CASE WHEN shot_role IN ('establishing', 'detail') THEN 3e-1 WHEN shot_role = 'reaction' THEN 15e-2 ELSE 0e0 END + CASE WHEN motion_intensity > 7e-1 THEN -1e-1 ELSE 0e0 END
  WHEN 'intro' THEN 3e-1 * stability + 2e-1 * exposure + CASE shot_role WHEN 'establishing' THEN 4e-1 WHEN 'detail' THEN 3e-1 ELSE 0e0 END
  WHEN 'outro' THEN 3e-1 * stability + 2e-1 * exposure + CASE WHEN media_type = 'photo' THEN 3e-1 ELSE 0e0 END + CASE WHEN shot_role IN ('establishing', 'detail') THEN 25e-2 ELSE 0e0 END
  WHEN 'bridge' THEN 2e-1 * stability + 2e-1 * sharpness + CASE shot_role WHEN 'reaction' THEN 3e-1 WHEN 'detail' THEN 2e-1 ELSE 0e0 END END
  - CASE WHEN (section = 'intro' AND shot_role IN ('establishing', 'detail')) OR (section IN ('verse', 'outro') AND shot_role <> 'action') OR (section = 'chorus' AND shot_role IN ('action', 'reaction')) OR (section = 'bridge' AND shot_role IN ('reaction', 'detail')) THEN 0e0 ELSE 15e-2 END)), 5e-1)"""
_MISMATCH = "NOT ((section = 'intro' AND shot_role IN ('establishing', 'detail')) OR (section IN ('verse', 'outro') AND shot_role <> 'action') OR (section = 'chorus' AND shot_role IN ('action', 'reaction')) OR (section = 'bridge' AND shot_role IN ('reaction', 'detail')))"

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _pick(frame, *columns: str) -> DataFrame:
    return frame.select(*columns)


# Events: sessions, summaries, ranks and orders.
_RANK_COLUMNS = ("project_id", "event_id", "shot_count", "total_duration", "avg_quality", "emotion_intensity", "time_range", "rank_score", "rank_pos")


def ranked(s: SparkSession, d: str) -> DataFrame:
    return summary.rank_events(summary.summarize_events(sessions(s, d)))


@query("review_events", f"{_EVENTS} SELECT {', '.join(_RANK_COLUMNS)} FROM ranked")
def review_events(s, d):
    """The review: roles, sessions, summaries and ranks of every project's events."""
    return ranked(s, d).select(*_RANK_COLUMNS)


for _name, _gap in (("sessionize_30m", 1800), ("sessionize_1d", DAY)):
    query(_name, f"{_sessions(_gap)} SELECT project_id, event_id, count(*) AS n, min(media_id) AS first_media, max(ts) AS last_ts FROM e GROUP BY ALL")(
        lambda s, d, gap=_gap: sessions(s, d, gap).groupBy("project_id", "event_id").agg(F.count("*").alias("n"), F.min("media_id").alias("first_media"), F.max("ts").alias("last_ts"))
    )


@query("sessionize_unknown_times", f"""{_SHOTS}, u AS (SELECT *, CASE WHEN media_id % 5 <> 0 AND project_id % 4 <> 0 THEN ts END AS u FROM s),
g AS (SELECT *, CASE WHEN u IS NOT NULL AND date_diff('microsecond', lag(u) OVER w, u) > {DAY * 1000000} THEN 1 ELSE 0 END AS brk, row_number() OVER w AS turn FROM u WINDOW w AS (PARTITION BY project_id, u IS NULL ORDER BY u, media_id)),
n AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY project_id, u IS NULL ORDER BY u, media_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS id FROM g),
x AS (SELECT *, max(CASE WHEN u IS NOT NULL THEN id END) OVER (PARTITION BY project_id) AS top FROM n)
SELECT project_id, media_id, CAST(CASE WHEN u IS NOT NULL THEN id ELSE coalesce(top + turn, 0) END AS BIGINT) AS event_id FROM x""")
def sessionize_unknown_times(s, d):
    rows = shots(s, d).withColumn("ts", F.when((F.col("media_id") % 5 != 0) & (F.col("project_id") % 4 != 0), F.col("ts")))
    return sequence.sessionize(rows, KEY, "ts", ["media_id"], DAY).select("project_id", "media_id", "event_id")


query("event_rank", f"{_EVENTS} SELECT project_id, event_id, rank_score, rank_pos FROM ranked")(lambda s, d: ranked(s, d).select("project_id", "event_id", "rank_score", "rank_pos"))
query("narrative_chrono", f"{_EVENTS} SELECT project_id, event_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY first_hhmm, rank_pos) AS INTEGER) AS story_pos FROM ranked")(lambda s, d: summary.narrative(ranked(s, d)).select("project_id", "event_id", "story_pos"))
query("narrative_energy", f"{_EVENTS} SELECT project_id, event_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY emotion_intensity, rank_pos) AS INTEGER) AS story_pos FROM ranked")(lambda s, d: summary.narrative(ranked(s, d), "energy_first").select("project_id", "event_id", "story_pos"))
query("narrative_hybrid", f"""{_EVENTS}, h AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY first_hhmm, rank_pos) AS pos, count(*) OVER (PARTITION BY project_id) AS n FROM ranked),
peak AS (SELECT project_id, pos AS p FROM h QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY emotion_intensity DESC, pos) = 1),
place AS (SELECT h.*, p, CASE WHEN n < 3 THEN pos::DOUBLE WHEN pos = p THEN CAST(floor((n - 1) * 6e-1) AS BIGINT) + 5e-1 ELSE pos - CASE WHEN pos > p THEN 1 ELSE 0 END END AS spot FROM h JOIN peak USING (project_id))
SELECT project_id, event_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY spot) AS INTEGER) AS story_pos FROM place""")(lambda s, d: summary.narrative(ranked(s, d), "hybrid").select("project_id", "event_id", "story_pos"))
query("event_arc_topk", f"{_sessions()} SELECT project_id, event_id, media_id, shot_role AS arc_role, CAST(row_number() OVER (PARTITION BY project_id, event_id, shot_role ORDER BY {_OVERALL} DESC, media_id) AS INTEGER) AS arc_pos FROM e QUALIFY arc_pos <= 3")(lambda s, d: summary.event_arc(sessions(s, d), k=3).select("project_id", "event_id", "media_id", "arc_role", "arc_pos"))

# Scans and duplicates.
query("dedup_first", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text), n_chars ORDER BY doc_id) = 1")(lambda s, d: ingest.dedup_first(table(s, d, "documents"), [F.md5("text"), F.col("n_chars")], [F.col("doc_id")]).select("doc_id"))
query("dup_groups", "SELECT md5(text) AS hash, n_chars, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY ALL HAVING count(*) > 1")(lambda s, d: table(s, d, "documents").groupBy(F.md5("text").alias("hash"), "n_chars").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1"))
_PATHS = "SELECT page_id, '/' || CASE page_id % 7 WHEN 0 THEN 'a/output/' WHEN 1 THEN '.git/x/' WHEN 2 THEN 'clips/venv2/' ELSE 'clips/' END || page_id || CASE page_id % 9 WHEN 0 THEN '.MOV' WHEN 1 THEN '.mp4' WHEN 2 THEN '.Jpeg' WHEN 3 THEN '.dng' WHEN 4 THEN '.wav' WHEN 5 THEN '.m4v' WHEN 6 THEN '' WHEN 7 THEN '.txt' ELSE '.m4a' END AS path FROM pages"


def paths(s: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    ends = (".MOV", ".mp4", ".Jpeg", ".dng", ".wav", ".m4v", "", ".txt", ".m4a")
    folder = F.when(i % 7 == 0, "a/output/").when(i % 7 == 1, ".git/x/").when(i % 7 == 2, "clips/venv2/").otherwise("clips/")
    return table(s, d, "pages").select(i, F.concat(F.lit("/"), folder, i, F.element_at(F.lit(list(ends)), (i % 9 + 1).cast("int"))).alias("path"))


query("classify_suffix", f"SELECT page_id, path, CASE WHEN regexp_matches(lower(path), '\\.(mov|mp4|m4v)$') THEN 'video' WHEN regexp_matches(lower(path), '\\.(jpg|jpeg|heic|png|dng)$') THEN 'photo' WHEN regexp_matches(lower(path), '\\.(mp3|wav|m4a)$') THEN 'music' END AS kind FROM ({_PATHS})")(lambda s, d: paths(s, d).withColumn("kind", ingest.media_kind(F.col("path"))))
query("path_filter", f"SELECT page_id FROM ({_PATHS}) WHERE NOT list_has_any(string_split(path, '/'), ['.venv', 'venv', 'node_modules', '__pycache__', '.git', 'output'])")(lambda s, d: paths(s, d).filter(ingest.allowed(F.col("path"))).select("page_id"))
_PROBE = """'{"streams":[{"codec_type":"audio"},{"codec_type":"video","width":' || (640 + event_id % 3 * 640) || ',"height":720,"r_frame_rate":"' || CASE event_id % 3 WHEN 0 THEN '30000/1001' WHEN 1 THEN '25/1' ELSE '0/0' END || '"}],"format":{"duration":"' || (event_id % 60) || '.5","tags":{"' || CASE event_id % 5 WHEN 0 THEN 'location' ELSE 'com.apple.quicktime.location.ISO6709' END || '":"' || CASE event_id % 4 WHEN 0 THEN '+40.5-074.25+010/' WHEN 1 THEN '+40.5-074.25/' WHEN 2 THEN '+40.5+074.25/' ELSE 'at +1+2+3' END || '"}}}'"""
query("extract_metadata", "SELECT event_id, event_id % 60 + 5e-1 AS duration_sec, '' AS creation_time, CAST(640 + event_id % 3 * 640 AS INTEGER) AS width, CAST(720 AS INTEGER) AS height, CASE event_id % 3 WHEN 0 THEN 30000e0 / 1001 WHEN 1 THEN 25e0 ELSE 0e0 END AS fps, CASE WHEN event_id % 5 <> 0 AND event_id % 2 = 0 THEN 405e-1 END AS gps_lat, CASE WHEN event_id % 5 <> 0 THEN CASE event_id % 4 WHEN 0 THEN -7425e-2 WHEN 2 THEN 7425e-2 END END AS gps_lon FROM events")(lambda s, d: table(s, d, "events").select("event_id", ingest.metadata(F.expr(_PROBE)).alias("m")).select("event_id", "m.*"))
_STAMPS = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS'+02:00'", "yyyy-MM-dd'T'HH:mm:ss'+0200'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


@query("parse_creation_time", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('second', ts) WHEN 4 THEN date_trunc('millisecond', ts) - INTERVAL 2 HOUR WHEN 5 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 6 THEN ts END AS creation_time FROM events")
def parse_creation_time(s, d):
    """Times as written in five known ways; two others (no zone, colons) are unknown."""
    i = F.col("event_id") % 7
    text = F.coalesce(*[F.when(i == k, F.date_format("ts", f)) for k, f in enumerate(_STAMPS)])
    return table(s, d, "events").select("event_id", ingest.creation_time(text).cast("timestamp_ntz").alias("creation_time"))


@query("events_per_source", f"""{_SHOTS}, f AS (SELECT project_id, source_id, min(media_id) AS first_id, arg_min(CASE WHEN media_id % 7 <> 0 THEN epoch_us(ts) ELSE -1 END, media_id) AS us FROM s GROUP BY ALL),
k AS (SELECT *, CASE WHEN us >= 0 THEN make_timestamp(us) END AS tm FROM f),
g AS (SELECT *, CASE WHEN tm IS NOT NULL AND date_diff('microsecond', lag(tm) OVER w, tm) > {DAY * 1000000} THEN 1 ELSE 0 END AS brk, row_number() OVER w AS turn FROM k WINDOW w AS (PARTITION BY project_id, tm IS NULL ORDER BY tm, first_id)),
n AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY project_id, tm IS NULL ORDER BY tm, first_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS id FROM g),
x AS (SELECT *, max(CASE WHEN tm IS NOT NULL THEN id END) OVER (PARTITION BY project_id) AS top FROM n)
SELECT s.project_id, s.source_id, s.media_id, CAST(CASE WHEN tm IS NOT NULL THEN id ELSE coalesce(top + turn, 0) END AS BIGINT) AS event_id FROM s JOIN x USING (project_id, source_id)""")
def events_per_source(s, d):
    """All shots of a source are of one event; the times of some sources are unknown."""
    rows = shots(s, d).withColumn("ts", F.when(F.col("media_id") % 7 != 0, F.col("ts")))
    return sequence.assign_events(rows, KEY, "source_id", "ts", "media_id", DAY).select("project_id", "source_id", "media_id", "event_id")


query("list_entries", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 90 END AS list_event, CASE event_id % 4 WHEN 3 THEN 'clip ' || event_id || '.mp4' END AS list_name FROM events WHERE event_id % 4 IN (0, 3)")(
    lambda s, d: table(s, d, "events").select("event_id", ingest.list_entries(F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" event:"), F.col("event_id") % 90, F.lit(" trip "))).when(F.col("event_id") % 4 == 1, F.lit("# note")).when(F.col("event_id") % 4 == 2, F.lit("event:x")).otherwise(F.concat(F.lit("clip "), "event_id", F.lit(".mp4 ")))).alias("e")).filter("e IS NOT NULL").select("event_id", F.col("e.event_id").alias("list_event"), F.col("e.name").alias("list_name"))
)

# Scores.
query("shot_roles", f"{_SHOTS} SELECT media_id, shot_role FROM s")(lambda s, d: shots(s, d).select("media_id", "shot_role"))
query("role_distribution", f"{_SHOTS} SELECT project_id, shot_role, count(*) AS n FROM s GROUP BY ALL")(lambda s, d: preference.count_roles(shots(s, d), KEY))
query("highlight_scores", f"{_SHOTS} SELECT media_id, highlight_score, highlight_reason FROM s")(lambda s, d: shots(s, d).select("media_id", "highlight_score", "highlight_reason"))
query("top_highlights", f"{_SHOTS} SELECT media_id, highlight_score FROM s WHERE highlight_score >= 5e-1 ORDER BY highlight_score DESC, media_id LIMIT 5")(lambda s, d: shots(s, d).filter("highlight_score >= 0.5").orderBy(F.desc("highlight_score"), "media_id").limit(5).select("media_id", "highlight_score"))
_REASON = f"concat_ws('; ', CASE WHEN {_OVERALL} < 3e-1 THEN 'low_overall_quality' END, CASE WHEN sharpness < 2e-1 THEN 'blurry' END, CASE WHEN exposure < 3e-1 THEN 'poor_exposure' END, CASE WHEN stability < 3e-1 THEN 'too_shaky' END)"
_REASON = f"coalesce(nullif({_REASON}, ''), 'outranked_by_better_candidates')"
query("rejection_reasons", f"{_SHOTS} SELECT media_id, {_REASON} AS reason FROM s")(lambda s, d: shots(s, d).select("media_id", S.rejection_reason().alias("reason")))
query("quality_overall", f"{_SHOTS} SELECT media_id, {_OVERALL} AS overall FROM s")(lambda s, d: shots(s, d).select("media_id", S.overall().alias("overall")))
_LUMA = "(event_id * 17 % 256)::DOUBLE"
query("exposure_score", f"SELECT event_id, CASE WHEN {_LUMA} < 40 THEN {_LUMA} / 40e0 WHEN {_LUMA} > 220 THEN (255e0 - {_LUMA}) / 35e0 ELSE 1e0 - abs({_LUMA} - 128e0) / 128e0 * 3e-1 END AS exposure FROM events")(lambda s, d: table(s, d, "events").select("event_id", S.exposure_of((F.col("event_id") * 17 % 256).cast("double")).alias("exposure")))
query("frame_metrics", """SELECT event_id, least((event_id % 700)::DOUBLE / 500e0, 1e0) AS sharpness, CASE WHEN event_id % 4 > 0 THEN least((event_id % 11)::DOUBLE / 100e0 * 10e0 + (event_id % 4) * 1e-1, 1e0) ELSE 0e0 END AS faces,
  CASE WHEN event_id % 9 < 2 THEN 1e0 WHEN event_id % 2 = 0 THEN 5e-1 ELSE greatest(0e0, 1e0 - (((event_id % 13)::DOUBLE + (event_id % 5)::DOUBLE) / 2) / 20e0) END AS stability,
  CASE WHEN event_id % 9 < 2 THEN 0e0 ELSE least((((event_id % 13)::DOUBLE + (event_id % 50)::DOUBLE) / 2) / 40e0, 1e0) END AS motion FROM events""")(
    lambda s, d: table(s, d, "events").withColumn("i", F.col("event_id")).select("event_id", S.sharpness_of((F.col("i") % 700).cast("double")).alias("sharpness"), S.faces_of((F.col("i") % 11).cast("double") / 100, F.col("i") % 4).alias("faces"), S.stability_of(F.when(F.col("i") % 2 == 0, F.array(F.lit(None).cast("double"))).otherwise(F.array((F.col("i") % 13).cast("double"), F.lit(None).cast("double"), (F.col("i") % 5).cast("double"))), F.col("i") % 9).alias("stability"), S.motion_of(F.array((F.col("i") % 13).cast("double"), (F.col("i") % 50).cast("double")), F.col("i") % 9).alias("motion"))
)
for _t in ("growth", "travel"):
    _chs = [c.name for c in TEMPLATES[_t].chapters]
    _chapter_sql = f"list_value({', '.join(repr(c) for c in _chs)})[CAST(media_id % 4 AS INTEGER) + 1]"
    query(f"story_fit_{_t}", f"{_SHOTS} SELECT media_id, chapter, {_STORY} AS story_fit FROM (SELECT *, {_chapter_sql} AS chapter FROM s)")(
        lambda s, d, chs=tuple(_chs): shots(s, d).withColumn("chapter", F.element_at(F.lit(list(chs)), (F.col("media_id") % 4 + 1).cast("int"))).select("media_id", "chapter", S.story_fit(F.col("chapter")).alias("story_fit"))
    )
query("section_fit", f"{_LABELLED} SELECT media_id, section, {_SECTION} AS fit FROM l")(lambda s, d: clips(s, d).withColumn("section", S.section_at(TRACK.sections, F.col("t"))).select("media_id", "section", S.section_fit(F.col("section"), F.col("shot_role")).alias("fit")))
query("rhythm_fit", f"{_CLIPS} SELECT media_id, {_FIT} AS fit FROM c")(lambda s, d: clips(s, d).select("media_id", S.rhythm_fit(TRACK, F.col("t")).alias("fit")))
query("shot_score", f"""{_LABELLED} SELECT media_id, greatest(0e0, 2e-1 * ((sharpness + exposure + stability) / 3) + 25e-2 * face_score + 1e-1 * motion_intensity + 15e-2 * ({_STORY}) + 15e-2 * ({_FIT}) + 15e-2 * ({_SECTION})
  + CASE WHEN highlight_score >= 5e-1 THEN 1e-1 * highlight_score + CASE WHEN section = 'chorus' THEN 25e-2 ELSE 0e0 END ELSE 0e0 END
  - (CASE WHEN exposure < 3e-1 THEN 2e-1 ELSE 0e0 END + CASE WHEN sharpness < 2e-1 THEN 15e-2 ELSE 0e0 END + CASE WHEN stability < 3e-1 THEN 1e-1 ELSE 0e0 END)) AS score FROM l""")(lambda s, d: clips(s, d).select("media_id", S.shot_score(GROWTH, F.col("chapter"), S.section_at(TRACK.sections, F.col("t")), S.rhythm_fit(TRACK, F.col("t"))).alias("score")))
query("arc_role", "SELECT event_id, CASE WHEN (event_id % 100)::DOUBLE / 100 <= 15e-2 THEN 'establishing' WHEN (event_id % 100)::DOUBLE / 100 <= 15e-2 + 4e-1 THEN 'action' WHEN (event_id % 100)::DOUBLE / 100 <= 15e-2 + 4e-1 + 3e-1 THEN 'reaction' ELSE 'detail' END AS role FROM events")(lambda s, d: table(s, d, "events").select("event_id", S.arc_role((F.col("event_id") % 100).cast("double") / 100).alias("role")))
query("frame_numbers", "SELECT event_id, CAST(round_even(event_id / 60e0 * 30, 0) AS BIGINT) AS frame FROM events")(lambda s, d: table(s, d, "events").select("event_id", S.frames_of(F.col("event_id") / 60).alias("frame")))

# Lookups in a track.
query("section_at", f"{_LABELLED} SELECT media_id, section FROM l")(lambda s, d: clips(s, d).select("media_id", S.section_at(TRACK.sections, F.col("t")).alias("section")))
query("energy_at", f"{_CLIPS} SELECT media_id, {_ENERGY} AS energy FROM c")(lambda s, d: clips(s, d).select("media_id", S.energy_at(TRACK.curve, F.col("t")).alias("energy")))
query("nearest_beat", f"{_CLIPS}, b AS (SELECT range / 2e0 AS beat FROM range(120)) SELECT media_id, (SELECT arg_min(beat, abs(beat - t) + beat * 1e-9) FROM b) AS beat, (SELECT min(abs(beat - t)) FROM b) AS distance FROM c")(lambda s, d: clips(s, d).select("media_id", S.nearest(TRACK.beats, F.col("t")).alias("beat"), S.distance_to(TRACK.beats, F.col("t")).alias("distance")))
query("snap_to_beat", f"{_CLIPS} SELECT media_id, CASE WHEN {_BEAT_D} <= 12e-2 THEN least(round(t * 2), 119) / 2e0 ELSE t END AS snapped FROM c")(lambda s, d: clips(s, d).select("media_id", S.snap(TRACK, F.col("t")).alias("snapped")))
query("energy_clip_duration", f"{_CLIPS} SELECT media_id, greatest(15e-1, least(6e0 * 12e-1, 6e0 * (12e-1 - 6e-1 * ({_ENERGY})))) AS seconds FROM c")(lambda s, d: clips(s, d).select("media_id", S.clip_duration(S.energy_at(TRACK.curve, F.col("t")), 1.5, 6.0, 0.6).alias("seconds")))
query("high_energy_flag", f"{_CLIPS} SELECT media_id, (t >= 15 AND t <= 25) OR (t >= 40 AND t <= 50) AS loud FROM c")(lambda s, d: clips(s, d).select("media_id", S.high_energy(TRACK.high, F.col("t")).alias("loud")))

# Music: a user's events are the frames of a track, a second apart, their value the loudness.
_RMS = "SELECT user_id AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::DOUBLE AS t, value AS rms FROM events"


def rms(s: SparkSession, d: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(s, d, "events").select(F.col("user_id").alias("track_id"), at.cast("bigint").alias("frame"), at.cast("double").alias("t"), F.col("value").alias("rms"))


def sections_of(s: SparkSession, d: str) -> DataFrame:
    rows = rms(s, d)
    bounds = rows.groupBy("track_id").agg(F.max("t").alias("duration")).withColumn("bounds", F.array(F.lit(0.0), F.lit(7.0), F.lit(20.0), F.lit(33.0), F.lit(33.5), F.lit(50.0)))
    bounds = bounds.withColumn("bounds", F.filter("bounds", lambda b: b < F.col("duration")))
    return music.sections(bounds, rows, ["track_id"], "t", "rms")


_SECTIONS = f"""WITH a AS ({_RMS}), dur AS (SELECT track_id, max(t) AS duration, max(rms) AS top FROM a GROUP BY 1),
pts AS (SELECT DISTINCT track_id, unnest(list_concat(list_filter([0e0, 7e0, 20e0, 33e0, 335e-1, 50e0], lambda b: b < duration), [duration])) AS b FROM dur),
seg AS (SELECT track_id, b AS start, lead(b) OVER (PARTITION BY track_id ORDER BY b) AS "end" FROM pts),
kept AS (SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY start) - 1 AS INTEGER) AS idx, start, "end" FROM seg WHERE "end" - start >= 1),
en AS (SELECT kept.track_id, idx, sum(CAST(floor((CASE WHEN top > 0 THEN rms / top ELSE rms END) * 1000000 + 5e-1) AS BIGINT))::DOUBLE / count(*) / 1000000 AS avg_energy FROM kept JOIN a ON a.track_id = kept.track_id AND t >= start AND t < "end" JOIN dur ON dur.track_id = a.track_id GROUP BY ALL),
sec AS (SELECT kept.*, coalesce(avg_energy, 5e-1) AS avg_energy FROM kept LEFT JOIN en USING (track_id, idx))"""
query("energy_curve", f"WITH a AS ({_RMS}), b AS (SELECT *, max(rms) OVER (PARTITION BY track_id) AS top FROM a) SELECT track_id, frame // 5 AS block, min(t) AS t, {_mean('CASE WHEN top > 0 THEN rms / top ELSE rms END')} AS energy FROM b GROUP BY track_id, frame // 5")(lambda s, d: music.energy_curve(rms(s, d), ["track_id"], "frame", "t", "rms", 5))
query("high_energy_islands", f"""WITH a AS ({_RMS}), p AS (SELECT track_id, quantile_cont(rms, 75e-2) AS bar FROM a GROUP BY 1),
x AS (SELECT a.*, rms > bar AS hi, lead(t) OVER (PARTITION BY track_id ORDER BY frame) AS nxt, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS n FROM a JOIN p USING (track_id)),
y AS (SELECT *, n - row_number() OVER (PARTITION BY track_id ORDER BY frame) AS run FROM x WHERE hi)
SELECT track_id, min(t) AS start, arg_max(coalesce(nxt, t), n) AS "end" FROM y GROUP BY track_id, run HAVING arg_max(coalesce(nxt, t), n) - min(t) >= 2""")(lambda s, d: music.high_energy_ranges(rms(s, d), ["track_id"], "frame", "t", "rms"))
query("section_energy", f'{_SECTIONS} SELECT track_id, idx, start, "end", avg_energy FROM sec')(lambda s, d: sections_of(s, d).select("track_id", "idx", "start", "end", "avg_energy"))
query("section_labels", f"""{_SECTIONS.replace("WITH a AS", "WITH RECURSIVE a AS")}, mid AS (SELECT track_id, quantile_cont(avg_energy, 5e-1) AS m, max(idx) AS last FROM sec GROUP BY 1),
raw AS (SELECT sec.*, CASE WHEN idx = 0 AND "end" - start < 15 THEN 'intro' WHEN idx = last AND "end" - start < 15 THEN 'outro' WHEN avg_energy > m * 115e-2 THEN 'chorus' WHEN avg_energy < m * 85e-2 THEN 'verse' ELSE 'bridge' END AS label FROM sec JOIN mid USING (track_id)),
fold AS (SELECT track_id, idx, label FROM raw WHERE idx = 0 UNION ALL
  SELECT raw.track_id, raw.idx, CASE WHEN raw.label = fold.label AND raw.label IN ('verse', 'bridge') THEN CASE fold.label WHEN 'verse' THEN 'bridge' ELSE 'verse' END ELSE raw.label END FROM fold JOIN raw ON raw.track_id = fold.track_id AND raw.idx = fold.idx + 1)
SELECT track_id, idx, label FROM fold""")(lambda s, d: music.label_sections(sections_of(s, d), ["track_id"]).select("track_id", "idx", "label"))


@query("merge_boundaries")
def merge_boundaries(s, d):
    """The frames of each track as points, merged to 6 s and 9 of them at most."""
    return rms(s, d).groupBy("track_id").agg(F.array_sort(F.collect_list("t")).alias("points")).select("track_id", F.concat_ws(",", F.transform(music.merge_boundaries(F.col("points"), 6.0), lambda x: x.cast("string"))).alias("bounds"))


@query("change_boundaries")
def change_boundaries(s, d):
    return music.change_boundaries(rms(s, d), ["track_id"], "frame", "t", "rms").select("track_id", F.concat_ws(",", F.transform("bounds", lambda x: x.cast("string"))).alias("bounds"))


@query("detect_sections")
def detect_sections(s, d):
    """Sections by loudness, labelled, of every track."""
    return music.detect_sections(rms(s, d), ["track_id"], "frame", "t", "rms").select("track_id", "idx", "start", "end", "avg_energy", "label")


@query("downbeats", "SELECT user_id AS track_id, count(*) AS beats, (count(*) + 3) // 4 AS downbeats FROM events GROUP BY 1")
def downbeats(s, d):
    beats = rms(s, d).groupBy("track_id").agg(F.array_sort(F.collect_list("t")).alias("b"))
    return beats.select("track_id", F.size("b").cast("bigint").alias("beats"), F.size(music.downbeats(F.col("b"))).cast("bigint").alias("downbeats"))


@query("chorus_repeat")
def chorus_repeat(s, d):
    """Vectors of a label as the chroma of a track, one a second, with a chorus of 8 s after every 4: groups of alike choruses."""
    w = Window.partitionBy("label").orderBy("vec_id")
    chroma = table(s, d, "embeddings").select("label", (F.row_number().over(w) - 1).cast("double").alias("t"), F.transform("embedding", lambda x: x.cast("double") + 0.25).alias("v"))
    idx = F.floor(F.col("t") / 12).cast("int")
    found = chroma.select("label", idx.alias("idx")).distinct().select(F.col("label"), "idx", (F.col("idx") * 12.0 + 4).alias("start"), (F.col("idx") * 12.0 + 12).alias("end"))
    named = found.select(F.col("label").alias("track"), "idx", "start", "end", F.lit("chorus").alias("label"))
    return music.chorus_repeats(named, chroma.withColumnRenamed("label", "track"), ["track"], "t", "v")


# Frames and boundaries.
@query("hist_distance", """WITH h AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS a FROM embeddings),
p AS (SELECT *, lag(a) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM h)
SELECT vec_id, CAST(floor(sqrt(greatest(0, 1 - list_sum(list_transform(range(1, len(a) + 1), lambda i: sqrt(b[i] * a[i]))) / sqrt(list_sum(b) * list_sum(a)))) * 1000000 + 5e-1) AS BIGINT) AS distance_millionths FROM p WHERE b IS NOT NULL""")
def hist_distance(s, d):
    """Distance of each histogram (squared components) to the one before it."""
    rows = table(s, d, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("hist"))
    before = F.lag("hist").over(Window.partitionBy("label").orderBy("vec_id"))
    found = rows.withColumn("before", before).filter("before IS NOT NULL")
    return found.select("vec_id", F.floor(sequence.hist_distance(F.col("before"), F.col("hist")) * 1000000 + 0.5).cast("bigint").alias("distance_millionths"))


_FRAMES = "SELECT user_id AS media_id, event_id AS frame, (event_id % 100)::DOUBLE / 100 AS h, (event_id * 7 % 30)::DOUBLE AS f, (event_id * 13 % 200)::DOUBLE AS luma FROM events"


def frames(s: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(s, d, "events").select(F.col("user_id").alias("media_id"), i.alias("frame"), ((i % 100).cast("double") / 100).alias("h"), (i * 7 % 30).cast("double").alias("f"), (i * 13 % 200).cast("double").alias("luma"))


@query("boundary_candidates", f"""WITH a AS ({_FRAMES}), b AS (SELECT *, abs(luma - lag(luma) OVER (PARTITION BY media_id ORDER BY frame)) AS j FROM a WHERE frame % 3 = 0)
SELECT media_id, frame FROM b WHERE h > 4e-1 * 15e-1 OR (CASE WHEN h > 4e-1 THEN 1 ELSE 0 END + CASE WHEN f > 12 THEN 1 ELSE 0 END + CASE WHEN j > 30 THEN 1 ELSE 0 END) >= 2""")
def boundary_candidates(s, d):
    c = ShotDetect()
    thin = frames(s, d).filter(F.col("frame") % c.sample_interval == 0)
    jump = F.abs(F.col("luma") - F.lag("luma").over(Window.partitionBy("media_id").orderBy("frame")))
    return thin.withColumn("j", jump).filter(sequence.is_boundary(F.col("h"), F.col("f"), F.col("j"), c.histogram_threshold, c.optical_flow_threshold, c.luminance_threshold)).select("media_id", "frame")


# The folds take every event.
_POINTS = "SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, (event_id // 50)::DOUBLE / 4 AS p FROM events"


def points(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select(F.col("user_id").alias("media_id"), "event_id", (F.floor(F.col("event_id") / 50).cast("double") / 4).alias("p"))
    return rows.groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "p"))), lambda x: x["p"]).alias("points"))


query("boundary_min_gap", f"""WITH RECURSIVE a AS ({_POINTS}), f AS (SELECT media_id, 0 AS n, 0e0 AS last, 0e0 AS p, TRUE AS kept FROM (SELECT DISTINCT media_id FROM a) UNION ALL
  SELECT a.media_id, CAST(a.n AS INTEGER), CASE WHEN a.p - f.last >= 2 THEN a.p ELSE f.last END, a.p, a.p - f.last >= 2 FROM f JOIN a ON a.media_id = f.media_id AND a.n = f.n + 1)
SELECT media_id, p AS bound FROM f WHERE kept""")(lambda s, d: points(s, d).select("media_id", F.explode(sequence.min_gap_fold(F.col("points"), 2.0, 0.0)).alias("bound")))
query("garbage_merge", f"""WITH RECURSIVE a AS ({_POINTS}), z AS (SELECT media_id, max(n) AS m FROM a GROUP BY 1), f AS (SELECT media_id, CAST(1 AS INTEGER) AS n, p AS last, p, TRUE AS kept FROM a WHERE n = 1 UNION ALL
  SELECT a.media_id, CAST(a.n AS INTEGER), CASE WHEN a.p - f.last >= 2 OR a.n = m OR m <= 2 THEN a.p ELSE f.last END, a.p, a.p - f.last >= 2 OR a.n = m OR m <= 2 FROM f JOIN a ON a.media_id = f.media_id AND a.n = f.n + 1 JOIN z ON z.media_id = a.media_id)
SELECT media_id, p AS bound FROM f WHERE kept""")(lambda s, d: points(s, d).select("media_id", F.explode(sequence.garbage_merge(F.col("points"), 2.0)).alias("bound")))
query("force_split", """WITH a AS (SELECT event_id, value / 2 AS len FROM events), n AS (SELECT *, CASE WHEN len > 8 THEN greatest(2, CAST(floor(len / 8 + 5e-1) AS INTEGER)) ELSE 1 END AS k FROM a)
SELECT event_id, CAST(k AS INTEGER) AS pieces, CASE WHEN k = 1 THEN len ELSE 0 + (len - 0) / k * 1 END AS first_end FROM n""")(
    lambda s, d: table(s, d, "events").select("event_id", sequence.force_split(F.array(F.lit(0.0), F.col("value") / 2), 8.0).alias("b")).select("event_id", (F.size("b") - 1).alias("pieces"), F.element_at("b", 2).alias("first_end"))
)


@query("detect_shots")
def detect_shots(s, d):
    """Shots of media whose frames are the vectors of a label, six a second."""
    w = Window.partitionBy("label").orderBy("vec_id")
    at = F.row_number().over(w) - 1
    rows = table(s, d, "embeddings").select("label", at.alias("frame_idx"), (at / 6).alias("ts_sec"), F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("hist"), (F.col("vec_id") * 7 % 30).cast("double").alias("flow_mag"), (F.col("vec_id") * 13 % 200).cast("double").alias("luma_mean"))
    rows = rows.withColumn("end_sec", F.count("*").over(Window.partitionBy("label")) / 6)
    return sequence.detect_shots(rows, ["label"], ShotDetect())


@query("highlight_windows")
def highlight_windows(s, d):
    rows = shots(s, d).select("media_id", F.lit(0.0).alias("start"), (F.col("duration_ms") / 1000).alias("end"), "media_type", "highlight_score", S.overall().alias("overall"))
    i = F.col("media_id")
    seen = rows.select("media_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("end") * 6).cast("int"))).alias("frame_idx")).select("media_id", F.col("frame_idx").cast("bigint").alias("frame_idx"), S.frame_quality(((i + F.col("frame_idx") * 3) % 11).cast("double") / 10, ((i + F.col("frame_idx")) % 7).cast("double") / 6, F.col("frame_idx") % 3).alias("frame_score"))
    return sequence.best_window(rows, seen, fps=6.0)


query("photo_shots", f"{_SHOTS} SELECT media_id, CAST(0 AS INTEGER) AS shot_index, 0e0 AS start, 4e0 AS \"end\" FROM s WHERE media_type = 'photo'")(lambda s, d: sequence.photo_shots(shots(s, d).filter(S.photo()), ["media_id"]))
query("sampled_frames", """WITH a AS (SELECT user_id, event_id, min(event_id) OVER p AS f, count(*) OVER p AS n FROM events WINDOW p AS (PARTITION BY user_id)),
b AS (SELECT * FROM a WHERE (event_id - f) % greatest(1, n // 8) = 0) SELECT user_id, event_id FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 8""")(lambda s, d: sequence.sampled_frames(table(s, d, "events").select("user_id", "event_id"), ["user_id"], "event_id"))

# Lists and preferences.
_MARKED = f"{_sessions()}, k AS (SELECT e.*, CASE WHEN media_id % 11 = 0 THEN 'favourite' WHEN media_id % 13 = 0 THEN 'excluded' END AS mark FROM e)"


def marked(s: SparkSession, d: str) -> DataFrame:
    return sessions(s, d).withColumn("mark", F.when(F.col("media_id") % 11 == 0, "favourite").when(F.col("media_id") % 13 == 0, "excluded"))


def listed(s: SparkSession, d: str, column: str) -> DataFrame:
    return table(s, d, "labels").filter(F.col(column) == 1).select("doc_id")


query("exclude_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")(lambda s, d: table(s, d, "documents").select("doc_id").join(listed(s, d, "toxic"), "doc_id", "left_anti"))
query("favorites_boost", f"{_SHOTS} SELECT media_id, CASE WHEN q THEN greatest(sharpness, 9e-1) ELSE sharpness END AS sharpness, CASE WHEN q THEN greatest(exposure, 9e-1) ELSE exposure END AS exposure, CASE WHEN q THEN greatest(stability, 9e-1) ELSE stability END AS stability, q AS is_favourite FROM (SELECT s.*, media_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS q FROM s WHERE media_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))")(
    lambda s, d: preference.apply_lists(shots(s, d), listed(s, d, "quality").withColumnRenamed("doc_id", "media_id"), listed(s, d, "toxic").withColumnRenamed("doc_id", "media_id"), ["media_id"]).select("media_id", "sharpness", "exposure", "stability", "is_favourite")
)
_GROUPS = {"fav": "mark = 'favourite'", "exc": "mark = 'excluded'", "pool": "coalesce(mark, '') <> 'excluded'"}
_LIFTED = {q: f"CASE WHEN mark = 'favourite' THEN greatest({q}, 9e-1) ELSE {q} END" if q in ("sharpness", "stability") else q for q in preference.BIASES.values()}
_AVG = ", ".join(f"sum(CASE WHEN {c} THEN CAST(floor(({_LIFTED[q]}) * 1000000 + 5e-1) AS BIGINT) END)::DOUBLE / nullif(count(*) FILTER ({c}), 0) / 1000000 AS {q}_{g}" for g, c in _GROUPS.items() for q in preference.BIASES.values())
_BIAS = ", ".join(f"CASE WHEN n_fav > 0 AND n_exc > 0 THEN ({q}_fav - {q}_exc) * 5e-1 WHEN n_fav > 0 THEN ({q}_fav - {q}_pool) * 5e-1 WHEN n_exc > 0 THEN ({q}_pool - {q}_exc) * 5e-1 ELSE 0e0 END AS {b}" for b, q in preference.BIASES.items())
_PROFILE = f"""{_MARKED}, a AS (SELECT project_id, count(*) FILTER (mark = 'favourite') AS n_fav, count(*) FILTER (mark = 'excluded') AS n_exc, count(*) FILTER (coalesce(mark, '') <> 'excluded') AS n_pool, count(*) FILTER (mark = 'favourite' AND media_type = 'photo') AS p_fav, count(*) FILTER (media_type = 'photo' AND coalesce(mark, '') <> 'excluded') AS p_pool, {_AVG},
  list_sort(list(DISTINCT event_id) FILTER (mark = 'favourite')) AS pe, list_sort(list(DISTINCT event_id) FILTER (mark = 'excluded')) AS ae FROM k GROUP BY 1),
prof AS (SELECT project_id, {_BIAS}, (p_fav::DOUBLE / greatest(n_fav, 1) - p_pool::DOUBLE / greatest(n_pool, 1)) * 3e-1 AS photo_bias, coalesce(pe, []) AS pe, coalesce(ae, []) AS ae, n_fav + n_exc AS sample_count FROM a)"""
query("learn_preferences", f"{_PROFILE} SELECT project_id, face_bias, motion_bias, stability_bias, sharpness_bias, photo_bias, array_to_string(pe, ',') AS preferred, array_to_string(ae, ',') AS avoided, sample_count FROM prof")(
    lambda s, d: preference.learn(marked(s, d)).select("project_id", *preference.BIASES, "photo_bias", F.concat_ws(",", F.col("preferred_events").cast("array<string>")).alias("preferred"), F.concat_ws(",", F.col("avoided_events").cast("array<string>")).alias("avoided"), "sample_count")
)
query("learn_role_bias", f"""{_MARKED}, p AS (SELECT project_id, shot_role AS role, count(*) FILTER (mark = 'favourite') AS f, count(*) AS n FROM k WHERE coalesce(mark, '') <> 'excluded' GROUP BY ALL), w AS (SELECT project_id, sum(f) AS af, sum(n) AS an FROM p GROUP BY 1)
SELECT project_id, role, (f::DOUBLE / af::DOUBLE - n::DOUBLE / an::DOUBLE) * 3e-1 AS bias FROM p JOIN w USING (project_id) WHERE f > 0""")(lambda s, d: preference.learn_roles(marked(s, d)))
query("preference_adjust", f"""{_PROFILE} SELECT media_id, CASE WHEN sample_count > 0 THEN 0e0 + face_bias * face_score + motion_bias * motion_intensity + stability_bias * stability + sharpness_bias * sharpness + CASE WHEN list_contains(pe, event_id) THEN 15e-2 ELSE 0e0 END + CASE WHEN list_contains(ae, event_id) THEN -2e-1 ELSE 0e0 END + CASE WHEN media_type = 'photo' THEN photo_bias ELSE 0e0 END ELSE 0e0 END AS adjustment FROM k JOIN prof USING (project_id)""")(
    lambda s, d: marked(s, d).join(preference.learn(marked(s, d)), "project_id").select("media_id", preference.adjustment().alias("adjustment"))
)

# Timelines and their rules.
query("reflow", f"{_CLIPS} SELECT project_id, clip_idx, start_ms, end_ms, chapter FROM c")(lambda s, d: clips(s, d).select("project_id", "clip_idx", "start_ms", "end_ms", "chapter"))
query("timeline_validate", f"{_CLIPS}, x AS (SELECT project_id, clip_idx, start_ms + clip_idx * 37 % 5 * 60 AS a, end_ms + clip_idx * 37 % 5 * 60 AS b FROM c), y AS (SELECT *, a - lag(b) OVER (PARTITION BY project_id ORDER BY clip_idx) AS gap_ms FROM x) SELECT project_id, clip_idx, gap_ms, CASE WHEN gap_ms > 0 THEN 'gap' ELSE 'overlap' END AS issue FROM y WHERE abs(gap_ms) > 100")(
    lambda s, d: sequence.timeline_issues(clips(s, d).withColumn("__o", F.col("clip_idx") * 37 % 5 * 60).withColumns({"start_ms": F.col("start_ms") + F.col("__o"), "end_ms": F.col("end_ms") + F.col("__o")}), KEY, ["clip_idx"])
)
query("timeline_summary", f"{_CLIPS} SELECT project_id, count(*) AS clips, count(*) FILTER (media_type <> 'photo') AS video_clips, count(*) FILTER (media_type = 'photo') AS photo_clips, max(end_ms) / 1000e0 AS duration_sec, count(DISTINCT chapter) AS chapters FROM c GROUP BY 1")(lambda s, d: summary.timeline_summary(clips(s, d)))
_LINT = f"""{_CLIPS}, t3 AS (SELECT project_id, clip_idx FROM (SELECT *, lead(shot_role, 1) OVER w AS r1, lead(shot_role, 2) OVER w AS r2 FROM c WINDOW w AS (PARTITION BY project_id ORDER BY clip_idx)) WHERE shot_role = r1 AND shot_role = r2),
b AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY clip_idx) AS n FROM c), b2 AS (SELECT *, n - row_number() OVER (PARTITION BY project_id ORDER BY clip_idx) AS run FROM b WHERE motion_intensity > 6e-1 OR shot_role = 'action'),
br AS (SELECT project_id, clip_idx FROM b2 QUALIFY row_number() OVER (PARTITION BY project_id, run ORDER BY clip_idx) % 3 = 0)"""
query("grammar_lint", f"{_LINT} SELECT project_id, clip_idx, 'consecutive_same_role' AS rule FROM t3 UNION ALL SELECT project_id, clip_idx, 'needs_breath' FROM br")(lambda s, d: grammar.triple_roles(clips(s, d)).unionByName(grammar.breathless(clips(s, d))))
query("grammar_violations", f"{_LINT} SELECT project_id, (SELECT count(*) FROM t3 WHERE t3.project_id = p.project_id) AS same_role, (SELECT count(*) FROM br WHERE br.project_id = p.project_id) AS needs_breath FROM (SELECT DISTINCT project_id FROM c) p")(lambda s, d: grammar.violations(clips(s, d)))
query("jump_rate", f"""{_CLIPS}, j AS (SELECT *, lag(event_id) OVER (PARTITION BY project_id ORDER BY clip_idx) <> event_id AS jump FROM c), rr AS (SELECT project_id, chapter, count(*) FILTER (jump) AS jumps, (max(end_ms) - min(start_ms)) / 1000e0 AS seconds FROM j GROUP BY ALL)
SELECT *, CASE WHEN seconds > 0 THEN jumps / seconds ELSE 0e0 END AS rate, CASE WHEN seconds > 0 THEN jumps / seconds ELSE 0e0 END > 25e-2 AS violation FROM rr""")(lambda s, d: grammar.jump_rates(clips(s, d)))
query("chapter_transitions", f"""{_CLIPS} SELECT project_id, clip_idx, CASE WHEN coalesce(lag(chapter) OVER w, chapter) = chapter THEN 'cut' WHEN lag(event_id) OVER w = event_id THEN 'cross_dissolve' ELSE 'fade_in' END AS transition_in,
  CASE WHEN coalesce(lead(chapter) OVER w, chapter) = chapter THEN 'cut' WHEN lead(event_id) OVER w = event_id THEN 'cross_dissolve' ELSE 'fade_out' END AS transition_out FROM c WINDOW w AS (PARTITION BY project_id ORDER BY clip_idx)""")(lambda s, d: grammar.chapter_edges(clips(s, d)).select("project_id", "clip_idx", "transition_in", "transition_out"))
query("cinematic_edges", f"""{_CLIPS}, x AS (SELECT *, lag(chapter) OVER w AS b, lead(chapter) OVER w AS a FROM c WINDOW w AS (PARTITION BY project_id ORDER BY clip_idx))
SELECT project_id, clip_idx, CASE WHEN b IS NULL THEN 'fade_from_black' WHEN b <> chapter THEN 'fade_in' ELSE 'cut' END AS transition_in, CASE WHEN a IS NULL THEN 'fade_to_black' WHEN a <> chapter THEN 'fade_out' ELSE 'cut' END AS transition_out,
  greatest(CASE WHEN b <> chapter OR a <> chapter THEN 5e-1 ELSE 0e0 END, CASE WHEN b IS NULL THEN 1e0 ELSE 0e0 END, CASE WHEN a IS NULL THEN 15e-1 ELSE 0e0 END) AS transition_duration FROM x""")(lambda s, d: grammar.cinematic_edges(clips(s, d)).select("project_id", "clip_idx", "transition_in", "transition_out", "transition_duration"))
query("semantic_transitions", f"""{_CLIPS}, x AS (SELECT *, lag(chapter) OVER w AS pc, lag(event_id) OVER w AS pe, lag(shot_end) OVER w AS pend, lag({_EMOTION}) OVER w AS pemo, lag(media_type) OVER w AS pm FROM c WINDOW w AS (PARTITION BY project_id ORDER BY clip_idx))
SELECT * FROM (SELECT project_id, clip_idx, CASE WHEN pc IS NULL OR pc <> chapter THEN NULL WHEN pe = event_id AND abs(shot_start - pend) > 30 THEN 'semantic_time_jump' WHEN abs({_EMOTION} - pemo) > 5e-1 THEN 'semantic_emotion_contrast' WHEN pm <> media_type THEN 'semantic_media_switch' END AS rule FROM x) WHERE rule IS NOT NULL""")(
    lambda s, d: grammar.semantic_transitions(grammar.cinematic_edges(clips(s, d)).withColumns({"transition_in": F.when(F.col("transition_in") == "fade_from_black", "cut").otherwise(F.col("transition_in")), "transition_out": F.when(F.col("transition_out") == "fade_to_black", "cut").otherwise(F.col("transition_out"))})).filter("rule IS NOT NULL").select("project_id", "clip_idx", "rule")
)
query("emotion_gradient", f"""{_CLIPS}, x AS (SELECT project_id, CAST(floor(abs({_EMOTION} - lag({_EMOTION}) OVER (PARTITION BY project_id ORDER BY clip_idx)) * 1000000 + 5e-1) AS BIGINT) AS d FROM c)
SELECT project_id, CASE WHEN count(d) = 0 THEN 1e0 ELSE greatest(0e0, least(1e0, 1e0 - 2e0 * (sum(d)::DOUBLE / count(d) / 1000000))) END AS emotion_gradient FROM x GROUP BY 1""")(lambda s, d: grammar.emotion_gradient(clips(s, d)))

# Reports.
_ALIGNED = f"{_BEAT_D} <= 12e-2"
query("kpi_summary", f"""{_CLIPS}, n AS (SELECT project_id, count(DISTINCT event_id) AS ev FROM e GROUP BY 1)
SELECT c.project_id, count(*) AS total_clips, max(end_ms) / 1000e0 AS total_duration_sec, count(DISTINCT source_id) AS unique_sources, count(DISTINCT event_id)::DOUBLE / any_value(ev) AS event_coverage, count(*) FILTER (highlight_score >= 5e-1) AS highlight_count,
  count(*) FILTER (highlight_score >= 5e-1)::DOUBLE / count(*) AS highlight_rate, count(*) FILTER ({_ALIGNED})::DOUBLE / count(*) AS beat_alignment_rate FROM c JOIN n ON n.project_id = c.project_id GROUP BY 1""")(lambda s, d: summary.kpi_summary(clips(s, d), sessions(s, d), TRACK.beats, F.col("t")))
query("rhythm_stats", f"{_CLIPS} SELECT project_id, count(*) AS total_cuts, count(*) FILTER ({_ALIGNED}) AS beat_aligned_cuts, count(*) FILTER ({_ALIGNED})::DOUBLE / count(*) AS beat_alignment_ratio FROM c GROUP BY 1")(lambda s, d: summary.rhythm_stats(clips(s, d), TRACK.beats, F.col("t")))
_PARTS = ", ".join(f"({i}, '{x.label}', {x.start}e0, {x.end}e0, {x.energy}e0)" for i, x in enumerate(TRACK.sections))
query("section_stats", f"""{_CLIPS}, p AS (SELECT * FROM (VALUES {_PARTS}) v(section_idx, label, "start", "end", avg_energy)), k AS (SELECT DISTINCT project_id FROM c)
SELECT k.project_id, CAST(section_idx AS INTEGER) AS section_idx, label, p.start, p."end", avg_energy, count(c.t) AS clip_count, coalesce({_mean('motion_intensity').replace('count(*)', 'nullif(count(c.t), 0)')}, 0e0) AS avg_motion
FROM k CROSS JOIN p LEFT JOIN c ON c.project_id = k.project_id AND c.t >= p.start AND c.t < p."end" GROUP BY ALL""")(lambda s, d: summary.section_stats(clips(s, d), TRACK.sections, F.col("t")))
query("section_roles", f"{_LABELLED} SELECT project_id, section, shot_role, count(*) AS n, count(*) FILTER ({_MISMATCH}) AS mismatches FROM l WHERE section IS NOT NULL GROUP BY ALL")(lambda s, d: summary.section_roles(clips(s, d), TRACK.sections, F.col("t")))
query("section_role_stats", f"""{_LABELLED}, x AS (SELECT project_id, count(*) FILTER (section IS NOT NULL) AS clips_in_sections, count(*) FILTER (section IS NOT NULL AND {_MISMATCH}) AS mismatches,
  coalesce(count(*) FILTER (section = 'chorus' AND highlight_score >= 5e-1)::DOUBLE / nullif(count(*) FILTER (section = 'chorus'), 0), 0e0) AS a,
  coalesce(count(*) FILTER (coalesce(section, '') <> 'chorus' AND highlight_score >= 5e-1)::DOUBLE / nullif(count(*) FILTER (coalesce(section, '') <> 'chorus'), 0), 0e0) AS b FROM l GROUP BY 1)
SELECT project_id, a AS chorus_highlight_rate, b AS non_chorus_highlight_rate, a - b AS chorus_highlight_lift, clips_in_sections, mismatches, CASE WHEN clips_in_sections > 0 THEN mismatches::DOUBLE / clips_in_sections ELSE 0e0 END AS mismatch_rate FROM x""")(lambda s, d: summary.section_role_stats(clips(s, d), TRACK.sections, F.col("t")))
query("chapter_energy", f"{_CLIPS} SELECT project_id, chapter, count(*) AS clip_count, count(*) FILTER (highlight_score >= 5e-1) AS highlight_count, {_mean(_EMOTION)} AS avg_emotion, max({_EMOTION}) AS peak_emotion FROM c GROUP BY ALL")(lambda s, d: summary.chapter_energy(clips(s, d)))
query("kpi_selected", f"""{_CLIPS}, n AS (SELECT project_id, count(DISTINCT event_id) AS ev FROM e GROUP BY 1)
SELECT c.project_id, count(*) AS total_clips, max(end_ms) / 1000e0 AS total_duration_sec, count(DISTINCT source_id) AS unique_sources, count(DISTINCT event_id)::DOUBLE / any_value(ev) AS event_coverage, count(*) FILTER (highlight_score >= 5e-1) AS highlight_count,
  count(*) FILTER (highlight_score >= 5e-1)::DOUBLE / count(*) AS highlight_rate, count(*) FILTER ({_ALIGNED})::DOUBLE / count(*) AS beat_alignment_rate FROM c JOIN n ON n.project_id = c.project_id WHERE clip_idx % 9 = 0 GROUP BY 1""")(
    lambda s, d: summary.kpi_summary(clips(s, d).filter("clip_idx % 9 = 0"), sessions(s, d), TRACK.beats, F.col("t"))
)
query("mean_qualities", f"{_SHOTS} SELECT {', '.join(f'{_mean(q)} AS {q}' for q in preference.BIASES.values())} FROM s")(lambda s, d: preference.mean_qualities(shots(s, d)))
query("role_coverage", f"{_CLIPS}, rr AS (SELECT project_id, chapter, count(DISTINCT shot_role) AS n FROM c GROUP BY ALL) SELECT project_id, count(*) FILTER (n >= 2)::DOUBLE / count(*) AS chapter_role_coverage_rate FROM rr GROUP BY 1")(lambda s, d: summary.role_coverage(clips(s, d)))
query("story_metrics", f"""{_LINT}, l AS (SELECT *, {_case('section')} FROM c), gv AS (SELECT project_id, count(*) AS gv FROM (SELECT project_id FROM t3 UNION ALL SELECT project_id FROM br) GROUP BY 1), x AS (SELECT *, lag(source_id) OVER (PARTITION BY project_id ORDER BY clip_idx) = source_id AS same FROM l), rr AS (SELECT project_id, chapter, count(DISTINCT shot_role) AS n FROM c GROUP BY ALL), cov AS (SELECT project_id, count(*) FILTER (n >= 2)::DOUBLE / count(*) AS cr FROM rr GROUP BY 1)
SELECT x.project_id, sum(duration_ms) / 1000e0 / 240 AS duration_achievement_rate, 1e0 AS event_coverage_rate, count(*) FILTER (same)::DOUBLE / greatest(count(*) - 1, 1) AS repeated_shot_rate, count(*) FILTER (highlight_score >= 5e-1)::DOUBLE / count(*) AS highlight_hit_rate, 1e0 AS audio_presence_rate, coalesce(any_value(gv), 0) AS grammar_violations, any_value(cr) AS chapter_role_coverage_rate,
  coalesce(count(*) FILTER (section = 'chorus' AND highlight_score >= 5e-1)::DOUBLE / nullif(count(*) FILTER (section = 'chorus'), 0), 0e0) - coalesce(count(*) FILTER (coalesce(section, '') <> 'chorus' AND highlight_score >= 5e-1)::DOUBLE / nullif(count(*) FILTER (coalesce(section, '') <> 'chorus'), 0), 0e0) AS chorus_highlight_lift
FROM x JOIN cov USING (project_id) LEFT JOIN gv USING (project_id) GROUP BY x.project_id""")(lambda s, d: summary.story_metrics(clips(s, d), sessions(s, d), TRACK.sections, F.col("t"), 240.0))
_PICKED = "clip_idx % 4 = 0"
query("rejected_anti", f"{_CLIPS} SELECT media_id, {_REASON} AS reason FROM c WHERE NOT ({_PICKED})")(lambda s, d: summary.rejected(clips(s, d).filter(_PICKED), sessions(s, d)).select("media_id", "reason"))
query("best_alternative", f"""{_CLIPS}, best AS (SELECT project_id, event_id, media_id AS alt_media_id FROM c WHERE NOT ({_PICKED}) QUALIFY row_number() OVER (PARTITION BY project_id, event_id ORDER BY {_OVERALL} DESC, media_id) = 1)
SELECT c.project_id, clip_idx, event_id, media_id, alt_media_id FROM c JOIN best USING (project_id, event_id) WHERE {_PICKED}""")(lambda s, d: summary.best_alternatives(clips(s, d).filter(_PICKED), sessions(s, d)).select("project_id", "clip_idx", "event_id", "media_id", "alt_media_id"))
_FRAME = "CAST(round_even(start_ms / 1000e0 * 30, 0) AS BIGINT) AS frame"
query("markers", f"""{_CLIPS} SELECT project_id, clip_idx, 'chapter' AS kind, 'Chapter: ' || chapter AS name, 'Chapter start: ' || chapter AS comment, 'Blue' AS colour, {_FRAME} FROM c QUALIFY row_number() OVER (PARTITION BY project_id, chapter ORDER BY clip_idx) = 1
UNION ALL (SELECT project_id, clip_idx, 'event', 'Event ' || event_id, 'Event ' || event_id || ' start', 'Green', {_FRAME} FROM c QUALIFY row_number() OVER (PARTITION BY project_id, event_id ORDER BY clip_idx) = 1)
UNION ALL SELECT project_id, clip_idx, 'highlight', 'Highlight: ' || coalesce(nullif(highlight_reason, ''), 'highlight'), source_id || ' | score=0.000 | ', 'Red', {_FRAME} FROM c WHERE highlight_score >= 5e-1""")(lambda s, d: summary.markers(clips(s, d)))
query("story_notes", f"""{_CLIPS}, a AS (SELECT project_id, chapter, 'highlight' AS note, CAST(row_number() OVER (PARTITION BY project_id, chapter ORDER BY clip_idx) AS INTEGER) AS place, clip_idx, media_id FROM c WHERE highlight_score >= 5e-1),
b AS (SELECT project_id, chapter, 'weak' AS note, CAST(row_number() OVER (PARTITION BY project_id, chapter ORDER BY {_OVERALL}, clip_idx) AS INTEGER) AS place, clip_idx, media_id FROM c) SELECT * FROM a WHERE place <= 3 UNION ALL SELECT * FROM b WHERE place <= 2""")(lambda s, d: summary.notes(clips(s, d)))
query("chapter_durations", f"{_CLIPS} SELECT project_id, chapter, sum(duration_ms) / 1000e0 AS seconds FROM c GROUP BY ALL")(lambda s, d: clips(s, d).groupBy("project_id", "chapter").agg((F.sum("duration_ms") / 1000).alias("seconds")))
query("story_structure", f"{_CLIPS} SELECT project_id, chapter, count(DISTINCT event_id) AS events, count(*) AS clips FROM c GROUP BY ALL")(lambda s, d: summary.story_structure(clips(s, d)).select("project_id", "chapter", F.size("events").cast("bigint").alias("events"), F.aggregate("events", F.lit(0).cast("bigint"), lambda a, e: a + F.size(e["clips"])).alias("clips")))


# Files of reports, over the timeline and over a selection of it.
def report_shots(s: SparkSession, d: str) -> DataFrame:
    return sessions(s, d).withColumns({"source": F.concat(F.lit("/media/"), "media_id", F.lit(".mov")), "name": F.concat("media_id", F.lit(".mov")), "start": F.lit(0.0), "end": F.col("duration_ms") / 1000})


def timeline(s: SparkSession, d: str) -> DataFrame:
    rows = clips(s, d).withColumns({"source": F.concat(F.lit("/media/"), "media_id", F.lit(".mov")), "name": F.concat("media_id", F.lit(".mov")), "timeline_start": F.col("start_ms") / 1000, "timeline_end": F.col("end_ms") / 1000, "in_point": F.lit(0.0), "out_point": F.col("duration_ms") / 1000})
    return rows.withColumns({"total_score": S.overall(), "selection_reason": F.concat(F.lit("event="), "event_id"), "transition_in": F.lit("cut"), "transition_out": F.lit("cut"), "window_score": F.col("highlight_score")})


_METRICS = ", ".join(f"printf('%.4f', {m}) AS {m}" for m in reports.METRICS)
_FILE = "'/media/' || media_id || '.mov'"
query("selected_clips", f"{_CLIPS} SELECT project_id, clip_idx, {_FILE} AS source, media_type, event_id, printf('%.2f', 0e0) AS in_point, printf('%.2f', duration_ms / 1000e0) AS out_point, printf('%.2f', start_ms / 1000e0) AS timeline_start, printf('%.2f', end_ms / 1000e0) AS timeline_end, chapter, printf('%.4f', {_OVERALL}) AS total_score, {_METRICS}, 'event=' || event_id AS reason FROM c")(lambda s, d: reports.selected_rows(timeline(s, d)))
query("rejected_clips", f"{_CLIPS} SELECT project_id, media_id, {_FILE} AS source, media_type, event_id, shot_role, '0.00' AS start_sec, printf('%.2f', duration_ms / 1000e0) AS end_sec, printf('%.2f', duration_ms / 1000e0) AS duration, {_METRICS}, printf('%.4f', {_OVERALL}) AS overall_quality, {_REASON} AS rejection_reason FROM c WHERE NOT ({_PICKED})")(lambda s, d: reports.rejected_rows(timeline(s, d).filter(_PICKED), report_shots(s, d)))
query("candidates_csv", f"{_sessions()} SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY {_OVERALL} DESC, media_id) AS INTEGER) AS place, media_id || '.mov' AS filename, media_type, event_id, shot_role, '0.00' AS start_sec, printf('%.2f', duration_ms / 1000e0) AS end_sec, printf('%.2f', duration_ms / 1000e0) AS duration, {_METRICS}, printf('%.4f', {_OVERALL}) AS overall_quality, printf('%.4f', highlight_score) AS highlight_score, highlight_reason FROM e")(lambda s, d: reports.candidate_rows(report_shots(s, d)))
query("events_csv", f"{_EVENTS} SELECT project_id, event_id, shot_count, printf('%.1f', total_duration) AS total_duration, printf('%.3f', avg_quality) AS avg_quality, printf('%.3f', emotion_intensity) AS emotion_intensity, time_range, 'keep' AS action FROM ranked")(lambda s, d: reports.event_rows(report_shots(s, d)))
query("story_note_lines", f"""{_EVENTS}, o AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY ts, media_id) - 1 AS INTEGER) AS clip_idx, count(*) OVER (PARTITION BY project_id) AS n,
  sum(duration_ms) OVER (PARTITION BY project_id ORDER BY ts, media_id ROWS UNBOUNDED PRECEDING) AS end_ms, {_OVERALL} AS score FROM e),
c AS (SELECT *, (end_ms - duration_ms) / 1000e0 AS t, CASE WHEN clip_idx::DOUBLE / n < 1e-1 THEN 'opening' WHEN clip_idx::DOUBLE / n < 1e-1 + 45e-2 THEN 'learning' WHEN clip_idx::DOUBLE / n < 1e-1 + 45e-2 + 3e-1 THEN 'highlights' ELSE 'closing' END AS chapter FROM o),
tl AS (SELECT *, row_number() OVER (PARTITION BY project_id, chapter ORDER BY highlight_score < 5e-1, clip_idx) AS a, row_number() OVER (PARTITION BY project_id, chapter ORDER BY score, clip_idx) AS b FROM c),
p AS (SELECT project_id, chapter, min(clip_idx) AS first, '## ' || chapter AS l1, '- Duration: ' || printf('%.1f', sum(duration_ms) / 1000e0) || 's, ' || count(*) || ' clips' AS l2, count(*) FILTER (highlight_score >= 5e-1) AS lit,
  list('  - ' || media_id || '.mov @ ' || printf('%.1f', t) || 's (' || highlight_reason || ')' ORDER BY clip_idx) FILTER (highlight_score >= 5e-1 AND a <= 3) AS shown, list('  - ' || media_id || '.mov @ ' || printf('%.1f', t) || 's (score=' || printf('%.3f', score) || ')' ORDER BY score, clip_idx) FILTER (b <= 2) AS weak FROM tl GROUP BY ALL),
ev AS (SELECT project_id, chapter, list('- Event ' || event_id || ': ' || time_range || ' (' || shot_count || ' shots)' ORDER BY event_id) AS told FROM (SELECT DISTINCT project_id, chapter, event_id FROM c) JOIN ranked USING (project_id, event_id) GROUP BY ALL),
w AS (SELECT project_id, -1 AS first, ['# Story Notes', 'Total duration: ' || printf('%.1f', max(end_ms) / 1000e0) || 's, ' || count(*) || ' clips', ''] AS lines FROM c GROUP BY 1 UNION ALL
  SELECT project_id, first, list_concat(list_concat([l1, l2], told), list_concat(CASE WHEN lit > 0 THEN list_concat(['- Highlights: ' || lit], shown) ELSE [] END, list_concat(list_concat(['- Suggested replacements:'], weak), ['']))) FROM p JOIN ev USING (project_id, chapter)),
u AS (SELECT project_id, first, unnest(range(len(lines))) AS k, lines FROM w)
SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY first, k) - 1 AS INTEGER) AS line_no, lines[k + 1] AS line FROM u""")(lambda s, d: reports.note_lines(timeline(s, d), report_shots(s, d)))


@query("report_rows", f"""{_CLIPS}, k AS (SELECT project_id, count(*) AS total_clips, count(DISTINCT chapter) AS chapters, count(DISTINCT event_id) AS events, count(*) FILTER (highlight_score >= 5e-1) AS highlights, max(end_ms) / 1000e0 AS total_duration FROM c WHERE {_PICKED} GROUP BY 1),
f AS (SELECT project_id, count(*) AS rejected_count, count(DISTINCT event_id) AS all_events FROM (SELECT project_id, event_id, {_PICKED} AS p FROM c) GROUP BY 1), x AS (SELECT project_id, count(*) AS n FROM c WHERE NOT ({_PICKED}) GROUP BY 1),
ce AS (SELECT project_id, max(CAST(round({_EMOTION} * 1000000) AS BIGINT)) AS peak FROM c WHERE {_PICKED} GROUP BY 1)
SELECT project_id, total_clips, total_duration, chapters, chapters AS story_chapters, chapters AS covered_chapters, total_clips AS selected, total_clips AS story_clips, highlights, all_events AS event_rows, {len(TRACK.sections)}::BIGINT AS sections, coalesce(n, 0) AS rejected_count FROM k JOIN f USING (project_id) LEFT JOIN x USING (project_id)""")
def report_rows(s, d):
    """The nested report of every project, by the sizes of its parts."""
    found = reports.report_rows(timeline(s, d).filter(_PICKED), report_shots(s, d), TRACK)
    size = lambda c: F.size(c).cast("bigint")
    return found.select(
        "project_id", "summary.total_clips", "summary.total_duration", size("summary.chapters").alias("chapters"), size("story_structure").alias("story_chapters"), size("role_coverage").alias("covered_chapters"), size("selected_clips").alias("selected"),
        F.aggregate("story_structure", F.lit(0).cast("bigint"), lambda a, x: a + x["clip_count"]).alias("story_clips"), "kpi_summary.highlight_count", size("event_summary").alias("event_rows"), size("rhythm_alignment.sections").alias("sections"), "rejected_count",
    ).withColumnRenamed("highlight_count", "highlights")


# Plans.
def plan_input(s: SparkSession, d: str) -> DataFrame:
    """Shots of each project in input order: videos before stills. Events are dealt out once, as they are read, for all windows and the planner."""
    rows = sessions(s, d, events=streams.dealt(table(s, d, "events"), ["user_id"])).withColumns({"overall": S.overall(), "emotion": S.emotion(), "start": F.lit(0.0), "end": F.col("duration_ms") / 1000, "hhmm": F.date_format("ts", "HH:mm"), "at": F.unix_micros(F.col("ts").cast("timestamp")), "best_start": F.lit(None).cast("double"), "best_end": F.lit(None).cast("double"), "preference": F.lit(0.0)})
    return rows.withColumn("input_idx", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("media_type") == "photo", "media_id"))).drop("ts")


def planned(s: SparkSession, d: str, template: str) -> DataFrame:
    return planner.plan(plan_input(s, d), PROFILES[template], TRACK)


def plan_table(s: SparkSession, d: str, template: str) -> DataFrame:
    """A plan that is read more than once: made once, as a table."""
    return store.written(planned(s, d, template), "planned")


def ruled(s: SparkSession, d: str, template: str = "growth") -> DataFrame:
    """A plan after the rules."""
    return grammar.apply(plan_table(s, d, template))[0]


query("plan_growth")(lambda s, d: planned(s, d, "growth"))
query("plan_travel")(lambda s, d: planned(s, d, "travel"))
query("plan_then_grammar")(lambda s, d: ruled(s, d))


@query("comparison_before_after")
def comparison_before_after(s, d):
    """The eight metrics of every project's plan before and after the rules, and their differences."""
    plan = plan_table(s, d, "growth")
    found = reports.comparison_rows(plan, grammar.apply(plan)[0], sessions(s, d), TRACK, PROFILES["growth"].target_duration_sec, True)
    return found.select("project_id", *[F.col(f"{part}.{c}").alias(f"{part}_{c}") for part in ("before", "after", "delta") for c in reports.COMPARED])


@query("grammar_report")
def grammar_report(s, d):
    """What the rules found in every project's plan."""
    return grammar.apply(plan_table(s, d, "growth"))[1].withColumn("details", F.to_json("details"))

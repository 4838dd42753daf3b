"""Rules of a sequence of clips: lint with windows, repair with a pass per project."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from spindle.functions import scores as S
from spindle.operators import streams
from spindle.sources import store

MAX_JUMPS_PER_SEC = 0.25
CONTENT = ["media_id", "source_id", "media_type", "event_id", "shot_role", "highlight_score", "sharpness", "exposure", "stability", "face_score", "motion_intensity", "in_point", "out_point", "shot_start", "shot_end", "total_score", "selection_reason"]


def _by(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("clip_idx")


def triple_roles(clips: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Clips that begin three of one role."""
    w = _by(keys)
    hit = (F.col("shot_role") != "") & (F.col("shot_role") == F.lead("shot_role", 1).over(w)) & (F.col("shot_role") == F.lead("shot_role", 2).over(w))
    return clips.withColumn("__hit", hit).filter("__hit").select(*keys, "clip_idx", F.lit("consecutive_same_role").alias("rule"))


def breathless(clips: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Every third clip of a run of high action; the count starts anew after each."""
    w = _by(keys)
    busy = (F.col("motion_intensity") > 0.6) | (F.col("shot_role") == "action")
    rows = clips.withColumns({"__busy": F.coalesce(busy, F.lit(False)), "__n": F.row_number().over(w)}).filter("__busy")
    rows = rows.withColumn("__run", F.col("__n") - F.row_number().over(w))
    rows = rows.withColumn("__pos", F.row_number().over(Window.partitionBy(*keys, "__run").orderBy("clip_idx")))
    return rows.filter("__pos % 3 = 0").select(*keys, "clip_idx", F.lit("needs_breath").alias("rule"))


def jump_rates(clips: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Per chapter: changes of event (against the whole timeline), seconds, rate and whether it is too high."""
    rows = clips.withColumn("__jump", F.lag("event_id").over(_by(keys)) != F.col("event_id"))
    per = rows.groupBy(*keys, "chapter").agg(F.count_if("__jump").alias("jumps"), ((F.max("end_ms") - F.min("start_ms")) / 1000).alias("seconds"))
    return per.withColumn("rate", F.when(F.col("seconds") > 0, F.col("jumps") / F.col("seconds")).otherwise(F.lit(0.0))).withColumn("violation", F.col("rate") > MAX_JUMPS_PER_SEC)


def violations(clips: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Per project: triples of a role and breathless runs."""
    found = triple_roles(clips, keys).unionByName(breathless(clips, keys))
    counts = found.groupBy(*keys).agg(F.count_if(F.col("rule") == "consecutive_same_role").alias("same_role"), F.count_if(F.col("rule") == "needs_breath").alias("needs_breath"))
    every = clips.select(*keys).distinct()
    return every.join(counts, list(keys), "left").select(*keys, F.coalesce("same_role", F.lit(0)).alias("same_role"), F.coalesce("needs_breath", F.lit(0)).alias("needs_breath"))


def chapter_edges(clips: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Transitions of half a second put in at changes of chapter that are plain cuts as yet: a dissolve within an event, else fades.

    Columns transition_in, transition_out and transition_duration, where there;
    edge_fixed marks the clip after each change that was put in.
    """
    w = _by(keys)
    for name, kind in (("transition_in", "cut"), ("transition_out", "cut"), ("transition_duration", 0.0)):
        clips = clips if name in clips.columns else clips.withColumn(name, F.lit(kind))
    enters = (F.lag("chapter").over(w) != F.col("chapter")) & (F.lag("transition_out").over(w) == "cut")
    leaves = (F.lead("chapter").over(w) != F.col("chapter")) & (F.col("transition_out") == "cut")
    kind = lambda other, fade: F.when(other == F.col("event_id"), "cross_dissolve").otherwise(fade)
    done = clips.withColumns({
        "edge_fixed": F.coalesce(enters, F.lit(False)),
        "__in": F.when(enters, kind(F.lag("event_id").over(w), "fade_in")).otherwise(F.col("transition_in")),
        "__out": F.when(leaves, kind(F.lead("event_id").over(w), "fade_out")).otherwise(F.col("transition_out")),
        "__sec": F.when(F.coalesce(enters, F.lit(False)) | F.coalesce(leaves, F.lit(False)), F.lit(0.5)).otherwise(F.col("transition_duration")),
    })
    return done.withColumns({"transition_in": F.col("__in"), "transition_out": F.col("__out"), "transition_duration": F.col("__sec")}).drop("__in", "__out", "__sec")


def cinematic_edges(clips: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """The planner's transitions: fades at changes of chapter, from black at first and to black at last."""
    w = _by(keys)
    first, last = F.lag("chapter").over(w).isNull(), F.lead("chapter").over(w).isNull()
    enters, leaves = F.lag("chapter").over(w) != F.col("chapter"), F.lead("chapter").over(w) != F.col("chapter")
    seconds = F.when(enters | leaves, F.lit(0.5)).otherwise(F.lit(0.0))
    return clips.withColumns({
        "transition_in": F.when(first, "fade_from_black").when(enters, "fade_in").otherwise("cut"),
        "transition_out": F.when(last, "fade_to_black").when(leaves, "fade_out").otherwise("cut"),
        "transition_duration": F.greatest(F.coalesce(seconds, F.lit(0.0)), F.when(first, F.lit(1.0)).otherwise(F.lit(0.0)), F.when(last, F.lit(1.5)).otherwise(F.lit(0.0))),
    })


def semantic_transitions(clips: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Where a pair within a chapter is a plain cut: the rule that asks for more, its kind and seconds.

    Needs shot_start and shot_end, and transition_in and transition_out where set.
    """
    w = _by(keys)
    prev = lambda c: F.lag(c).over(w)
    pair = (prev("chapter") == F.col("chapter")) & (prev("transition_out") == "cut") & (F.col("transition_in") == "cut")
    jump = (prev("event_id") == F.col("event_id")) & (F.col("event_id") >= 0) & (F.abs(F.col("shot_start") - prev("shot_end")) > 30)
    contrast = F.abs(S.emotion() - F.lag(S.emotion()).over(w)) > 0.5
    switch = (prev("media_type") == "photo") != (F.col("media_type") == "photo")
    rule = F.when(~pair, None).when(jump, "semantic_time_jump").when(contrast, "semantic_emotion_contrast").when(switch, "semantic_media_switch")
    out = clips.withColumn("rule", rule)
    return out.withColumns({"kind": F.when(F.col("rule") == "semantic_emotion_contrast", "fade").when(F.col("rule").isNotNull(), "cross_dissolve"), "seconds": F.when(F.col("rule") == "semantic_time_jump", F.lit(0.5)).when(F.col("rule").isNotNull(), F.lit(0.4))})


def with_semantic_transitions(clips: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """The transitions of semantic_transitions put into both clips of each pair; of two lengths a clip keeps its later edge's."""
    found = semantic_transitions(clips, keys)
    w = _by(keys)
    enter, leave = F.col("kind"), F.lead("kind").over(w)
    done = found.withColumns({
        "__in": F.when(enter == "fade", "fade_in").when(enter.isNotNull(), enter).otherwise(F.col("transition_in")),
        "__out": F.when(leave == "fade", "fade_out").when(leave.isNotNull(), leave).otherwise(F.col("transition_out")),
        "__sec": F.coalesce(F.lead("seconds").over(w), F.col("seconds"), F.col("transition_duration")),
    })
    return done.withColumns({"transition_in": F.col("__in"), "transition_out": F.col("__out"), "transition_duration": F.col("__sec")}).drop("__in", "__out", "__sec", "kind", "seconds")


def emotion_gradient(clips: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """1 less twice the mean change of emotion, 0 to 1; 1 for under two clips."""
    delta = F.abs(S.emotion() - F.lag(S.emotion()).over(_by(keys)))
    rows = clips.withColumn("__d", F.floor(delta * 1000000 + 0.5).cast("bigint"))
    mean = F.sum("__d").cast("double") / F.count("__d") / 1000000
    return rows.groupBy(*keys).agg(F.when(F.count("__d") == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.lit(2.0) * mean))).alias("emotion_gradient"))


def swap_roles(clips: DataFrame, key: str = "project_id", reach: int = 8, told: bool = False) -> DataFrame:
    """Breaks up threes of one role: the third changes its content with the next clip of another role in its chapter, if one is near.

    A pass per project, as each swap changes what the next step sees. With
    ``told`` a project's first clip has the threes that were met, in __triples.
    """
    names, content = clips.columns, [c for c in CONTENT if c in clips.columns]
    triples = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("role", T.StringType())]))

    def repaired(roles: list, chapters: list) -> tuple[list[int], list[tuple[int, str]]]:
        order, met, at = list(range(len(roles))), [], 0
        while at + 2 < len(order):
            three = {roles[order[at + d]] for d in range(3)}
            step = 1
            if len(three) == 1 and (role := three.pop()):
                third = at + 2
                met.append((at, role))
                partner = next((j for j in range(at + 3, min(at + reach, len(order))) if roles[order[j]] != role and chapters[j] == chapters[third]), None)
                if partner is None:
                    step = 3
                else:
                    order[third], order[partner] = order[partner], order[third]
            at += step
        return order, met

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in streams.whole_groups(batches):
            roles, chapters = table["shot_role"].to_pylist(), table["chapter"].to_pylist()
            order, threes = [], [[] for _ in roles]
            for i, j in zip(edges, edges[1:], strict=False):
                own, threes[i] = repaired(roles[i:j], chapters[i:j])
                order += [i + k for k in own]
            moved = table.take(pa.array(order, pa.int64()))
            columns = [(moved if c in content else table)[c] for c in names]
            if told:
                columns.append(pa.array([[{"at": at, "role": role} for at, role in x] for x in threes], arrow))
            yield from pa.Table.from_arrays(columns, names=[*names, *(['__triples'] if told else [])]).combine_chunks().to_batches()

    arrow = to_arrow_type(triples)
    schema = T.StructType([*clips.schema.fields, T.StructField("__triples", triples)]) if told else clips.schema
    return streams.marked(clips, [key], ["clip_idx"]).mapInArrow(stream, schema)


def _details(swapped: DataFrame, edged: DataFrame, ruled: DataFrame, key: str) -> DataFrame:
    """(key, step, rule, clip_index, description) of what each rule found, in its order."""
    triples = swapped.select(key, F.lit(1).alias("step"), F.explode("__triples").alias("t")).select(key, "step", F.lit("consecutive_same_role").alias("rule"), F.col("t.at").alias("clip_index"), F.concat(F.lit("3+ consecutive '"), F.col("t.role"), F.lit("' at clips "), F.col("t.at"), F.lit("-"), F.col("t.at") + 2).alias("description"))
    breaths = breathless(swapped, [key]).select(key, F.lit(2).alias("step"), "rule", F.col("clip_idx").alias("clip_index"), F.concat(F.lit("3+ consecutive high-action clips ending at "), "clip_idx").alias("description"))
    jumped = swapped.withColumn("__jump", F.lag("event_id").over(_by([key])) != F.col("event_id"))
    per = jumped.groupBy(key, "chapter").agg(F.count_if("__jump").alias("n"), F.min(F.when(F.col("__jump"), F.col("clip_idx"))).alias("clip_index"), (F.max("timeline_end") - F.min("timeline_start")).alias("sec"))
    rate = F.col("n") / F.col("sec")
    jumps = per.filter((F.col("sec") > 0) & (rate > MAX_JUMPS_PER_SEC)).select(key, F.lit(3).alias("step"), F.lit("cross_event_jump_rate").alias("rule"), "clip_index", F.concat(F.lit("Chapter '"), F.col("chapter"), F.lit("': "), F.col("n").cast("string"), F.lit(" event jumps in "), S.fixed(F.col("sec"), 1), F.lit("s (rate="), S.fixed(rate, 2), F.lit("/s, max=0.25/s)")).alias("description"))
    before = lambda c: F.lag(c).over(_by([key]))
    chapters = edged.withColumn("__before", before("chapter")).filter("edge_fixed").select(key, F.lit(4).alias("step"), F.lit("chapter_transition").alias("rule"), F.col("clip_idx").alias("clip_index"), F.concat(F.lit("Added transition between '"), F.col("__before"), F.lit("' and '"), F.col("chapter"), F.lit("'")).alias("description"))
    told = ruled.withColumns({"__gap": F.abs(F.col("shot_start") - before("shot_end")), "__delta": F.abs(S.emotion() - F.lag(S.emotion()).over(_by([key]))), "__still": before("media_type") == "photo"}).filter("rule IS NOT NULL")
    text = F.when(F.col("rule") == "semantic_time_jump", F.concat(F.lit("Time jump "), S.fixed(F.col("__gap"), 0), F.lit("s in event "), F.col("event_id").cast("string"))).when(F.col("rule") == "semantic_emotion_contrast", F.concat(F.lit("Emotion contrast "), S.fixed(F.col("__delta"), 2))).otherwise(F.when(F.col("__still"), "Media switch: photo\u2192video").otherwise("Media switch: video\u2192photo"))
    semantic = told.select(key, F.lit(5).alias("step"), "rule", F.col("clip_idx").alias("clip_index"), text.alias("description"))
    return triples.unionByName(breaths).unionByName(jumps).unionByName(chapters).unionByName(semantic)


def apply(clips: DataFrame, key: str = "project_id") -> tuple[DataFrame, DataFrame]:
    """The rules on planned clips: (clips after them, a report row for each project).

    Threes of a role are broken up, breathless runs marked in the reason, jumps
    between events counted, then transitions put in at chapters and within them.
    Projects of under three clips stay as they are, their report is all zeros.
    ``clips`` are read some times: a plan should be a table first. What was
    broken up is one, as all later rules read it.
    """
    clips = clips.withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    few, many = clips.filter("__n < 3").drop("__n"), clips.filter("__n >= 3").drop("__n")
    swapped = store.written(swap_roles(many, key, told=True), "swapped")
    breath = breathless(swapped, [key]).select(key, "clip_idx", F.lit(" [grammar:needs_breath]").alias("__mark"))
    marked = swapped.join(breath, [key, "clip_idx"], "left").withColumn("selection_reason", F.concat("selection_reason", F.coalesce("__mark", F.lit("")))).drop("__mark", "__triples")
    edged = chapter_edges(marked, [key])
    told = semantic_transitions(edged, [key])
    done = with_semantic_transitions(edged, [key]).select(few.columns)
    details = _details(swapped, edged, told, key)
    counts = details.groupBy(key).agg(
        *[F.count_if(F.col("step") == k).alias(n) for k, n in enumerate(("consecutive_same_role", "missing_breath_points", "cross_event_jump_violations", "chapter_transitions_fixed", "semantic_transitions_added"), 1)],
        F.count("*").alias("total_violations"), F.array_sort(F.collect_list(F.struct("step", "clip_index", "rule", "description"))).alias("details"),
    )
    both = lambda v, name: violations(v, [key]).select(key, (F.col("same_role") + F.col("needs_breath")).alias(name))
    report = both(many, "violations_before").join(both(done, "violations_after"), key).join(emotion_gradient(done, [key]).withColumnRenamed("emotion_gradient", "emotion_gradient_score"), key).join(counts, key, "left")
    every = clips.select(key).distinct().join(report, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    numbers = ["consecutive_same_role", "missing_breath_points", "chapter_transitions_fixed", "cross_event_jump_violations", "semantic_transitions_added", "total_violations", "violations_before", "violations_after"]
    return few.unionByName(done), every.select(key, *map(zero, numbers), F.coalesce("emotion_gradient_score", F.lit(0.0)).alias("emotion_gradient_score"), F.coalesce("details", F.array().cast("array<struct<step:int,clip_index:int,rule:string,description:string>>")).alias("details"))

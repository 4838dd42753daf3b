"""The planner, the rules and the folds against plain loops over rows as dicts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators import grammar, music, planner, sequence, summary
from spindle.plans import catalog, templates

SF = "/root/testdata/sf0.001"
ROLES = ["establishing", "action", "reaction", "detail"]


# What a shot is worth, from a dict of its columns.
def story(chapter, r):
    q = lambda **k: sum(v * r[{"st": "stability", "sh": "sharpness", "ex": "exposure", "f": "face_score", "m": "motion_intensity"}[n]] for n, v in k.items())
    still = r["media_type"] == "photo"
    rules = {
        "opening": lambda: q(st=0.4, f=0.4, ex=0.2), "learning": lambda: q(st=0.3, sh=0.3, m=0.2, f=0.2), "highlights": lambda: q(f=0.5, m=0.3, sh=0.2),
        "closing": lambda: 0.8 if still else q(st=0.4, ex=0.3, f=0.3), "departure": lambda: q(st=0.3, m=0.3, ex=0.2, f=0.2),
        "exploration": lambda: min(1.0, q(sh=0.3, m=0.3, ex=0.2, st=0.2) + (0.1 if r["width"] > r["height"] else 0.0)),
        "interaction": lambda: q(f=0.5, st=0.3, sh=0.2), "ending": lambda: 0.7 if still else q(ex=0.4, st=0.3, sh=0.3),
    }
    return rules[chapter]()


def suits(label, r):
    likes = {"intro": ROLES[::3], "verse": ["establishing", "detail", "reaction"], "chorus": ["action", "reaction"], "bridge": ["reaction", "detail"], "outro": ["detail", "establishing", "reaction"]}
    if label is None:
        return 0.5
    role, h, st, sh, ex, m = r["shot_role"], r["highlight_score"], r["stability"], r["sharpness"], r["exposure"], r["motion_intensity"]
    plus = {
        "chorus": {"action": 0.35, "reaction": 0.2 if h >= 0.5 else 0.0}, "verse": {"establishing": 0.3, "detail": 0.3, "reaction": 0.15},
        "intro": {"establishing": 0.4, "detail": 0.3}, "outro": {"detail": 0.25, "establishing": 0.25}, "bridge": {"reaction": 0.3, "detail": 0.2},
    }[label].get(role, 0.0)
    value = {
        "chorus": lambda: m * 0.3 + h * 0.4 + (1 - st) * 0.1 + plus + (0.15 if h >= 0.6 else 0.0),
        "verse": lambda: st * 0.3 + sh * 0.2 + ex * 0.1 + plus - (0.1 if m > 0.7 else 0.0),
        "intro": lambda: st * 0.3 + ex * 0.2 + plus,
        "outro": lambda: st * 0.3 + ex * 0.2 + (0.3 if r["media_type"] == "photo" else 0.0) + plus,
        "bridge": lambda: st * 0.2 + sh * 0.2 + plus,
    }[label]()
    return max(0.0, min(1.0, value - (0.15 if role and role not in likes[label] else 0.0)))


class Song:
    def __init__(self, m, cfg):
        self.m, self.cfg, self.near = m, cfg, cfg.rhythm.tolerance_ms / 1000.0

    def label(self, t):
        for s in self.m.sections:
            if s.start <= t < s.end:
                return s.label
        return None

    def beat(self, t):
        return min(self.m.beats, key=lambda b: abs(b - t), default=None)

    def energy(self, t):
        c = self.m.curve
        if not c:
            return 0.5
        for (a, x), (b, y) in zip(c, c[1:]):
            if a <= t <= b:
                return x + (t - a) / (b - a) * (y - x)
        return c[0][1] if t <= c[0][0] else c[-1][1]


def worth(r, chapter, t, song, template, kept):
    w, label, near = template.weights, song.label(t), song.beat(t)
    rhythm = 0.5 if near is None else 1.0 if abs(t - near) <= song.near else 0.7 if abs(t - near) <= 3 * song.near else 0.3
    value = w[0] * ((r["sharpness"] + r["exposure"] + r["stability"]) / 3.0) + w[1] * r["face_score"] + w[2] * r["motion_intensity"] + w[3] * story(chapter, r) + w[4] * rhythm + w[5] * suits(label if song.m.sections else None, r)
    extra = 0.0
    if r["highlight_score"] >= 0.5:
        extra = r["highlight_score"] * 0.1
        if song.m.sections:
            extra += 0.25 if label == "chorus" else -0.1 if (r["source_id"], r["start"]) in kept else 0.0
    minus = (0.2 if r["exposure"] < 0.3 else 0.0) + (0.15 if r["sharpness"] < 0.2 else 0.0) + (0.1 if r["stability"] < 0.3 else 0.0)
    return max(0.0, value + extra + r["preference"] - minus)


def kept_for_choruses(rows, m):
    pool = sorted((r for r in rows if r["highlight_score"] >= 0.3), key=lambda r: -r["highlight_score"])
    kept, earlier = set(), set()
    for s in m.sections:
        if s.label != "chorus":
            continue
        room, own = max(2, int((s.end - s.start) / 3)), []
        choosy = len(pool) > room * 2
        for avoid in (earlier if choosy else set(), set()):
            for r in pool:
                k = (r["source_id"], r["start"])
                if len(own) < room and k not in kept and r["event_id"] not in avoid:
                    kept.add(k)
                    own.append(r["event_id"])
        earlier = earlier | set(own)
    return kept


def story_order(rows, mode):
    ids = sorted({r["event_id"] for r in rows})
    facts = {}
    for e in ids:
        own = [r for r in rows if r["event_id"] == e]
        facts[e] = (sum(r["overall"] for r in own) / len(own), sum(r["emotion"] for r in own) / len(own), len(own), min((r["at"], r["hhmm"]) for r in own)[1])
    tops = [max(f[i] for f in facts.values()) or 1 for i in range(3)]
    rank = {e: f[0] / tops[0] * 0.4 + f[1] / tops[1] * 0.35 + min(f[2] / tops[2], 1.0) * 0.25 for e, f in facts.items()}
    ids.sort(key=lambda e: -rank[e])
    if mode == "energy_first":
        ids.sort(key=lambda e: facts[e][1])
    else:
        ids.sort(key=lambda e: facts[e][3])
        if mode == "hybrid" and len(ids) >= 3:
            top = max(ids, key=lambda e: facts[e][1])
            ids.remove(top)
            ids.insert(int(len(ids) * 0.6), top)
    return ids, {e: f[1] for e, f in facts.items()}


def plain_plan(rows, cfg, m):
    template, song, kept = templates.TEMPLATES[cfg.template], Song(m, cfg), kept_for_choruses(rows, m)
    ids, feel = story_order(rows, cfg.narrative_mode)
    chapters, given = template.chapters, {c.name: [] for c in template.chapters}
    quota, free = max(1, len(ids) // len(chapters)), list(ids)
    for c in chapters:
        low, high = c.emotion
        line = [e for e in free if low <= feel[e] <= high]
        if len(line) < quota:
            line += sorted([e for e in free if e not in line], key=lambda e: abs(feel[e] - (low + high) / 2))
        given[c.name] = line[:quota]
        free = [e for e in free if e not in given[c.name]]
    for e in free:
        given[min(chapters, key=lambda c: abs(feel[e] - sum(c.emotion) / 2)).name].append(e)
    events = list(dict.fromkeys(r["event_id"] for r in rows))
    out, now, gone, uses, d = [], 0.0, set(), {}, cfg.diversity
    lo, hi = cfg.clip_duration_sec.min, cfg.clip_duration_sec.max
    for c in chapters:
        span, begin, mine = cfg.target_duration_sec * c.ratio, now, given[c.name]
        line = []
        for e in mine:
            own = sorted((r for r in rows if r["event_id"] == e), key=lambda r: -r["overall"])
            for role in ROLES:
                line += [(worth(r, c.name, now, song, template, kept), r, role) for r in own if (r["shot_role"] if r["shot_role"] in ROLES else "detail") == role]
        for e in events:
            if e not in mine:
                line += [(worth(r, c.name, now, song, template, kept) * 0.7, r, r["shot_role"] or "detail") for r in rows if r["event_id"] == e]
        line.sort(key=lambda x: -x[0])
        v, p = cfg.video_photo_ratio
        cap, spent = {"video": span * v / (v + p) * 1.2, "photo": span * p / (v + p) * 1.2}, {"video": 0.0, "photo": 0.0}
        before, same_source, same_event, same_role, streak, hops, seen_roles, seen_sources = (None, -1, ""), 0, 0, 0, 0.0, 0, set(), set()
        for base, r, arc in line:
            if now >= begin + span:
                break
            room, k, role = begin + span - now, (r["source_id"], r["start"]), r["shot_role"] or "unknown"
            if k in gone:
                continue
            e = song.energy(now)
            length = max(min(r["end"] - r["start"], max(lo, min(hi * (1.2 - cfg.rhythm.energy_clip_factor * e), hi * 1.2)), room), lo)
            if length > room:
                continue
            if r["source_id"] == before[0]:
                same_source += 1
                if same_source >= d.max_consecutive_same_source:
                    continue
                streak += length
                if streak > cfg.max_same_event_streak_sec:
                    continue
            else:
                same_source, streak = 0, length
            if r["event_id"] == before[1]:
                same_event += 1
                if same_event >= d.max_consecutive_same_event:
                    continue
            else:
                same_event, hops = 0, hops + (before[1] >= 0)
            if role == before[2]:
                same_role += 1
                if same_role >= d.max_consecutive_same_role:
                    continue
            else:
                same_role = 0
            spent_time = now - begin
            if hops and spent_time > 0 and hops / max(spent_time, 1.0) > 0.25 and r["event_id"] != before[1]:
                continue
            score = base - d.same_source_penalty * uses.get(r["source_id"], 0)
            if r["source_id"] in seen_sources:
                score -= d.chapter_repeat_penalty
            if role == before[2]:
                score -= d.same_angle_penalty
            if r["event_id"] in mine:
                score += 0.05
            share = spent_time / max(span, 0.1)
            want = "establishing" if share <= 0.15 else "action" if share <= 0.15 + 0.4 else "reaction" if share <= 0.15 + 0.4 + 0.3 else "detail"
            if arc == want:
                score += 0.08
            elif arc in ROLES and ROLES.index(arc) < ROLES.index(want):
                score += 0.03
            if len(seen_roles) < 2 and arc not in seen_roles:
                score += 0.10
            if score < 0.05:
                continue
            if r["media_type"] == "video" and r["motion_intensity"] < 0.3 and any(a <= now <= b for a, b in m.high):
                continue
            if spent[r["media_type"]] >= cap[r["media_type"]]:
                continue
            beat = song.beat(now) if cfg.rhythm.snap_to_beat else None
            if beat is not None and abs(beat - now) <= song.near and beat > now:
                now = beat
            a, b = r["start"], min(r["start"] + length, r["end"])
            why = f"event={r['event_id']} arc={arc} score={score:.3f}"
            if r["best_start"] is not None:
                x, y = r["best_start"], min(r["best_start"] + length, r["best_end"], r["end"])
                a, b = (x, y) if y - x >= lo else (a, b)
                if x != r["start"]:
                    why += f" window={x:.1f}-{r['best_end']:.1f}"
            out.append([r, now, now + (b - a), a, b, c.name, why, score])
            now = out[-1][2]
            gone.add(k)
            uses[r["source_id"]] = uses.get(r["source_id"], 0) + 1
            seen_sources.add(r["source_id"])
            seen_roles.add(role)
            spent[r["media_type"]] += b - a
            before = (r["source_id"], r["event_id"], role)

    def lay():
        t = 0.0
        for x in out:
            x[1], x[2], t = t, t + (x[2] - x[1]), t + (x[2] - x[1])
        return t

    floor = cfg.target_duration_sec * 0.95
    if now < floor:
        last = chapters[-1].name
        for score, r in sorted(((worth(r, last, now, song, template, kept), r) for r in rows), key=lambda x: -x[0]):
            if now >= floor:
                break
            length = max(min(r["end"] - r["start"], hi, floor - now), lo)
            if (r["source_id"], r["start"]) in gone or length > floor - now:
                continue
            b = min(r["start"] + length, r["end"])
            out.append([r, now, now + (b - r["start"]), r["start"], b, last, f"backfill score={score:.3f}", score])
            gone.add((r["source_id"], r["start"]))
            now = out[-1][2]
        if now < floor:
            for x in out:
                if now < floor and x[0]["media_type"] == "photo":
                    more = min(2.0, floor - now)
                    x[2], now = x[2] + more, now + more
            now = lay()
    if now > cfg.target_duration_sec * 1.05 and len(out) > 2:
        length = now
        while length > cfg.target_duration_sec * 1.05 and len(out) > 2:
            sums = {c.name: sum(x[2] - x[1] for x in out if x[5] == c.name) for c in chapters}
            spare = [(x[7], i) for i, x in enumerate(out) if sums[x[5]] - (x[2] - x[1]) >= cfg.target_duration_sec * next(c.ratio for c in chapters if c.name == x[5]) * templates.RETAIN.get(x[5], 0.4)]
            if not spare:
                break
            x = out.pop(min(spare)[1])
            length -= x[2] - x[1]
        lay()
    for name in dict.fromkeys(x[5] for x in out):
        own = [x for x in out if x[5] == name]
        if own[-1][0]["shot_role"] not in ("reaction", "detail"):
            swap = [x for x in own[:-1] if x[0]["shot_role"] in ("reaction", "detail")]
            if swap:
                for i in (0, 3, 4, 6, 7):
                    own[-1][i], swap[-1][i] = swap[-1][i], own[-1][i]
    return [(r["media_id"], a, b, i, o, c, why, s) for r, a, b, i, o, c, why, s in out]


def same_plan(spark, rows, cfg, m):
    want = {p: plain_plan(sorted(own, key=lambda r: r["input_idx"]), cfg, m) for p, own in rows.items()}
    got = {p: [] for p in rows}
    flat = [r for own in rows.values() for r in own]
    types = "project_id bigint, input_idx int, media_id bigint, source_id bigint, media_type string, width int, height int, start double, end double, sharpness double, exposure double, stability double, face_score double, motion_intensity double, overall double, emotion double, highlight_score double, shot_role string, event_id bigint, at bigint, hhmm string, best_start double, best_end double, preference double"
    names = [x.split()[0] for x in types.split(", ")]
    frame = spark.createDataFrame([tuple(r[n] for n in names) for r in flat], types)
    for r in planner.plan(frame, cfg, m).orderBy("project_id", "clip_idx").collect():
        got[r["project_id"]].append((r["media_id"], r["timeline_start"], r["timeline_end"], r["in_point"], r["out_point"], r["chapter"], r["selection_reason"], r["total_score"]))
    clips = 0
    for p, plan in want.items():
        assert [(x[0], x[5]) for x in got[p]] == [(x[0], x[5]) for x in plan], p
        for x, y in zip(got[p], plan, strict=True):
            assert x[1:5] == pytest.approx(y[1:5], abs=1e-9) and x[7] == pytest.approx(y[7], abs=1e-9) and x[6].split("score=")[0] == y[6].split("score=")[0]
        clips += len(plan)
    return clips


def made_up(rng, n, sources=None):
    rows = []
    for i in range(n):
        still, u = rng.random() < 0.3, rng.random
        length = 4.0 if still else round(rng.uniform(0.5, 8), 3)
        q = {"sharpness": u(), "exposure": u(), "stability": 1.0 if still else u(), "face_score": u(), "motion_intensity": 0.0 if still else u()}
        start = 0.0 if still else round(rng.uniform(0, 50), 3)
        best = None if rng.random() < 0.5 or still else round(start + length * 0.2, 3)
        event, minute = rng.randrange(-1, 9), rng.randrange(1440)
        rows.append({"project_id": 0, "input_idx": i, "media_id": i, "source_id": rng.randrange(sources or n), "media_type": "photo" if still else "video", "width": 1920, "height": rng.choice((1080, 2000)), "start": start, "end": start + length, **q,
            "overall": sum(v * 0.2 for v in q.values()), "emotion": (q["face_score"] + q["motion_intensity"]) / 2, "highlight_score": u(), "shot_role": rng.choice([*ROLES, ""]), "event_id": event, "at": minute, "hhmm": f"{minute // 60:02d}:{minute % 60:02d}",
            "best_start": best, "best_end": None if best is None else best + min(2.5, length * 0.6), "preference": rng.choice((0.0, 0.05, -0.1))})
    return rows


def test_plans_of_made_up_projects_are_those_of_a_plain_loop(spark):
    import dataclasses

    rng = random.Random(12)
    sizes = [(0, 1), (1, 1), (2, 1), (5, 2), (30, 4), (60, 60), (150, 20), (300, 40)]
    for k, cfg in enumerate((templates.PROFILES["growth"], templates.PROFILES["travel"], dataclasses.replace(templates.PROFILES["growth"], narrative_mode="hybrid", target_duration_sec=60), dataclasses.replace(templates.PROFILES["travel"], narrative_mode="energy_first", target_duration_sec=90))):
        rows = {p: [r | {"project_id": p} for r in made_up(rng, n, s)] for p, (n, s) in enumerate(sizes) if n}
        assert same_plan(spark, rows, cfg, templates.Music() if k == 3 else templates.TRACK) > 50


@pytest.mark.parametrize("name", ["growth", "travel"])
def test_registered_plans_are_those_of_a_plain_loop(spark, name):
    rows = {}
    for r in catalog.plan_input(spark, SF).collect():
        rows.setdefault(r["project_id"], []).append(r.asDict())
    assert same_plan(spark, rows, templates.PROFILES[name], templates.TRACK) > 100


def test_templates_of_the_caller(spark):
    from pyspark.sql import Column

    def still_first(chapter: str) -> Column:
        return F.when(F.col("media_type") == "photo", F.lit(1.0)).otherwise(F.lit(0.0))

    templates.register(templates.Template("stills", (templates.Chapter("all", 1.0, (0.0, 1.0)),), (0.0, 0.0, 0.0, 1.0, 0.0, 0.0), still_first))
    try:
        rows = catalog.plan_input(spark, SF).filter("project_id = 1")
        first = planner.plan(rows, templates.Project(project_type="stills")).orderBy("clip_idx").first()
        assert first["chapter"] == "all" and first["media_type"] == "photo"
    finally:
        del templates.TEMPLATES["stills"]


def plain_rules(clips):
    """Details of all rules, and the clips after them, over rows as dicts."""
    clips, found = [dict(c) for c in clips], []
    if len(clips) < 3:
        return clips, found
    held = ["media_id", "shot_role", "event_id", "source_id", "media_type", "motion_intensity", "face_score", "in_point", "out_point", "shot_start", "shot_end", "selection_reason", "total_score"]
    i = 0
    while i + 2 < len(clips):
        role = clips[i]["shot_role"]
        step = 1
        if role and all(c["shot_role"] == role for c in clips[i : i + 3]):
            found.append(("consecutive_same_role", i))
            others = [j for j in range(i + 3, min(i + 8, len(clips))) if clips[j]["shot_role"] != role and clips[j]["chapter"] == clips[i + 2]["chapter"]]
            if others:
                for h in held:
                    clips[i + 2][h], clips[others[0]][h] = clips[others[0]][h], clips[i + 2][h]
            else:
                step = 3
        i += step
    run = 0
    for i, c in enumerate(clips):
        run = run + 1 if c["motion_intensity"] > 0.6 or c["shot_role"] == "action" else 0
        if run == 3:
            found.append(("needs_breath", i))
            c["selection_reason"] += " [grammar:needs_breath]"
            run = 0
    for name in dict.fromkeys(c["chapter"] for c in clips):
        at = [i for i, c in enumerate(clips) if c["chapter"] == name]
        hops = [i for i in at if i and clips[i]["event_id"] != clips[i - 1]["event_id"]]
        length = clips[at[-1]]["timeline_end"] - clips[at[0]]["timeline_start"]
        if hops and length > 0 and len(hops) / length > 0.25:
            found.append(("cross_event_jump_rate", hops[0]))
    feel = lambda c: (c["face_score"] + c["motion_intensity"]) / 2
    later = []
    for i in range(1, len(clips)):
        a, b = clips[i - 1], clips[i]
        kind = None
        if a["chapter"] != b["chapter"] and a["transition_out"] == "cut":
            kind, sec, rule = ("cross_dissolve" if a["event_id"] == b["event_id"] else "fade"), 0.5, "chapter_transition"
            a["transition_out"], b["transition_in"] = (kind, kind) if kind != "fade" else ("fade_out", "fade_in")
            a["transition_duration"] = b["transition_duration"] = sec
            found.append((rule, i))
    for i in range(1, len(clips)):
        a, b = clips[i - 1], clips[i]
        if a["chapter"] != b["chapter"] or a["transition_out"] != "cut" or b["transition_in"] != "cut":
            continue
        if a["event_id"] == b["event_id"] >= 0 and abs(b["shot_start"] - a["shot_end"]) > 30:
            rule, pair, sec = "semantic_time_jump", ("cross_dissolve",) * 2, 0.5
        elif abs(feel(a) - feel(b)) > 0.5:
            rule, pair, sec = "semantic_emotion_contrast", ("fade_out", "fade_in"), 0.4
        elif a["media_type"] != b["media_type"]:
            rule, pair, sec = "semantic_media_switch", ("cross_dissolve",) * 2, 0.4
        else:
            continue
        a["transition_out"], b["transition_in"] = pair
        a["transition_duration"] = b["transition_duration"] = sec
        later.append((rule, i))
    return clips, found + later


def test_the_rules_are_those_of_a_plain_loop(spark):
    rows = catalog.planned(spark, SF, "growth").withColumns({"transition_out": F.when(F.col("clip_idx") % 7 == 0, "cut").otherwise(F.col("transition_out")), "transition_in": F.when(F.col("clip_idx") % 7 == 1, "cut").otherwise(F.col("transition_in")), "shot_start": F.col("shot_start") + F.col("media_id") % 9 * 10}).withColumn("shot_role", F.when(F.col("media_id") % 4 < 3, "action").otherwise(F.col("shot_role"))).cache()
    by = {}
    for r in rows.union(rows.filter("project_id = 1 AND clip_idx < 2").withColumn("project_id", F.lit(-5).cast("bigint"))).orderBy("project_id", "clip_idx").collect():
        by.setdefault(r["project_id"], []).append(r.asDict())
    done, report = grammar.apply(rows.union(rows.filter("project_id = 1 AND clip_idx < 2").withColumn("project_id", F.lit(-5).cast("bigint"))))
    told = {r["project_id"]: r for r in report.collect()}
    after = {}
    for r in done.orderBy("project_id", "clip_idx").collect():
        after.setdefault(r["project_id"], []).append(r.asDict())
    kinds = set()
    for p, clips in by.items():
        want, found = plain_rules(clips)
        assert [[c[k] for k in ("media_id", "transition_in", "transition_out", "transition_duration", "selection_reason")] for c in after[p]] == [[c[k] for k in ("media_id", "transition_in", "transition_out", "transition_duration", "selection_reason")] for c in want]
        assert sorted((x["rule"], x["clip_index"]) for x in told[p]["details"]) == sorted(found) and told[p]["total_violations"] == len(found)
        kinds |= {r for r, _ in found}
    assert len(kinds) >= 5 and told[-5]["total_violations"] == 0 == told[-5]["emotion_gradient_score"]


def test_shots_of_frames_are_those_of_a_plain_loop(spark):
    rng, rows, want = random.Random(5), [], []
    c = templates.ShotDetect()
    for m in range(12):
        n, hist = rng.choice((1, 3, 40, 400)), [1.0] * 4
        bounds, last = [0.0], None
        frames = []
        for f in range(n):
            if rng.random() < 0.05:
                hist = [rng.random() for _ in range(4)] if rng.random() < 0.9 else [0.0] * 4
            frames.append((m, f, f / 10, hist, rng.uniform(0, 20), rng.uniform(0, 60), n / 10))
        rows += frames
        for _, f, t, h, flow, luma, _ in frames[:: c.sample_interval]:
            if last is not None and t - bounds[-1] >= c.min_duration:
                top = math.sqrt(sum(h) * sum(last[0]))
                apart = math.sqrt(max(0.0, 1 - sum(math.sqrt(x * y) for x, y in zip(h, last[0], strict=True)) / top)) if top * top > 1.1920929e-07 else 1.0
                votes = (apart > c.histogram_threshold) + (flow > c.optical_flow_threshold) + (abs(luma - last[1]) > c.luminance_threshold)
                if apart > 1.5 * c.histogram_threshold or votes >= 2:
                    bounds.append(t)
            last = (h, luma)
        bounds.append(n / 10)
        split = [bounds[0]]
        for b in bounds[1:]:
            a, long = split[-1], b - split[-1]
            k = max(2, int(long / c.max_duration + 0.5)) if long > c.max_duration else 1
            split += [a + long / k * j for j in range(1, k)] + [b]
        if len(split) > 2:
            clean = split[:1]
            for b in split[1:-1]:
                if b - clean[-1] >= c.min_duration:
                    clean.append(b)
            if len(clean) == 1 and split[-1] - clean[0] < c.min_duration:
                clean = []
            split = [*clean, split[-1]]
        want += [(m, i, round(a, 9), round(b, 9)) for i, (a, b) in enumerate(zip(split, split[1:])) if b - a >= c.min_duration]
    frame = spark.createDataFrame(rows, "media_id bigint, frame_idx int, ts_sec double, hist array<double>, flow_mag double, luma_mean double, end_sec double")
    got = sequence.detect_shots(frame, ["media_id"], c).collect()
    assert sorted((r[0], r[1], round(r[2], 9), round(r[3], 9)) for r in got) == sorted(want) and len(want) > 40


def test_windows_are_those_of_a_plain_loop(spark):
    rng, shots, frames, want = random.Random(6), [], [], {}
    for i in range(60):
        start, long = round(rng.uniform(0, 5), 3), round(rng.choice((0.5, 1.6, 2.2, 4.17, 7.9)) + rng.random(), 3)
        kind = "photo" if i % 9 == 0 else "video"
        shots.append((i, start, start + long, kind, rng.random(), rng.random()))
        scores = {f: rng.randrange(5) / 5 for f in range(200) if rng.random() < 0.8 or i % 10 == 1} if i % 10 else {}
        frames += [(i, f, s) for f, s in scores.items()]
        dur = start + long - start
        if kind == "photo" or dur < 1.6:
            want[i] = (start, start + long, shots[-1][4] if kind == "photo" else shots[-1][5])
            continue
        size, best, at, k = max(min(2.5, dur * 0.6), 0.8), -1.0, 0.0, 0
        while k * 0.5 + size <= dur + 0.01:
            s = scores.get(int((start + k * 0.5 + size / 2) * 10))
            if s is not None and s > best:
                best, at = s, k * 0.5
            k += 1
        want[i] = (start + at, min(start + at + size, start + long), best) if best >= 0 else (start, start + long, shots[-1][5])
    got = sequence.best_window(spark.createDataFrame(shots, "media_id bigint, start double, end double, media_type string, highlight_score double, overall double"), spark.createDataFrame(frames, "media_id bigint, frame_idx bigint, frame_score double"), fps=10.0).collect()
    assert {r["media_id"]: (r["best_start"], r["best_end"], r["window_score"]) for r in got} == {i: pytest.approx(w) for i, w in want.items()}


def test_windows_are_joined_without_a_broadcast(spark):
    shots = spark.createDataFrame([(1, 0.0, 6.0, "video", 0.5, 0.5)], "media_id bigint, start double, end double, media_type string, highlight_score double, overall double")
    frames = spark.range(60).selectExpr("1L AS media_id", "id AS frame_idx", "id % 7 / 6D AS frame_score")
    plan = sequence.best_window(shots, frames, fps=10.0)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_sections_by_loudness_are_those_of_a_plain_loop(spark):
    rng, rows, want = random.Random(7), [], {}
    for track, n in enumerate((1, 9, 11, 13, 60, 200, 400)):
        loud = [rng.random() * (1.0 if i // 17 % 2 else 0.3) for i in range(n)]
        times = [i * 0.5 for i in range(n)]
        rows += [(track, i, t, v, n / 2) for i, (t, v) in enumerate(zip(times, loud, strict=True))]
        wide = min(50, n // 4)
        bounds = [0.0, n / 2]
        if n >= 10 and wide >= 3:
            smooth = [sum(loud[j] for j in range(i - wide // 2, i + (wide - 1) // 2 + 1) if 0 <= j < n) / wide for i in range(n)]
            change = [abs(b - a) for a, b in zip(smooth, smooth[1:])]
            bar = float(np.percentile(change, 85))
            peaks = [t for t, d in zip(times, change) if d > bar]
            if peaks:
                bounds = [0.0]
                for t in peaks:
                    if t - bounds[-1] >= 8:
                        bounds.append(t)
        want[track] = bounds
    rms = spark.createDataFrame(rows, "track bigint, frame int, t double, v double, dur double")
    got = {r["track"]: r["bounds"] for r in music.change_boundaries(rms, ["track"], "frame", "t", "v", "dur").collect()}
    assert got == want and any(len(b) > 2 for b in want.values())
    named = music.detect_sections(rms, ["track"], "frame", "t", "v", duration="dur").collect()
    assert {r["track"] for r in named} == set(want) and [r["label"] for r in named if r["track"] == 0] == ["verse"]
    points = spark.createDataFrame([(5, [3.0, 20.0, 22.0, 60.0])], "track bigint, points array<double>")
    cut = music.detect_sections(rms, ["track"], "frame", "t", "v", points, "dur").filter("track = 5").orderBy("idx").collect()
    assert [r["start"] for r in cut] == [0.0, 20.0, 60.0]


def test_changes_equal_but_for_rounding_are_equal(spark):
    """Three steady levels: all changes from one to another are the same, and none is above the bar by rounding alone."""
    loud = [(0.1, 0.5, 0.9)[i // 20 % 3] for i in range(600)]
    change = np.abs(np.diff(np.convolve(loud, np.ones(50) / 50, mode="same")))
    level = np.unique(np.round(change / change.max(), 9))
    bar = np.percentile(np.round(change / change.max(), 9), 85)
    bounds = [0.0]
    for i in np.flatnonzero(np.round(change / change.max(), 9) > np.round(bar, 9)):
        if i * 0.5 - bounds[-1] >= 8:
            bounds.append(i * 0.5)
    want = bounds
    for noise in (0.0, 1e-16, -1e-16):
        rows = [(1, i, i * 0.5, v + noise * (i % 7), 300.0) for i, v in enumerate(loud)]
        got = music.change_boundaries(spark.createDataFrame(rows, "track int, frame int, t double, v double, dur double"), ["track"], "frame", "t", "v", "dur").first()["bounds"]
        assert got == want and len(level) < 20


def test_merged_bounds_and_choruses(spark):
    for points in ([], [4.0], [0.0, 3.0, 6.0, 9.5, 12.0], [i * 6.5 for i in range(20)]):
        kept = [0.0]
        for p in points:
            if p - kept[-1] >= 6:
                kept.append(p)
        want = points if len(points) < 2 else [kept[int(i)] for i in np.linspace(0, len(kept) - 1, 9, dtype=int)] if len(kept) > 9 else kept
        assert spark.range(1).select(music.merge_boundaries(F.array(*map(F.lit, points)).cast("array<double>"), 6.0).alias("x")).first()["x"] == want
    got = catalog.QUERIES["chorus_repeat"](spark, SF).collect()
    vectors = {}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect():
        vectors.setdefault(r["label"], []).append(np.array(r["embedding"], float) + 0.25)
    want = []
    for track, vs in vectors.items():
        leaders, often = [], []
        for i in range((len(vs) + 11) // 12):
            own = vs[12 * i + 4 : 12 * i + 12]
            v = np.mean(own, axis=0) if own else np.zeros(64)
            v = v / (np.linalg.norm(v) or 1)
            g = next((k for k, x in enumerate(leaders) if float(x @ v) > 0.85), len(leaders))
            if g == len(leaders):
                leaders.append(v)
                often.append(0)
            want.append((track, i, g, often[g]))
            often[g] += 1
    assert sorted((r["track"], r["idx"], r["grp"], r["repeat_index"]) for r in got) == sorted(want)


def test_empty_sections_have_rows(spark):
    clips = catalog.clips(spark, SF).filter("project_id = 1")
    late = (templates.Section("intro", 0.0, 1.0, 0.1), templates.Section("chorus", 500.0, 600.0, 0.9), templates.Section("chorus", 600.0, 700.0, 0.8))
    rows = summary.section_stats(clips, late, F.col("t")).orderBy("section_idx").collect()
    assert [(r["label"], r["clip_count"]) for r in rows][1:] == [("chorus", 0), ("chorus", 0)] and summary.section_stats(clips, (), F.col("t")).count() == 0

"""The planner: a target-length sequence of clips for each project.

What a shot is worth is worked out as columns, for all shots at once: its base
score, its penalties, how it suits each chapter and each kind of section.
Choosing is sequential within a project (every choice changes what the next may
be), so it is a pass per project over those columns; projects run in parallel,
many in a task. A project's shots are a user's own material, thousands of rows,
never a corpus; one project can't be split.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.functions import scores as S
from spindle.functions.scores import ARC, ROLES
from spindle.operators import streams
from spindle.plans.templates import PROFILES, RETAIN, TEMPLATES, Music, Project, Section, Template

CLOSING = {"reaction", "detail"}
RANK = {role: k for k, role in enumerate(ROLES)}
#: Columns that the planner takes as arrays, not as lists.
ARRAYS = {"base", "penalty", "preference", "story", "section"}
SHOT = ["media_id", "source_id", "media_type", "event_id", "shot_role", "highlight_score", "sharpness", "exposure", "stability", "face_score", "motion_intensity"]
OUT = (
    "clip_idx int, media_id bigint, source_id bigint, media_type string, event_id bigint, shot_role string, highlight_score double, "
    "sharpness double, exposure double, stability double, face_score double, motion_intensity double, timeline_start double, timeline_end double, "
    "in_point double, out_point double, shot_start double, shot_end double, transition_in string, transition_out string, transition_duration double, "
    "chapter string, selection_reason string, total_score double"
)


class Track:
    """Lookups in a track's structure."""

    def __init__(self, music: Music, project: Project):
        self.music, self.project, self.beats = music, project, sorted(music.beats)

    def beat(self, t: float) -> float | None:
        """The nearest beat, the earlier of equals."""
        at = bisect_left(self.beats, t)
        near = self.beats[max(at - 1, 0) : at + 1]
        return min(near, key=lambda b: abs(b - t)) if near else None

    def fit(self, t: float) -> float:
        beat, near = self.beat(t), self.project.rhythm.tolerance_ms / 1000
        return 0.5 if beat is None else 1.0 if abs(beat - t) <= near else 0.7 if abs(beat - t) <= 3 * near else 0.3

    def snapped(self, t: float) -> float:
        """Forward to a beat within the tolerance, never back."""
        beat = self.beat(t) if self.project.rhythm.snap_to_beat else None
        return beat if beat is not None and t < beat <= t + self.project.rhythm.tolerance_ms / 1000 else t

    def label(self, t: float) -> str | None:
        return next((s.label for s in self.music.sections if s.start <= t < s.end), None)

    def energy(self, t: float) -> float:
        """Linear between the points of the curve, flat beyond its ends, 0.5 without any."""
        curve = self.music.curve
        if not curve:
            return 0.5
        at = bisect_left(curve, (t, -math.inf))
        if at == 0 or at == len(curve):
            return curve[min(at, len(curve) - 1)][1]
        (t0, e0), (t1, e1) = curve[at - 1 : at + 1]
        return e0 + (t - t0) / (t1 - t0) * (e1 - e0) if t1 > t0 else e0

    def longest(self, t: float) -> float:
        clip = self.project.clip_duration_sec
        return max(clip.min, min(clip.max * 1.2, clip.max * (1.2 - self.project.rhythm.energy_clip_factor * self.energy(t))))

    def loud(self, t: float) -> bool:
        return any(a <= t <= b for a, b in self.music.high)


@dataclass
class Clip:
    row: int
    start: float
    end: float
    in_point: float
    out_point: float
    chapter: str
    reason: str
    score: float

    @property
    def seconds(self) -> float:
        return self.end - self.start


class Planner:
    """One project's plan. ``s`` has columns by name, in input order; ``story`` and ``section`` are rows of fits by chapter and by label."""

    def __init__(self, s: dict[str, list], project: Project, template: Template, track: Track, labels: list[str]):
        self.s, self.project, self.track, self.n = s, project, track, len(s["event_id"])
        self.template = template
        self.places = {c.name: k for k, c in enumerate(self.template.chapters)} | {label: k for k, label in enumerate(labels)}
        self.base, self.penalty, self.preference, self.highlight = (np.array(s[c], float) for c in ("base", "penalty", "preference", "highlight_score"))
        self.story, self.section = (np.array(s[c], float).reshape(self.n, -1) for c in ("story", "section"))
        self.keys = list(zip(s["source_id"], s["start"], strict=True))
        kept = self.reserve()
        self.reserved = np.array([k in kept for k in self.keys], bool)
        self.by_event: dict[int, list[int]] = defaultdict(list)
        for i, e in enumerate(s["event_id"]):
            self.by_event[e].append(i)
        lit, tenth = self.highlight >= 0.5, self.highlight * 0.1
        more = np.where(self.reserved, -0.1, 0.0) if self.track.music.sections else 0.0
        self.lift = {True: np.where(lit, tenth + 0.25, 0.0), False: np.where(lit, tenth + more, 0.0)}
        self.clips: list[Clip] = []
        self.now, self.used, self.source_uses = 0.0, set(), Counter()

    def reserve(self) -> set[tuple]:
        """Shots kept in mind for choruses: about one highlight for three seconds, other events than earlier choruses' where there is a choice."""
        h, events = self.highlight, self.s["event_id"]
        pool = [int(i) for i in np.argsort(-h, kind="stable") if h[i] >= 0.3]
        taken: set[tuple] = set()
        seen: set[int] = set()
        fresh = pool  # shots of events that no chorus before has
        for section in (x for x in self.track.music.sections if x.label == "chorus"):
            wanted = max(2, int((section.end - section.start) / 3))
            picky = len(pool) > 2 * wanted
            own: list[int] = []
            for part in (fresh if picky else pool, pool):
                for i in part:
                    if len(own) >= wanted:
                        break
                    if self.keys[i] not in taken:
                        own.append(i)
                        taken.add(self.keys[i])
            new = {events[i] for i in own} - seen
            seen |= new
            fresh = [i for i in fresh if events[i] not in new] if new else fresh
        return taken

    def scores(self, chapter: str, t: float) -> np.ndarray:
        w, label = self.template.weights, self.track.label(t)
        fit = self.section[:, self.places[label]] if label in self.places else 0.5
        value = self.base + w[3] * self.story[:, self.places[chapter]] + w[4] * self.track.fit(t) + w[5] * fit
        return np.maximum(0.0, value + self.lift[label == "chorus"] + self.preference - self.penalty)

    def events(self) -> list[tuple[int, float]]:
        """(event, emotion) in narrative order."""
        s, per = self.s, []
        for event in sorted(self.by_event):
            own = self.by_event[event]
            timed = [(s["at"][i], s["hhmm"][i]) for i in own if s["hhmm"][i]]
            per.append([event, len(own), sum(s["overall"][i] for i in own) / len(own), sum(s["emotion"][i] for i in own) / len(own), min(timed)[1] if timed else "99:99"])
        if not per:
            return []
        n, q, e = (max(x[k] for x in per) or 1.0 for k in (1, 2, 3))
        per.sort(key=lambda x: -(x[2] / q * 0.4 + x[3] / e * 0.35 + min(x[1] / n, 1.0) * 0.25))
        per.sort(key=lambda x: x[3] if self.project.narrative_mode == "energy_first" else x[4])
        rows = [(x[0], x[3]) for x in per]
        if self.project.narrative_mode == "hybrid" and len(rows) >= 3:
            peak = rows.pop(max(range(len(rows)), key=lambda i: rows[i][1]))
            rows.insert(int(len(rows) * 0.6), peak)
        return rows

    def allocate(self) -> dict[str, list[int]]:
        """Events by chapter: those in its range of emotion in their order, then the nearest to its middle."""
        left, chapters = self.events(), self.template.chapters
        each = max(1, len(left) // len(chapters))
        out: dict[str, list[int]] = {}
        for c in chapters:
            middle = sum(c.emotion) / 2
            inside = lambda x: c.emotion[0] <= x[1] <= c.emotion[1]  # noqa: B023, E731
            fits = [x for x in left if inside(x)]
            near = sorted((x for x in left if not inside(x)), key=lambda x: abs(x[1] - middle)) if len(fits) < each else []
            out[c.name] = [i for i, _ in (fits + near)[:each]]
            taken = set(out[c.name])
            left = [x for x in left if x[0] not in taken]
        for event, emotion in left:
            out[min(chapters, key=lambda c: abs(emotion - sum(c.emotion) / 2)).name].append(event)
        return out

    def arcs(self) -> dict[int, list[int]]:
        """Rows of each event in the order of the arc, each role's best first."""
        overall, roles = self.s["overall"], self.s["shot_role"]
        rank = [RANK.get(r, RANK["detail"]) for r in roles]
        return {event: sorted(sorted(rows, key=lambda i: -overall[i]), key=rank.__getitem__) for event, rows in self.by_event.items()}

    def candidates(self, chapter: str, own: list[int], arcs: dict[int, list[int]]) -> list[tuple[float, int, bool]]:
        """(score, row, whether of the chapter's events), best first: its events in the order of the arc, then all other shots at 0.7."""
        mine = set(own)
        rows = [i for event in own for i in arcs.get(event, ())]
        n = len(rows)
        rows += [i for event, others in self.by_event.items() if event not in mine for i in others]
        scores = self.scores(chapter, self.now)[rows]
        scores[n:] *= 0.7
        values, falling = scores.tolist(), (-scores).tolist()
        return [(values[k], rows[k], k < n) for k in sorted(range(len(rows)), key=falling.__getitem__)]

    def fill(self, chapter, own: list[int], arcs: dict[int, list[int]]) -> None:
        cfg, div, s = self.project, self.project.diversity, self.s
        length, begin = cfg.target_duration_sec * chapter.ratio, self.now
        until = begin + length
        caps = {still: length * part / sum(cfg.video_photo_ratio) * 1.2 for still, part in zip((False, True), cfg.video_photo_ratio, strict=True)}
        spent, roles, sources = {False: 0.0, True: 0.0}, set(), set()
        last_source, last_event, last_role = None, -1, ""
        same_source = same_event = same_role = jumps = 0
        streak, shortest = 0.0, cfg.clip_duration_sec.min
        starts, ends, all_sources, all_events, all_roles, kinds, motions = (s[c] for c in ("start", "end", "source_id", "event_id", "shot_role", "media_type", "motion_intensity"))
        timed = not np.isnan(np.subtract(ends, starts)).any()  # a shot of unknown length fits whatever is left
        put = None  # what follows from the time is worked out after each clip
        for score, i, mine in self.candidates(chapter.name, own, arcs):
            if put != self.now:
                put, left, gone = self.now, until - self.now, self.now - begin
                if left <= 0 or (timed and left < shortest):
                    break
                most, loud = min(self.track.longest(put), left), self.track.loud(put)
                wanted = RANK[next((r for upto, r in ARC if gone / max(length, 0.1) <= upto), ROLES[-1])]
            if self.keys[i] in self.used:
                continue
            start, end, source, event, role = starts[i], ends[i], all_sources[i], all_events[i], all_roles[i] or "unknown"
            seconds = max(min(end - start, most), shortest)
            if seconds > left:
                continue
            # Runs are counted in this order and stay counted when a later check turns the shot away.
            if source == last_source:
                same_source += 1
                if same_source >= div.max_consecutive_same_source:
                    continue
                streak += seconds
                if streak > cfg.max_same_event_streak_sec:
                    continue
            else:
                same_source, streak = 0, seconds
            if event == last_event:
                same_event += 1
                if same_event >= div.max_consecutive_same_event:
                    continue
            else:
                same_event = 0
                jumps += last_event >= 0
            if role == last_role:
                same_role += 1
                if same_role >= div.max_consecutive_same_role:
                    continue
            else:
                same_role = 0
            if jumps and gone > 0 and jumps / max(gone, 1.0) > 0.25 and event != last_event:
                continue
            still = kinds[i] == "photo"
            if spent[still] >= caps[still] or (loud and not still and motions[i] < 0.3):
                continue
            arc = all_roles[i] or "detail"
            if mine and arc not in RANK:
                arc = "detail"
            value = score - (div.same_source_penalty * self.source_uses[source])
            if source in sources:
                value -= div.chapter_repeat_penalty
            if role == last_role:
                value -= div.same_angle_penalty
            if mine:
                value += 0.05
            rank = RANK.get(arc, len(RANK))
            value += 0.08 if rank == wanted else 0.03 if rank < wanted else 0.0
            if len(roles) < 2 and arc not in roles:
                value += 0.10
            if value < 0.05:
                continue
            self.now = self.track.snapped(self.now)
            a, b = start, min(start + seconds, end)
            best = (s["best_start"][i], s["best_end"][i])
            windowed = all(x is not None and not math.isnan(x) for x in best)
            if windowed:
                wb = min(best[0] + seconds, best[1], end)
                a, b = (best[0], wb) if wb - best[0] >= shortest else (a, b)
            reason = f"event={event} arc={arc} score={value:.3f}"
            if windowed and best[0] != start:
                reason += f" window={best[0]:.1f}-{best[1]:.1f}"
            self.put(i, a, b, chapter.name, reason, value)
            self.source_uses[source] += 1
            sources.add(source)
            roles.add(role)
            spent[still] += b - a
            last_source, last_event, last_role = source, event, role

    def put(self, row: int, a: float, b: float, chapter: str, reason: str, score: float) -> None:
        self.clips.append(Clip(row, self.now, self.now + (b - a), a, b, chapter, reason, float(score)))
        self.used.add(self.keys[row])
        self.now = self.clips[-1].end

    def flow(self) -> None:
        self.now = 0.0
        for c in self.clips:
            c.start, c.end, self.now = self.now, self.now + c.seconds, self.now + c.seconds

    def backfill(self) -> None:
        """Unused shots, then longer stills, up to 95 % of the target."""
        goal, clip, chapter = self.project.target_duration_sec * 0.95, self.project.clip_duration_sec, self.template.chapters[-1].name
        if self.now >= goal:
            return
        scores = self.scores(chapter, self.now)
        for i in np.argsort(-scores, kind="stable").tolist():
            left, start, end = goal - self.now, self.s["start"][i], self.s["end"][i]
            if left <= 0 or left < clip.min:
                break
            seconds = max(min(end - start, clip.max, left), clip.min)
            if self.keys[i] not in self.used and seconds <= left:
                self.put(i, start, min(start + seconds, end), chapter, f"backfill score={scores[i]:.3f}", scores[i])
        if self.now < goal:
            for c in self.clips:
                if self.now < goal and self.s["media_type"][c.row] == "photo":
                    more = min(2.0, goal - self.now)
                    c.end, self.now = c.end + more, self.now + more
            self.flow()

    def trim(self) -> None:
        """The weakest clips go while over 105 % of the target, as far as their chapters allow."""
        target = self.project.target_duration_sec
        length, held = self.now, Counter()
        if length <= target * 1.05 or len(self.clips) <= 2:
            return
        budget = {c.name: target * c.ratio for c in self.template.chapters}
        for c in self.clips:
            held[c.chapter] += c.seconds
        while length > target * 1.05 and len(self.clips) > 2:
            spare = [(c.score, n) for n, c in enumerate(self.clips) if held[c.chapter] - c.seconds >= budget.get(c.chapter, 0) * RETAIN.get(c.chapter, 0.40)]
            if not spare:
                break
            gone = self.clips.pop(min(spare)[1])
            held[gone.chapter] -= gone.seconds
            length -= gone.seconds
        self.flow()

    def close_chapters(self) -> None:
        """A chapter ends with a reaction or a detail, if it has one."""
        role = lambda n: self.s["shot_role"][self.clips[n].row] or ""
        places = defaultdict(list)
        for n, c in enumerate(self.clips):
            places[c.chapter].append(n)
        for own in places.values():
            better = next((n for n in reversed(own[:-1]) if role(n) in CLOSING), None)
            if role(own[-1]) not in CLOSING and better is not None:
                a, b = self.clips[own[-1]], self.clips[better]
                for name in ("row", "in_point", "out_point", "score", "reason"):
                    x, y = getattr(a, name), getattr(b, name)
                    setattr(a, name, y)
                    setattr(b, name, x)

    def plan(self) -> list[Clip]:
        own, arcs = self.allocate(), self.arcs()
        for chapter in self.template.chapters:
            self.fill(chapter, own[chapter.name], arcs)
        self.backfill()
        self.trim()
        self.close_chapters()
        return self.clips


def transitions(chapters: list[str]) -> list[tuple[str, str, float]]:
    """(in, out, seconds) of each clip: fades between chapters, from black at first and to black at last."""
    out, n = [], len(chapters)
    for i, c in enumerate(chapters):
        enters, leaves = i > 0 and chapters[i - 1] != c, i + 1 < n and chapters[i + 1] != c
        seconds = max(0.5 if enters or leaves else 0.0, 1.0 if i == 0 else 0.0, 1.5 if i == n - 1 else 0.0)
        out.append(("fade_from_black" if i == 0 else "fade_in" if enters else "cut", "fade_to_black" if i == n - 1 else "fade_out" if leaves else "cut", seconds))
    return out


def scored(shots: DataFrame, template: Template, labels: list[str]) -> DataFrame:
    """``shots`` with what the planner adds up: base, penalty, and story and section fits by chapter and by label."""
    wq, wf, wm = template.weights[:3]
    base = S.total(F.lit(wq) * ((S.q("sh") + S.q("ex") + S.q("st")) / 3.0), F.lit(wf) * S.q("f"), F.lit(wm) * S.q("m"))
    role = F.coalesce(F.col("shot_role"), F.lit(""))
    doubles = lambda values: F.array(*values).cast("array<double>")
    return shots.withColumn("shot_role", role).withColumns({
        "base": base,
        "penalty": S.penalties(),
        "story": doubles([S.story_of(template, c.name) for c in template.chapters]),
        "section": doubles([S.section_fit(F.lit(label), F.col("shot_role"), template) for label in labels]),
    })


def music_of(row: dict) -> Music:
    """A track's structure from a row of ``structure.track_structure``; what is null or left out is not known."""
    pairs = lambda name, *keys: tuple(tuple(x[k] for k in keys) for x in row.get(name) or ())
    return Music(tuple(row.get("beats") or ()), pairs("high", "start", "end"), tuple(Section(*x) for x in pairs("sections", "label", "start", "end", "energy")), pairs("curve", "t", "energy"))


def plan(shots: DataFrame, project: Project | str = "growth", music: Music = Music(), tracks: DataFrame | None = None) -> DataFrame:
    """Clips of every project. ``shots``: project_id, input_idx, media_id, source_id, media_type, width, height, start, end, the five
    metrics, overall, emotion, highlight_score, shot_role, event_id, at (time in microseconds), hhmm, best_start, best_end, preference.

    Rows without a project are in no plan. ``tracks`` has the track of each project: project_id, beats, sections (label, start, end, energy), high (start, end) and
    curve (t, energy), a row each; projects without one take ``music``. A shot is known by its source and start: of equal ones
    the first chosen is used. Partitions are sorted by project and read as streams, so a task holds a batch and one project's shots at a time.
    """
    project = PROFILES[project] if isinstance(project, str) else project
    template = TEMPLATES[project.template]
    bare = replace(template, story=None)  # its fits are columns already
    labels = sorted({x.label for x in music.sections} | (set(S.PREFERRED) if tracks is not None else set()))
    usual = Track(music, project)
    names = ["project_id", "input_idx", *SHOT, "start", "end", "overall", "emotion", "at", "hhmm", "best_start", "best_end", "preference", "base", "penalty", "story", "section"]
    may_lack = {"hhmm", "best_start", "best_end", "at"}
    structure = ["beats", "sections", "high", "curve"]

    def one(s: dict) -> dict[str, list] | None:
        """A project's clips; nothing for a track without shots."""
        own = [x for x in s.get("__track", ()) if x is not None]
        if own:
            kept = [i for i, x in enumerate(s["__track"]) if x is None]
            s = {c: v[kept] if isinstance(v, np.ndarray) else [v[i] for i in kept] for c, v in s.items()}
        rows = {c: v.tolist() if isinstance(v, np.ndarray) and c not in ARRAYS else v for c, v in s.items()}
        if not rows["media_id"]:
            return None
        s = {c: [None if x is None or x != x else x for x in v] if c in may_lack else v for c, v in rows.items()}
        clips = Planner(s, project, bare, Track(music_of(json.loads(own[0])), project) if own else usual, labels).plan()
        if not clips:
            return None
        out: dict[str, list] = {"clip_idx": list(range(len(clips)))}
        out |= {c: [s[c][x.row] for x in clips] for c in SHOT}
        out |= {"timeline_start": [c.start for c in clips], "timeline_end": [c.end for c in clips], "in_point": [c.in_point for c in clips], "out_point": [c.out_point for c in clips]}
        out |= {"shot_start": [s["start"][c.row] for c in clips], "shot_end": [s["end"][c.row] for c in clips]}
        edges = transitions([c.chapter for c in clips])
        out |= {name: [e[k] for e in edges] for k, name in enumerate(("transition_in", "transition_out", "transition_duration"))}
        return out | {"chapter": [c.chapter for c in clips], "selection_reason": [c.reason for c in clips], "total_score": [c.score for c in clips]}

    rows = scored(shots.filter("project_id IS NOT NULL"), template, labels).select(*names).withColumn("project_id", F.col("project_id").cast("bigint"))
    if tracks is not None:
        # A track's row comes before its project's shots; its whole numbers and lists are no nulls, which would make doubles and lists of lists of all.
        blank = [F.lit(0).cast(rows.schema[c].dataType).alias(c) for c in ("media_id", "source_id", "event_id", "at")]
        blank += [F.array_repeat(F.lit(0.0), n).alias(c) for c, n in (("story", len(template.chapters)), ("section", len(labels)))]
        first = F.lit(-1).cast(rows.schema["input_idx"].dataType).alias("input_idx")
        rows = rows.unionByName(tracks.select("project_id", first, *blank, F.to_json(F.struct(*structure)).alias("__track")), allowMissingColumns=True)
    return streams.per_key(rows, ["project_id"], ["input_idx"], one, OUT)

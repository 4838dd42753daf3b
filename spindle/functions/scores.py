"""Column builders: quality, roles, highlights, fits and music lookups.

All are expressions over columns of a shot (sharpness, exposure, stability,
face_score, motion_intensity, media_type, width, height, ...) and literals, so
they fold into whole-stage code. Sums keep their order, as doubles depend on it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindle.plans.templates import GROWTH, Chapter, Music, Rhythm, Section, Template

ROLES = ("establishing", "action", "reaction", "detail")
#: Shares of a chapter up to which, these included, each role is wanted; then the last (fixed values, added up from left to right).
ARC = ((0.15, "establishing"), (0.15 + 0.40, "action"), (0.15 + 0.40 + 0.30, "reaction"))
_NAMES = {"sh": "sharpness", "ex": "exposure", "st": "stability", "f": "face_score", "m": "motion_intensity", "h": "highlight_score"}


def q(short: str) -> Column:
    """A quality column by its short name: sh, ex, st, f, m or h."""
    return F.col(_NAMES[short])


def total(*terms: Column) -> Column:
    """A sum from left to right."""
    return reduce(lambda a, b: a + b, terms)


def weighted(**terms: float) -> Column:
    """Sum of weight times quality, in the order given."""
    return total(*[F.lit(float(w)) * q(k) for k, w in terms.items()])


def bonus(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


def photo() -> Column:
    return F.col("media_type") == "photo"


def overall() -> Column:
    """The five metrics in equal parts."""
    return total(*[q(k) * F.lit(0.2) for k in ("sh", "ex", "st", "f", "m")])


def emotion() -> Column:
    return (q("f") + q("m")) / F.lit(2.0)


def exposure_of(mean: Column) -> Column:
    """Score of a mean luminance of 0 to 255: dark and bright ends fall off."""
    return F.when(mean < 40, mean / 40.0).when(mean > 220, (F.lit(255.0) - mean) / 35.0).otherwise(F.lit(1.0) - F.abs(mean - 128.0) / 128.0 * 0.3)


def sharpness_of(laplacian_variance: Column) -> Column:
    return F.least(laplacian_variance / 500.0, F.lit(1.0))


def stability_of(flows: Column, frames: Column) -> Column:
    """From the mean motion of up to five pairs of frames: 1 for under two frames, 0.5 if no pair is usable."""
    usable = F.filter(flows, lambda x: x.isNotNull())
    mean = F.aggregate(usable, F.lit(0.0), lambda a, x: a + x) / F.size(usable)
    return F.when(frames < 2, F.lit(1.0)).when(F.size(usable) == 0, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - mean / 20.0))


def motion_of(diffs: Column, frames: Column) -> Column:
    mean = F.aggregate(diffs, F.lit(0.0), lambda a, x: a + x) / F.size(diffs)
    return F.when((frames < 2) | (F.size(diffs) == 0), F.lit(0.0)).otherwise(F.least(mean / 40.0, F.lit(1.0)))


def faces_of(area_ratio: Column, n: Column) -> Column:
    return F.when(n > 0, F.least(area_ratio * 10.0 + n * 0.1, F.lit(1.0))).otherwise(F.lit(0.0))


def frame_quality(sharp: Column, exposure: Column, n_faces: Column) -> Column:
    """Score of one frame in the search for a window."""
    return F.lit(0.35) * sharp + F.lit(0.25) * exposure + F.lit(0.4) * F.least(n_faces * 0.3, F.lit(1.0))


def role_scores() -> dict[str, Column]:
    wide = F.coalesce(F.col("width") > F.col("height"), F.lit(True))
    still = F.lit(1.0) - q("m")
    return {
        "establishing": total(bonus(wide, 0.3), bonus(q("f") < 0.2, 0.3), F.lit(0.2) * q("ex"), F.lit(0.2) * still, bonus(photo(), 0.1)),
        "action": total(F.lit(0.6) * q("m"), bonus(q("m") > 0.4, 0.2), F.lit(0.2) * (F.lit(1.0) - q("st"))),
        "reaction": total(F.lit(0.6) * q("f"), bonus(q("f") > 0.3, 0.2), F.lit(0.2) * still),
        "detail": total(F.lit(0.3) * q("sh"), F.lit(0.3) * still, F.lit(0.2) * (F.lit(1.0) - q("f")), F.lit(0.2) * q("st"), bonus(photo(), 0.15)),
    }


def first_best(scores: dict[str, Column]) -> Column:
    """The name of the highest score, the first of equals."""
    each = [F.struct(s.alias("score"), F.lit(-i).alias("turn"), F.lit(n).alias("name")) for i, (n, s) in enumerate(scores.items())]
    return F.array_max(F.array(*each))["name"]


def role() -> Column:
    return first_best(role_scores())


def highlight() -> Column:
    """Struct (score, reason): signals in turn, each named if it goes beyond those before."""
    signals = (
        ("interaction", q("f") >= 0.6, weighted(f=0.6, m=0.2, ex=0.2)),
        ("gaze", (q("f") >= 0.5) & (q("st") >= 0.7), weighted(f=0.5, st=0.3, sh=0.2)),
        ("action_moment", (q("m") >= 0.5) & (q("sh") >= 0.5), weighted(m=0.4, sh=0.3, ex=0.3)),
        ("posed_photo", photo() & (q("f") >= 0.3), weighted(f=0.5, sh=0.3, ex=0.2)),
    )
    best, named = F.lit(0.0), []
    for name, there, value in signals:
        value = F.when(there, value).otherwise(F.lit(0.0))
        named.append(F.when(value > best, F.lit(name)))
        best = F.greatest(best, value)
    return F.struct(F.least(best, F.lit(1.0)).alias("score"), F.concat_ws(", ", *named).alias("reason"))


def rejection_reason() -> Column:
    found = F.concat_ws("; ", F.when(overall() < 0.3, "low_overall_quality"), F.when(q("sh") < 0.2, "blurry"), F.when(q("ex") < 0.3, "poor_exposure"), F.when(q("st") < 0.3, "too_shaky"))
    return F.when(found == "", F.lit("outranked_by_better_candidates")).otherwise(found)


def story_fit(chapter: Column) -> Column:
    """How well a shot suits a chapter of either template; 0.5 for any other."""
    wide = F.col("width") > F.col("height")
    return (
        F.when(chapter == "opening", weighted(st=0.4, f=0.4, ex=0.2))
        .when(chapter == "learning", weighted(st=0.3, sh=0.3, m=0.2, f=0.2))
        .when(chapter == "highlights", weighted(f=0.5, m=0.3, sh=0.2))
        .when(chapter == "closing", F.when(photo(), F.lit(0.8)).otherwise(weighted(st=0.4, ex=0.3, f=0.3)))
        .when(chapter == "departure", weighted(st=0.3, m=0.3, ex=0.2, f=0.2))
        .when(chapter == "exploration", F.least(F.lit(1.0), weighted(sh=0.3, m=0.3, ex=0.2, st=0.2) + bonus(wide, 0.1)))
        .when(chapter == "interaction", weighted(f=0.5, st=0.3, sh=0.2))
        .when(chapter == "ending", F.when(photo(), F.lit(0.7)).otherwise(weighted(ex=0.4, st=0.3, sh=0.3)))
        .otherwise(F.lit(0.5))
    )


def story_of(template: Template, chapter: str) -> Column:
    """How well a shot suits a chapter: as the template says, else as the two given templates do."""
    return template.story(chapter) if template.story else story_fit(F.lit(chapter))


def penalties() -> Column:
    return total(bonus(q("ex") < 0.3, 0.2), bonus(q("sh") < 0.2, 0.15), bonus(q("st") < 0.3, 0.1))


#: Roles that a section of a track prefers (fixed values).
PREFERRED = {"intro": ("establishing", "detail"), "verse": ("establishing", "detail", "reaction"), "chorus": ("action", "reaction"), "bridge": ("reaction", "detail"), "outro": ("detail", "establishing", "reaction")}


def preferred_roles(template: Template | None = None) -> dict[str, tuple[str, ...]]:
    """The template's own preferences of sections, else PREFERRED."""
    return PREFERRED if template is None or template.preferred is None else dict(template.preferred)


def section_fit(label: Column, shot_role: Column, template: Template = GROWTH) -> Column:
    """How well a shot suits a section of the track; 0.5 without one. The template says which roles a section prefers and what others cost."""
    is_ = lambda *names: shot_role.isin(*names)
    value = (
        F.when(label == "chorus", total(F.lit(0.3) * q("m"), F.lit(0.4) * q("h"), F.lit(0.1) * (F.lit(1.0) - q("st")), F.when(is_("action"), F.lit(0.35)).when(is_("reaction") & (q("h") >= 0.5), F.lit(0.2)).otherwise(F.lit(0.0)), bonus(q("h") >= 0.6, 0.15)))
        .when(label == "verse", total(weighted(st=0.3, sh=0.2, ex=0.1), F.when(is_("establishing", "detail"), F.lit(0.3)).when(is_("reaction"), F.lit(0.15)).otherwise(F.lit(0.0)), bonus(q("m") > 0.7, -0.1)))
        .when(label == "intro", weighted(st=0.3, ex=0.2) + F.when(is_("establishing"), F.lit(0.4)).when(is_("detail"), F.lit(0.3)).otherwise(F.lit(0.0)))
        .when(label == "outro", total(weighted(st=0.3, ex=0.2), bonus(photo(), 0.3), bonus(is_("detail", "establishing"), 0.25)))
        .when(label == "bridge", weighted(st=0.2, sh=0.2) + F.when(is_("reaction"), F.lit(0.3)).when(is_("detail"), F.lit(0.2)).otherwise(F.lit(0.0)))
    )
    liked = reduce(lambda a, b: a | b, [(label == k) & is_(*v) for k, v in preferred_roles(template).items()], F.lit(False))
    value = value - F.when((shot_role != "") & ~liked, F.lit(template.mismatch)).otherwise(F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), F.lit(0.5))


def around(points: Sequence[float], t: Column) -> Column:
    """The last of sorted points below ``t`` and the next one, found by halving: one or two (distance, point)."""
    at, n = F.lit(sorted(map(float, points))), len(points)

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        lower = F.get(at, mid) < t
        return F.when(s["lo"] < s["hi"], F.struct(F.when(lower, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(lower, s["hi"]).otherwise(mid).alias("hi"))).otherwise(s)

    below = F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), halve, lambda s: s["lo"])
    return F.transform(F.slice(at, F.greatest(below, F.lit(1)), F.lit(2)), lambda p: F.struct(F.abs(p - t).alias("d"), p.alias("p")))


def distance_to(points: Sequence[float], t: Column) -> Column:
    """Least distance to sorted points; null without any."""
    return F.array_min(around(points, t))["d"] if points else F.lit(None).cast("double")


def nearest(points: Sequence[float], t: Column) -> Column:
    """The nearest point, the first of equals."""
    return F.array_min(around(points, t))["p"] if points else F.lit(None).cast("double")


def rhythm_fit(music: Music, t: Column, rhythm: Rhythm = Rhythm()) -> Column:
    if not music.beats:
        return F.lit(0.5)
    gap, near = distance_to(music.beats, t), rhythm.tolerance_ms / 1000
    return F.when(gap <= near, F.lit(1.0)).when(gap <= near * 3, F.lit(0.7)).otherwise(F.lit(0.3))


def snap(music: Music, t: Column, rhythm: Rhythm = Rhythm()) -> Column:
    """The nearest beat if within the tolerance, else ``t``."""
    if not (rhythm.snap_to_beat and music.beats):
        return t
    beat = nearest(music.beats, t)
    return F.when(F.abs(beat - t) <= rhythm.tolerance_ms / 1000, beat).otherwise(t)


def section_at(sections: Sequence[Section], t: Column) -> Column:
    """Label of the first section with start <= t < end; null outside."""
    found = F.lit(None).cast("string")
    for s in reversed(sections):
        found = F.when((t >= s.start) & (t < s.end), F.lit(s.label)).otherwise(found)
    return found


def energy_at(curve: Sequence[tuple[float, float]], t: Column) -> Column:
    """Linear between the points of the curve, flat beyond its ends, 0.5 without any."""
    if not curve:
        return F.lit(0.5)
    found = F.lit(float(curve[-1][1]))
    for (t0, e0), (t1, e1) in reversed(list(zip(curve, curve[1:], strict=False))):
        found = F.when(t <= t1, F.lit(e0) + (F.lit(e1) - F.lit(e0)) * ((t - t0) / F.lit(t1 - t0)) if t1 > t0 else F.lit(e0)).otherwise(found)
    return F.when(t <= curve[0][0], F.lit(float(curve[0][1]))).otherwise(found)


def clip_duration(energy: Column, low: float, high: float, factor: float) -> Column:
    """Shorter where the track has more energy, within low and 1.2 times high."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(high * 1.2), F.lit(float(high)) * (F.lit(1.2) - F.lit(factor) * energy)))


def high_energy(ranges: Sequence[tuple[float, float]], t: Column) -> Column:
    """Within a range, both ends included."""
    return reduce(lambda a, b: a | b, [(t >= a) & (t <= b) for a, b in ranges], F.lit(False))


def shot_score(template: Template, chapter: Column, label: Column, rhythm: Column, preference: Column | None = None, reserved: Column | None = None, sections: bool = True) -> Column:
    """The planner's score of a shot in a chapter at a place of the track, 0 at least."""
    wq, wf, wm, ws, wr, wx = template.weights
    base = total(
        F.lit(wq) * ((q("sh") + q("ex") + q("st")) / 3.0), F.lit(wf) * q("f"), F.lit(wm) * q("m"),
        F.lit(ws) * story_fit(chapter), F.lit(wr) * rhythm, F.lit(wx) * section_fit(label, F.col("shot_role"), template),
    )
    chorus = F.coalesce(label == "chorus", F.lit(False))
    lift = F.lit(0.1) * q("h")
    if sections:
        lift = lift + F.when(chorus, F.lit(0.25)).when(F.lit(False) if reserved is None else reserved, F.lit(-0.1)).otherwise(F.lit(0.0))
    base = base + F.when(q("h") >= 0.5, lift).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), (base if preference is None else base + preference) - penalties())


def arc_role(progress: Column) -> Column:
    """The role wanted at a point of a chapter."""
    wanted = F.lit(ROLES[-1])
    for upto, name in reversed(ARC):
        wanted = F.when(progress <= upto, name).otherwise(wanted)
    return wanted


def frames_of(seconds: Column, fps: int = 30) -> Column:
    """Frames, halves to the even one."""
    return F.bround(seconds * fps).cast("bigint")


def fixed(value: Column, places: int) -> Column:
    """A number with so many decimals, of two equally near ones the even one."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * places if places else "0"))


def effect_name(transition: Column) -> Column:
    """The editor's name of a transition; a plain cut has none."""
    return F.when(transition.isin("fade_from_black", "fade_to_black"), "Dip to Black").when(transition != "cut", "Cross Dissolve")


def chapter_at(template: Template, share: Column) -> Column:
    """The chapter in which a share (0 to 1) of the target falls."""
    found, upto, bounds = None, 0.0, []
    for c in template.chapters[:-1]:
        upto += c.ratio
        bounds.append((upto, c.name))
    for bound, name in bounds:
        found = F.when(share < bound, name) if found is None else found.when(share < bound, name)
    return found.otherwise(template.chapters[-1].name)


def in_range(chapter: Chapter, value: Column) -> Column:
    return value.between(*chapter.emotion)


#: Range of zoom, and of the pan to either side as a share of the frame (fixed values).
ZOOM, PAN = (1.0, 1.15), 0.05


def pan_zoom(seed: int) -> Column:
    """Struct of a random pan and zoom for a still, in or out with equal chances, from a seed and the row's place."""
    between = lambda i, a, b: F.lit(a) + F.rand(seed + i) * (b - a)
    inward, far = F.rand(seed) > 0.5, F.lit(ZOOM[0]) + between(1, 0.05, ZOOM[1] - ZOOM[0])
    drawn = F.struct(inward.alias("i"), far.alias("far"), *[between(2 + k, -PAN, PAN).alias(n) for k, n in enumerate(("start_x", "start_y", "end_x", "end_y"))])
    # Drawn once: each mention of rand would be another draw.
    return F.transform(F.array(drawn), lambda d: F.struct(
        F.when(d["i"], F.lit(ZOOM[0])).otherwise(d["far"]).alias("start_zoom"), F.when(d["i"], d["far"]).otherwise(F.lit(ZOOM[0])).alias("end_zoom"),
        *[d[n].alias(n) for n in ("start_x", "start_y", "end_x", "end_y")],
    ))[0]


def pan_zoom_filter(motion: Column, duration: Column, width: int = 1920, height: int = 1080, fps: int = 30) -> Column:
    """The renderer's filter of a pan and zoom (a struct of pan_zoom) over ``duration`` seconds, as text."""
    frames = (duration * fps).cast("bigint").cast("string")
    text = lambda c: F.regexp_replace(c.cast("string"), "E-0?", "e-")

    def moving(a: Column, b: Column) -> Column:
        return F.concat(F.lit("'if(eq(on,1),"), a, F.lit(","), a, F.lit("+(("), b, F.lit("-"), a, F.lit(")/"), frames, F.lit(")*on)'"))

    def offset(size: int, shift: str, zoom: str) -> Column:
        return (F.lit(size) * (F.lit(0.5) + motion[shift]) - F.lit(size) / (F.lit(2.0) * motion[zoom])).cast("bigint").cast("string")

    x = moving(offset(width, "start_x", "start_zoom"), offset(width, "end_x", "end_zoom"))
    y = moving(offset(height, "start_y", "start_zoom"), offset(height, "end_y", "end_zoom"))
    return F.concat(F.lit("zoompan=z="), moving(text(motion["start_zoom"]), text(motion["end_zoom"])), F.lit(":x="), x, F.lit(":y="), y, F.lit(":d="), frames, F.lit(f":s={width}x{height}:fps={fps}"))

"""Spans of pattern matches as native columns.

Spark has no function for the positions of all matches. ``split`` and
``regexp_extract_all`` walk the same leftmost, non-overlapping matches, so the
lengths of the pieces between them and of the matches add up to positions, in
code points. All patterns given here must match at least one character.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "array<struct<start:bigint,end:bigint,text:string,part:string,before:string,after:string>>"
SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double,base:boolean,text:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once, also where a lambda within ``body`` uses it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The results of ``op`` over the first, the first two, ... of an array of longs.

    A fold that adds to an array copies it at every step, so the array is cut
    into about as many parts as each has values: n values cost n ** 1.5 steps.
    """

    def fold(part: Column) -> Column:
        step = lambda done, v: F.concat(done, F.array(F.when(F.size(done) == 0, v).otherwise(op(F.element_at(done, -1), v))))
        return F.aggregate(part, F.array().cast("array<bigint>"), step)

    def cut(values: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))
        at = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), width)
        return let(F.transform(at, lambda i: fold(F.slice(values, i, width))), join)

    def join(parts: Column) -> Column:
        return let(fold(F.transform(parts, lambda p: F.element_at(p, -1))), lambda ends: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda v: op(F.get(ends, i - 1), v))))))

    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(let(values, cut))


def find_all(text: Column, pattern: str, group: int = 0, needs: str | None = None, around: int = 0) -> Column:
    """All matches as structs (start, end, text, part, before, after).

    ``part`` is the given group; ``before`` and ``after`` are the ``around``
    characters beside the match, or fewer: no more than to the far end of the
    match next to it. ``needs`` is a string that every match contains; texts
    without it are not searched. A null text has no matches.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.array().cast("array<string>")
    blank = F.lit("")

    def located(x: Column) -> Column:
        sizes = F.zip_with(x["hits"], F.slice(x["gaps"], 1, F.size(x["hits"])), lambda m, g: (F.length(m) + F.length(g)).cast("bigint"))
        return F.transform(running(sizes, lambda a, b: a + b), lambda end, i: found(x, end, i))

    def found(x: Column, end: Column, i: Column) -> Column:
        own = F.get(x["hits"], i)
        before = after = blank
        if around:
            before = F.right(F.concat(F.when(i > 0, F.get(x["hits"], i - 1)).otherwise(blank), F.get(x["gaps"], i)), F.lit(around))
            after = F.left(F.concat(F.coalesce(F.get(x["gaps"], i + 1), blank), F.coalesce(F.get(x["hits"], i + 1), blank)), F.lit(around))
        part = F.get(x["parts"], i) if group else own
        return F.struct((end - F.length(own)).alias("start"), end.alias("end"), own.alias("text"), part.alias("part"), before.alias("before"), after.alias("after"))

    there = text.rlike(pattern)
    if needs is not None:
        there = text.contains(needs) & there
    every = F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps"), parts.alias("parts"))
    return F.when(there, let(every, located)).otherwise(F.array().cast(FOUND))


def span(found: Column, rank: int, kind: str, score: Column, base: bool) -> Column:
    """One span struct of the order by start, then kind."""
    return F.struct(
        found["start"].alias("start"), F.lit(rank).alias("rank"), found["end"].alias("end"), F.lit(kind).alias("kind"),
        score.cast("double").alias("score"), F.lit(base).alias("base"), found["text"].alias("text"),
    )


def together(fixed: Column, more: Column) -> Column:
    """Both in the order of start, then kind; of ``more`` those that overlap none of ``fixed``.

    The fixed spans' ends are taken by halves: a span of ``more`` meets none of
    them if none that begins before its end ends after its start.
    """
    begins = F.array_sort(F.transform(fixed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    reach = lambda begins: running(F.transform(begins, lambda s: s["end"]), F.greatest)

    def free(s: Column, begins: Column, reach: Column) -> Column:
        def halve(r: Column, _: Column) -> Column:
            mid = F.shiftright(r["a"] + r["b"], 1)
            low = F.get(begins, mid)["start"] < s["end"]
            return F.when(r["a"] >= r["b"], r).otherwise(F.struct(F.when(low, mid + 1).otherwise(r["a"]).alias("a"), F.when(low, r["b"]).otherwise(mid).alias("b")))

        # Starts are sorted: how many are before the end is found by halving.
        n = F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.struct(F.lit(0).alias("a"), F.size(begins).alias("b")), halve, lambda r: r["a"])
        return F.coalesce(F.get(reach, n - 1) <= s["start"], F.lit(True))

    none = F.array().cast(SPANS)
    alone = let(begins, lambda b: let(reach(b), lambda r: F.filter(more, lambda s: free(s, b, r))))
    kept = F.when(F.size(more) == 0, none).when(F.size(fixed) == 0, more).otherwise(alone)
    return F.when((F.size(fixed) == 0) & (F.size(more) == 0), none).otherwise(F.array_sort(F.concat(fixed, kept)))


def pieces(text: Column, spans: Column, shown: Callable[[Column], Column]) -> Column:
    """``text`` with each run of overlapping spans (sorted by start) replaced by ``shown`` of its first.

    Taking a part of a string counts its characters from the left, so the text is
    cut at every so-manieth span first, and the parts are cut on.
    """
    cut = lambda t, a, b: F.substring(t, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

    def joined(reach: Column) -> Column:
        n = F.size(spans)
        width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
        upto = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0).cast("bigint"))

        def part(first: Column) -> Column:
            begin, end = upto(first), F.get(reach, F.least(first + width, n) - 1)

            def one(own: Column, s: Column, i: Column) -> Column:
                before = upto(first + i)
                return F.when(s["start"] >= before, F.concat(cut(own, before - begin, s["start"] - begin), shown(s))).otherwise(F.lit(""))

            return let(cut(text, begin, end), lambda own: F.array_join(F.transform(F.slice(spans, first + 1, width), lambda s, i: one(own, s, i)), ""))

        rest = F.substring(text, (F.element_at(reach, -1) + 1).cast("int"), F.lit(2**31 - 1))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), n - 1, width), part), ""), rest)

    return F.when(F.size(spans) == 0, text).otherwise(let(running(F.transform(spans, lambda s: s["end"]), F.greatest), joined))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")


def scores(spans: Column) -> Column:
    """The score of each span with two decimals, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.format_string("%.2f", s["score"])))


def digest_columns(spans: Column, kinds: Sequence[str]) -> list[Column]:
    """``n_<kind>`` and the digest of the base spans, the list of all spans and that of their scores."""
    counts = [count_of(spans, k).alias(f"n_{k}") for k in kinds]
    return [*counts, F.sha2(listed(base_only(spans)), 256).alias("base_sha256"), listed(spans).alias("spans"), scores(spans).alias("scores")]

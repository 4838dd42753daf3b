"""Timestamps, centroid clustering and suffix-array dedup against plain versions."""

import hashlib
import random
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindle.llm import bwt, centroids, cover_tree, suffix_dedup, timestamps, topk

# Timestamps.
DATE = re.compile(r"(?P<y>20[0-9]{2})-(?P<m>[0-9]{2})-(?P<d>[0-9]{2})|(?P<y2>20[0-9]{2})(?P<m2>[0-9]{2})(?P<d2>[0-9]{2})|(?P<d3>[0-9]{2})\.(?P<m3>[0-9]{2})\.(?P<y3>20[0-9]{2})|(?P<d4>[0-9]{2}) (?P<b>[A-Z][a-z]{2}) (?P<y4>20[0-9]{2})|(?P<s1>[0-9]{2})/(?P<s2>[0-9]{2})/(?P<y5>20[0-9]{2})")
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
US, EPOCH = timedelta(microseconds=1), datetime(1970, 1, 1)


def read(raw):
    """(kind, value, offset minutes or None): epoch, plain (a wall time), slashed (a list of wall times by order) or None."""
    if raw is None:
        return None
    t = raw.strip(" \t\n\x0b\x0c\r")
    if re.fullmatch("[0-9]{10}", t):
        return "epoch", int(t) * 10**6, None
    if re.fullmatch("[0-9]{13}", t):
        return "epoch", int(t) * 1000, None
    m = DATE.match(t)
    rest = m and re.fullmatch(r"(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?: ?([AP]M))?(?: ?(Z|([+-])([0-9]{2}):?([0-9]{2})))?)?", t[m.end() :])
    if not rest:
        return None
    h, mi, s = (int(x or 0) for x in rest.groups()[:3])
    if rest[4]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if rest[4] == "PM" else 0)
    off = None
    if rest[5]:
        off = 0 if rest[5] == "Z" else (-1 if rest[6] == "-" else 1) * (int(rest[7]) * 60 + int(rest[8]))
        if rest[5] != "Z" and (int(rest[7]) > 14 or int(rest[8]) > 59):
            return None

    def wall(y, mo, d):
        try:
            return datetime(int(y), int(mo), int(d), h, mi, s)
        except ValueError:
            return None

    g = m.groupdict()
    if g["s1"]:
        both = [wall(g["y5"], g["s2"], g["s1"]), wall(g["y5"], g["s1"], g["s2"])]
        return ("slashed", both, off) if any(both) else None
    if g["b"]:
        if g["b"] not in MONTHS:
            return None
        one = wall(g["y4"], MONTHS.index(g["b"]) + 1, g["d4"])
    else:
        one = next(wall(g[f"y{k}"], g[f"m{k}"], g[f"d{k}"]) for k in ("", "2", "3") if g[f"y{k}"])
    return ("plain", one, off) if one else None


def in_zone(wall, zone):
    """UTC microseconds and whether the zone skips or repeats the time; the offset after the change then."""
    z = ZoneInfo(zone)
    fits = {o for o in (wall.replace(tzinfo=z, fold=f).utcoffset() for f in (0, 1)) if (wall - o).replace(tzinfo=timezone.utc).astimezone(z).replace(tzinfo=None) == wall}
    later = (wall + timedelta(days=1)).replace(tzinfo=z).utcoffset()
    odd = len(fits) != 1
    return (wall - (later if odd else fits.pop()) - EPOCH) // US, odd


def plain_stamps(rows):
    votes, out = {}, []
    for _, source, _, raw in rows:
        r = read(raw)
        if r and r[0] == "slashed" and not all(r[1]):
            v = votes.setdefault(source, [0, 0])
            v[0 if r[1][0] else 1] += 1
    for i, source, zone, raw in rows:
        r = read(raw)
        if r is None:
            out.append((i, None, "bad", False))
            continue
        kind, value, off = r
        if kind == "epoch":
            out.append((i, value, "epoch", False))
            continue
        rule = "plain"
        if kind == "slashed":
            day, month = value
            if day and month and day != month:
                v = votes.get(source, [0, 0])
                rule, value = ("votes", month if v[1] > v[0] else day) if v[0] != v[1] else ("default", day)
            else:
                value = day or month
        if off is not None:
            out.append((i, (value - EPOCH) // US - off * 60 * 10**6, rule, rule != "plain"))
        elif zone not in ("UTC", "Europe/Berlin", "America/New_York", "Asia/Kolkata", "Pacific/Apia", "Australia/Lord_Howe"):
            out.append((i, None, "bad", False))
        else:
            us, odd = in_zone(value, zone)
            out.append((i, us, rule, odd or rule != "plain"))
    return out


ODD = [
    None, "", "  ", "n/a", "2024", "2024-02-30", "2024-02-29", "2023-02-29", "2024-13-01", "2024-01-01T24:00", "2024-01-01 12:60", "2024-01-01 12:00:60", "2024-01-01 13:00 PM", "2024-01-01 00:30 AM", "2024-01-01 12:30AM", "2024-01-01 12:30:09 PM Z",
    "2024-01-01T10:00+14:59", "2024-01-01T10:00+15:00", "2024-01-01T10:00-0060", "2024-01-01T10:00 -0059", "2024-01-01t10:00", "2024-01-01  10:00", "2024-01-01T10:00 z", "20240229", "20240230 01:02", "\t\x0b20240101\r\n", " 20240101", "20240101\u0085",
    "1704067200", "1704067200123", "17040672001", "9999999999", "0000000000", "١٧٠٤٠٦٧٢٠٠", "31.12.2024T23:59:59", "31/12/2024", "12/31/2024", "32/01/2024", "13/13/2024", "05/05/2024 10:00", "29/02/2023", "02/29/2024", "01/02/2024", "03/04/2024 11:00 PM", "01 Jan 2024", "01 jan 2024", "31 Apr 2024", "1 Jan 2024", "01 Foo 2024",
    "2024-03-31 02:30", "2024-10-27 02:30", "2024-03-10 02:15:30", "2024-11-03 01:15", "2011-12-30 05:00", "2024-04-07 01:45", "2024-10-06 02:10", "1999-01-01", "2099-12-31 23:59:59", "2000-01-01", "x" * 100_000, " " * 100_000 + "20240101", "2" * 50_000,
]


def test_stamps_are_those_of_a_plain_loop(spark):
    rng = random.Random(5)
    zones = ["UTC", "Europe/Berlin", "America/New_York", "Asia/Kolkata", "Pacific/Apia", "Australia/Lord_Howe", "europe/berlin", "Nowhere", "", None]
    rows = [(i, rng.choice(["hot", "hot", "a", "b", "c", None]), zones[i % len(zones)], raw) for i, raw in enumerate(ODD * 12)]
    for i in range(1500):
        d = f"{rng.randrange(0, 34):02d}{rng.choice('/////.- ')}{rng.randrange(0, 14):02d}/2024"
        rows.append((10_000 + i, rng.choice(["hot", "a", "b", "c", "d", None]), rng.choice(zones), f"{d}{rng.choice(['', ' 01:30', 'T02:30', ' 02:10 AM', ' 10:00 +05:30'])}"))
    rows += [(None, "a", "UTC", "01/02/2024")] * 3 + rows[:5] + [(i, "tie", "Europe/Berlin", raw) for i, raw in enumerate(["13/01/2024", "01/13/2024", "01/02/2024", "04/03/2024 02:30 Z"])]
    frame = spark.createDataFrame(rows, "stamp_id bigint, source string, zone string, raw string")
    for tz in ("UTC", "America/New_York"):
        before = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", tz)
        try:
            got = timestamps.report(frame).collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_stamps(rows)))
    assert {r[2] for r in plain_stamps(rows)} == {"bad", "epoch", "plain", "votes", "default"}


def test_stamps_keep_other_columns(spark):
    frame = spark.createDataFrame([(1, "s", "UTC", "20240101", "mine", "__p", 7)], "stamp_id int, source string, zone string, raw string, rule string, __p string, __text int")
    r = timestamps.normalized(frame).first()
    assert (r["rule_input"], r["__p"], r["__text"], r["rule"], r["utc_us"]) == ("mine", "__p", 7, "plain", 1_704_067_200_000_000)
    assert timestamps.report(frame.limit(0)).count() == 0


# Centroid clustering.
def plain_lloyd(rows, k=16, rounds=3, dim=64):
    """Clusters with Python's integers; rows are (vec_id, vector)."""
    kept = [(i, topk.whole(np.array(v, float), 64)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in named[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((apart(v, x), j) for j, x in enumerate(c))
    if not c:
        return []
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if members:
                c[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    most = 2**63 - 1
    inertia = {j: min(most, sum(min(most, d) for _, d, o in found if o == j)) for j in range(len(c))}
    total = min(most, sum(min(most, d) for _, d, _ in found))
    return [(i, j, min(most, d), inertia[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found]


@pytest.mark.parametrize("kind", ["usual", "odd", "few", "giant"])
def test_clusters_are_those_of_a_plain_loop(spark, kind):
    rng = np.random.default_rng(7)
    vectors = [(i, v.tolist()) for i, v in enumerate(np.vstack([rng.normal(size=(120, 64)) * 0.1 + c for c in rng.normal(size=(6, 64))]))]
    rows = vectors[:8] if kind == "few" else vectors
    if kind == "odd":
        rows = rows[:300] + [(5000 + i, vectors[3][1]) for i in range(150)] + [(None, vectors[9][1]), (None, None), (9001, None), (9002, [1.0]), (9003, [None] * 64), (9004, [float("nan")] * 64), (9005, [float("inf")] * 64), (9006, []), (9007, [0.0] * 64), (9008, [-0.0] * 64)] + vectors[:20]
    if kind == "giant":
        rows = rows[:60] + [(7000 + i, [x * 10.0**e for x in vectors[i][1]]) for i, e in enumerate((3, 6, 9, 20, 100, 200, 300))]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, cluster string").repartition(5)
    got = [tuple(r) for r in centroids.report(frame).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_lloyd(rows))) and got


def test_no_vectors_no_clusters(spark):
    assert centroids.report(spark.createDataFrame([], "vec_id int, embedding array<float>")).count() == 0
    assert centroids.report(spark.createDataFrame([(None, [0.0] * 64)], "vec_id int, embedding array<float>")).count() == 0


def test_a_cover_tree_covers_and_separates():
    rng = np.random.default_rng(1)
    v = np.floor(np.vstack([rng.normal(size=(80, 5)) * 9 + c for c in rng.normal(size=(5, 5)) * 400]))
    v = np.vstack([v, v[:30]])
    tree = cover_tree.build(v)
    assert sorted(tree.order.tolist()) == list(range(len(v)))
    for node in range(len(tree.pivot)):
        own = v[tree.order[tree.lo[node] : tree.hi[node]]]
        assert np.sqrt(((own - v[tree.pivot[node]]) ** 2).sum(1)).max() <= tree.radius[node] + 1e-9
    far = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    order, level, parent = cover_tree.net(far[:80, :80])
    for at, p in enumerate(order[1:], 1):
        assert far[p, order[:at]].min() > 2.0 ** level[p] or far[p, order[:at]].min() == 0
        assert far[p, parent[p]] <= 2.0 ** (level[p] + 1)


def test_bounds_prune_pairs():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 8)) * 1000
    v = np.floor(np.vstack([rng.normal(size=(120, 8)) + c for c in centres]))
    search = centroids.Search([[int(x) for x in np.floor(c)] for c in centres])
    found, looked = cover_tree.nearest(v, cover_tree.build(v), search.c, search.tree, lambda rows, own: search.distances(v / 64, v, rows, own))
    assert found.tolist() == [int(((v[i] - search.c) ** 2).sum(1).argmin()) for i in range(len(v))] and looked < len(v) * 16 / 10


# Suffix-array dedup.
@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9), st.lists(st.text("ab", min_size=9, max_size=16) | st.text("abcdefgh", min_size=9, max_size=14), min_size=1, max_size=12), st.integers(1, 4))
def test_merged_transforms_sort_all_strings(depth, strings, n):
    strings = [s.encode() for s in strings]
    used = np.unique(np.frombuffer(b"".join(strings), np.uint8))
    rank = np.zeros(256, np.uint16)
    rank[used] = np.arange(1, len(used) + 1)
    parts = [strings[i::n] for i in range(n) if strings[i::n]]
    shards = [bwt.shard(np.frombuffer(b"".join(p), np.uint8), np.array([len(x) for x in p]), rank, depth) for p in parts]
    from_shard, place, group = bwt.merged(shards, depth, len(used) + 1)
    got = {}
    for k, at, g in zip(from_shard.tolist(), place.tolist(), group.tolist(), strict=True):
        ends = np.cumsum([len(x) + 1 for x in parts[k]])
        own = int(np.searchsorted(ends, at, side="right"))
        start = at - (int(ends[own - 1]) if own else 0)
        got.setdefault(g, []).append(parts[k][own][start : start + depth])
    want = sorted(s[i : i + depth] for s in strings for i in range(len(s) - depth + 1))
    assert [x for g in sorted(got) for x in got[g]] == want and all(len(set(x)) == 1 for x in got.values()) and len(got) == len(set(want))
    for s in shards:
        text = "".join(chr(int(x)) for x in s.symbols)
        assert sorted(s.transform.tolist()) == sorted(map(ord, text)) and sorted(s.order.tolist()) == list(range(len(text)))


def plain_removal(docs):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) with a dictionary of all strings."""
    first, out = {}, []
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - 49 if i is not None else 0):
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49 if i is not None else 0):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("sizes", [(4_000_000, 16_000_000, 8_000_000, 20_000), (3000, 5000, 2000, 3)])
def test_removed_bytes_are_those_of_a_plain_search(spark, sizes, monkeypatch):
    rng = random.Random(11)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "é", "😀", "x"]) + str(rng.randrange(300))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, passage = "This line stands in very many documents, word for word, as it is.", prose(60)
    texts = [None, "", "short", "a" * 49, "a" * 50, "a" * 51, "a" * 400, "a" * 3000, "ab" * 200, "x" + "ab" * 150]
    texts += [prose(rng.randrange(5, 80)) for _ in range(60)]
    texts += [prose(10) + "\n" + line + "\n" + prose(10) for _ in range(40)]
    texts += [prose(5) + passage[: rng.randrange(45, len(passage))] + prose(5) for _ in range(20)]
    texts += [passage] * 30 + [passage + "!"] * 3 + [prose(30000)]
    texts.append(texts[-1][5000:90000] + prose(20))
    texts += [line[:50], line[:49], line[5:55] + line[5:55], "".join(chr(i) for i in range(1, 400))]
    docs = [(i * 3 % 1009 - 200, t) for i, t in enumerate(texts)]
    docs += [(None, passage), (None, None), docs[75], docs[75], (docs[75][0], passage), (-(2**63), passage[:60]), (2**63 - 1, line * 3)]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(i, t, "mine") for i, t in docs], "doc_id bigint, text string, kept string").repartition(6)
    run = suffix_dedup.deduplicated
    monkeypatch.setattr(suffix_dedup, "deduplicated", lambda d: run(d, *sizes))
    got = [tuple(r) for r in suffix_dedup.report(frame).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_removal(docs))) and sum(r[2] for r in got) > 10_000
    assert suffix_dedup.report(frame.limit(0)).count() == 0


def test_spans_and_kept_bytes_make_the_text(spark):
    line = "0123456789" * 6
    docs = spark.createDataFrame([(1, line), (2, "é" + line + "ü" + line), (3, "other")], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in suffix_dedup.deduplicated(docs).collect()}
    assert [tuple(s) for s in rows[2]["spans"]] == [(2, 62), (64, 124)] and bytes(rows[2]["kept"]).decode() == "éü"
    assert not rows[1]["spans"] and bytes(rows[3]["kept"]) == b"other"
    assert rows[1]["n_bytes"] == 60

"""Times written in mixed layouts, as microseconds of UTC.

A guard (one pattern) parts a stamp into date, clock, half of the day and
offset; then a cascade of ``try_to_timestamp``, one link per layout of dates and
each behind the guard of its layout, is coalesced into the wall time. Slashed
dates are read both ways. Those possible in one order only vote for it in their
source; only those that both orders allow, with different dates, branch off and
meet their source's votes. Wall times without an offset meet the offsets of
their zone, which are worked out once for each (zone, wall minute) that occurs.

Both meetings are joins on keys that may be hot, such as a source with a third
of all rows: keys with over 1 in ``SHARE`` of the rows, at most ``SHARE`` of them
whatever the input, are broadcast, all others join by shuffle, where no key is
large. Nothing else goes to the driver.

Defined results: null, empty and other stamps are bad (no time, never voting),
however long they are. A wall time without an offset whose zone is null or no
zone that Java knows (names are case-sensitive) is bad too, though it has voted.
Rows of a null source vote among themselves. Repeated rows each vote. All input
columns are kept; those named utc_us, rule or ambiguous become name_input. An
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import shared

#: Keys with over 1 in SHARE of the rows are broadcast; votes by which an order must lead, as a factor.
SHARE, LEAD = 100, 1
SECOND, HOUR = 1_000_000, 3_600_000_000
MINUTE = 60 * SECOND
BLANKS = " \t\n\x0b\x0c\r"
YEAR, TWO = "20[0-9][0-9]", "[0-9][0-9]"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
#: Layout of dates: its guard and its pattern for parsing.
LAYOUTS = {
    "dashed": (f"{YEAR}-{TWO}-{TWO}", "yyyy-MM-dd"),
    "joined": (f"{YEAR}{TWO}{TWO}", "yyyyMMdd"),
    "dotted": (f"{TWO}[.]{TWO}[.]{YEAR}", "dd.MM.yyyy"),
    "named": (f"{TWO} (?:{MONTHS}) {YEAR}", "dd MMM yyyy"),
}
SLASHED = f"{TWO}/{TWO}/{YEAR}"
DATES = "|".join([*(guard for guard, _ in LAYOUTS.values()), SLASHED])
STAMP = rf"\A({DATES})(?:[T ]({TWO}:{TWO}(?::{TWO})?)(?: ?([AP]M))?(?: ?(Z|[+-]{TWO}:?{TWO}))?)?\z"
#: No stamp that can be read is longer.
LONGEST = 40


def parsed(rows: DataFrame, raw: str, out: str) -> DataFrame:
    """``rows`` with ``out``: struct(kind, vote, utc, wall, day_first, month_first, off) of a stamp, in microseconds.

    ``kind`` is bad, epoch, plain or open (both orders possible, dates differ);
    ``vote`` is 1 for day first, -1 for month first, else 0. ``off`` is null
    without an offset, ``utc`` is that of epochs. Each step's parts are columns, so each is worked out once.
    """
    names = {c: shared.fresh(rows, f"__{c}") for c in ("text", "date", "clock", "half", "offset", "suffix", "wall", "day", "month", "off", "sound", "utc")}
    col = {k: F.col(v) for k, v in names.items()}
    text = F.btrim(F.col(f"`{raw}`").cast("string"), F.lit(BLANKS))
    rows = rows.withColumn(names["text"], F.when(F.length(text) <= LONGEST, text))
    rows = rows.withColumns({names[k]: F.regexp_extract(col["text"], STAMP, i) for i, k in enumerate(("date", "clock", "half", "offset"), 1)})
    clock = F.when(col["clock"] == "", F.lit("00:00:00")).when(F.length(col["clock"]) == 5, F.concat(col["clock"], F.lit(":00"))).otherwise(col["clock"])
    digits = F.regexp_replace(col["offset"], "[+:-]", "")
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    sign = F.when(col["offset"].startswith("-"), -1).otherwise(1)
    off = F.when(col["offset"] == "Z", F.lit(0).cast("bigint")).when(col["offset"] != "", sign * (hours * 60 + minutes).cast("bigint") * MINUTE)
    # What can't be a time is no text to parse: a failed parse costs many times a good one.
    hour, half = F.substring(clock, 1, 2).try_cast("int"), col["half"] != ""
    possible = F.when(half, hour.between(1, 12)).otherwise(hour <= 23) & (F.substring(clock, 4, 2) < "60") & (F.substring(clock, 7, 2) < "60")
    sound = possible & F.coalesce((hours <= 14) & (minutes <= 59), F.lit(True))
    rows = rows.withColumns({
        names["suffix"]: F.concat(F.lit(" "), clock, F.when(half, F.concat(F.lit(" "), col["half"])).otherwise(F.lit("")), F.lit("Z")),
        names["off"]: off,
        names["sound"]: (col["date"] != "") & sound,
        names["utc"]: F.when(col["text"].rlike(r"\A[0-9]{10}\z"), col["text"].cast("bigint") * SECOND).when(col["text"].rlike(r"\A[0-9]{13}\z"), col["text"].cast("bigint") * 1000),
    })

    def read(pattern: str) -> Column:
        stamp = F.concat(col["date"], col["suffix"])
        plain, halved = (F.try_to_timestamp(stamp, F.lit(f"{pattern} {p}")) for p in ("HH:mm:ssX", "hh:mm:ss aX"))
        return F.unix_micros(F.when(half, halved).otherwise(plain))

    slashed = col["sound"] & (F.substring(col["date"], 3, 1) == "/")
    first, second = F.substring(col["date"], 1, 2), F.substring(col["date"], 4, 2)
    wall = F.coalesce(*(F.when(col["sound"] & col["date"].rlike(rf"\A{guard}\z"), read(pattern)) for guard, pattern in LAYOUTS.values()))
    rows = rows.withColumns({
        names["wall"]: wall,
        names["day"]: F.when(slashed & second.between("01", "12"), read("dd/MM/yyyy")),
        names["month"]: F.when(slashed & first.between("01", "12"), read("MM/dd/yyyy")),
    })
    d, m = col["day"], col["month"]
    kind = F.when(col["utc"].isNotNull(), "epoch").when(d != m, "open").when(F.coalesce(col["wall"], d, m).isNotNull(), "plain").otherwise("bad")
    vote = F.when(d.isNotNull() & m.isNull(), 1).when(m.isNotNull() & d.isNull(), -1).otherwise(0)
    found = F.struct(kind.alias("kind"), vote.alias("vote"), col["utc"].alias("utc"), F.coalesce(col["wall"], d, m).alias("wall"), d.alias("day_first"), m.alias("month_first"), col["off"].alias("off"))
    return rows.withColumn(out, found).drop(*names.values())


def known_zones(spark: SparkSession) -> list[str]:
    """The names of zones that Java knows: a few hundred, whatever the input."""
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def with_offsets(minutes: DataFrame, zone: str, minute: str) -> DataFrame:
    """``minutes`` with the offset (microseconds) of each wall minute in its zone, and whether the zone skips or repeats it.

    The zone's offsets 15 hours before and 13 hours after the wall time, read as
    UTC, lie on either side of any instant that it can mean. Where they differ
    the wall time means one instant by just one of them, or the zone skips it
    (neither) or repeats it (both); then the later offset holds. Null for a zone
    that is not known.
    """
    names = ",".join(f"'{z}'" for z in known_zones(minutes.sparkSession))
    named = F.when(F.expr(f"`{zone}` IN ({names})"), F.col(zone))
    at = F.col(minute) * MINUTE

    def offset(instant: Column) -> Column:
        return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(instant), named)) - instant

    sides = minutes.withColumn("__old", offset(at - 15 * HOUR)).withColumn("__new", offset(at + 13 * HOUR))
    by_old, by_new = (offset(at - F.col(c)) == F.col(c) for c in ("__old", "__new"))
    one = (F.col("__old") != F.col("__new")) & by_old & ~by_new
    changed = (F.col("__old") != F.col("__new")) & (by_old == by_new)
    return sides.withColumn("offset", F.when(one, F.col("__old")).otherwise(F.col("__new"))).withColumn("changed", changed).drop("__old", "__new")


def met(rows: DataFrame, table: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each of their keys; ``n`` counts the rows of a key.

    Keys with over 1 in SHARE of all rows, so fewer than SHARE of them, are
    broadcast, and their rows are not shuffled.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = table.filter(F.col(n) * SHARE > total).drop(n)
    rest = table.filter(F.col(n) * SHARE <= total).drop(n)
    by_size = rows.join(F.broadcast(hot), keys)
    return by_size.unionByName(rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(rest, keys))


def normalized(stamps: DataFrame, raw: str = "raw", zone: str = "zone", source: str = "source") -> DataFrame:
    """``stamps`` with utc_us, rule and ambiguous: see the head of this module."""
    stamps = shared.make_room(stamps, "utc_us", "rule", "ambiguous")
    p, key, place, minute = (shared.fresh(stamps, c) for c in ("__p", "__source", "__zone", "__minute"))
    kept = [F.col(f"`{c}`") for c in stamps.columns]

    def tagged(name: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(f"`{name}`").cast("string")), F.lit(""))

    rows = parsed(stamps, raw, p).withColumn(key, tagged(source))
    rows = shared.written(rows.withColumn(place, F.coalesce(F.col(f"`{zone}`").cast("string"), F.lit(""))), "stamps")
    kind, off = F.col(f"{p}.kind"), F.col(f"{p}.off")

    voting = rows.filter((F.col(f"{p}.vote") != 0) | (kind == "open")).groupBy(key)
    votes = voting.agg(F.count_if(F.col(f"{p}.vote") > 0).alias("__day"), F.count_if(F.col(f"{p}.vote") < 0).alias("__month"), F.count_if(kind == "open").alias("__n"))
    votes = shared.written(votes.filter("__n > 0"), "votes")
    opened = met(rows.filter(kind == "open"), votes, [key], "__n")
    month, day = F.col("__month") > LEAD * F.col("__day"), F.col("__day") > LEAD * F.col("__month")
    wall = F.when(month, F.col(f"{p}.month_first")).otherwise(F.col(f"{p}.day_first"))
    opened = opened.select(*kept, place, off.alias("__off"), wall.alias("__wall"), F.when(month | day, "votes").otherwise("default").alias("rule"))
    plain = rows.filter(kind == "plain").select(*kept, place, off.alias("__off"), F.col(f"{p}.wall").alias("__wall"), F.lit("plain").alias("rule"))
    read = plain.unionByName(opened)

    # Resolved once per (zone, minute): a decided wall time and the row both follow from written tables.
    zoned = read.filter("__off IS NULL").withColumn(minute, F.floor(F.col("__wall") / MINUTE).cast("bigint"))
    minutes = with_offsets(zoned.groupBy(place, minute).agg(F.count("*").alias("__n")), place, minute)
    found = met(zoned, shared.written(minutes, "offsets"), [place, minute], "__n")
    bad = F.col("offset").isNull()
    unsure = F.col("rule").isin("votes", "default")
    by_zone = found.select(*kept, (F.col("__wall") - F.col("offset")).alias("utc_us"), F.when(bad, "bad").otherwise(F.col("rule")).alias("rule"), (~bad & (unsure | F.col("changed"))).alias("ambiguous"))
    by_offset = read.filter("__off IS NOT NULL").select(*kept, (F.col("__wall") - F.col("__off")).alias("utc_us"), "rule", unsure.alias("ambiguous"))
    rest = rows.filter(kind.isin("bad", "epoch")).select(*kept, F.col(f"{p}.utc").alias("utc_us"), kind.alias("rule"), F.lit(False).alias("ambiguous"))
    out = by_zone.unionByName(by_offset).unionByName(rest)
    return out.withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def report(stamps: DataFrame) -> DataFrame:
    """(stamp_id, utc_us, rule, ambiguous) of every row of stamps."""
    return normalized(stamps.select("stamp_id", "source", "zone", "raw")).select("stamp_id", "utc_us", "rule", "ambiguous")


def _oracle() -> str:
    """DuckDB SQL of the report: parts by one pattern, both orders, votes by source, offsets a day before and after."""
    whole = STAMP.replace(r"\A", "^").replace(r"\z", "$")
    formats = [*(pattern for pattern in ("%Y-%m-%d", "%Y%m%d", "%d.%m.%Y", "%d %b %Y"))]
    guards = [guard for guard, _ in LAYOUTS.values()]
    wall = " ".join(f"WHEN regexp_full_match(d, '{g}') THEN try_strptime(d, '{f}')" for g, f in zip(guards, formats, strict=True))
    return f"""
WITH t AS (SELECT stamp_id, source, zone, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM stamps),
g AS (SELECT *, regexp_extract(t, '{whole}', 1) AS d, regexp_extract(t, '{whole}', 2) AS c, regexp_extract(t, '{whole}', 3) AS half,
  replace(regexp_extract(t, '{whole}', 4), ':', '') AS o,
  CASE WHEN regexp_full_match(t, '[0-9]{{10}}') THEN CAST(t AS BIGINT) * 1000000 WHEN regexp_full_match(t, '[0-9]{{13}}') THEN CAST(t AS BIGINT) * 1000 END AS utc FROM t),
h AS (SELECT *, CASE WHEN c = '' THEN 0 ELSE CAST(c[1:2] AS INT) END AS hh, CASE WHEN c = '' THEN 0 ELSE CAST(c[4:5] AS INT) END AS mi,
  CASE WHEN length(c) < 8 THEN 0 ELSE CAST(c[7:8] AS INT) END AS ss FROM g),
k AS (SELECT *, CASE WHEN mi > 59 OR ss > 59 OR (half = '' AND hh > 23) OR (half <> '' AND (hh < 1 OR hh > 12)) THEN NULL
  WHEN o NOT IN ('', 'Z') AND (CAST(o[2:3] AS INT) > 14 OR CAST(o[4:5] AS INT) > 59) THEN NULL
  ELSE (CASE WHEN half = '' THEN hh WHEN half = 'AM' THEN hh % 12 ELSE hh % 12 + 12 END * 3600 + mi * 60 + ss) * 1000000::BIGINT END AS clock,
  CASE WHEN o = 'Z' THEN 0 WHEN o <> '' THEN (CASE WHEN o[1:1] = '-' THEN -1 ELSE 1 END) * (CAST(o[2:3] AS INT) * 60 + CAST(o[4:5] AS INT)) * 60000000::BIGINT END AS off FROM h),
w AS (SELECT *, epoch_us(CASE {wall} END) + clock AS plain,
  epoch_us(CASE WHEN regexp_full_match(d, '{SLASHED}') THEN try_strptime(d, '%d/%m/%Y') END) + clock AS dm,
  epoch_us(CASE WHEN regexp_full_match(d, '{SLASHED}') THEN try_strptime(d, '%m/%d/%Y') END) + clock AS md FROM k),
v AS (SELECT source, count(*) FILTER (dm IS NOT NULL AND md IS NULL) AS nd, count(*) FILTER (md IS NOT NULL AND dm IS NULL) AS nm FROM w GROUP BY source),
j AS (SELECT w.*, CASE WHEN utc IS NOT NULL THEN 'epoch' WHEN coalesce(plain, dm, md) IS NULL THEN 'bad' WHEN dm <> md THEN CASE WHEN nd <> nm THEN 'votes' ELSE 'default' END ELSE 'plain' END AS r,
  CASE WHEN dm <> md THEN CASE WHEN nm > nd THEN md ELSE dm END ELSE coalesce(plain, dm, md) END AS wall
  FROM w LEFT JOIN v ON w.source IS NOT DISTINCT FROM v.source),
z AS (SELECT *, r IN ('plain', 'votes', 'default') AND off IS NULL AS z FROM j),
b AS (SELECT *, CASE WHEN z THEN epoch_us(timezone(zone, timezone('UTC', make_timestamp(wall - 86400000000)))) - wall + 86400000000 END AS o1,
  CASE WHEN z THEN epoch_us(timezone(zone, timezone('UTC', make_timestamp(wall + 86400000000)))) - wall - 86400000000 END AS o2 FROM z),
e AS (SELECT *, CASE WHEN z THEN epoch_us(timezone(zone, timezone('UTC', make_timestamp(wall - o1)))) - wall + o1 = o1 END AS is1,
  CASE WHEN z THEN epoch_us(timezone(zone, timezone('UTC', make_timestamp(wall - o2)))) - wall + o2 = o2 END AS is2 FROM b)
SELECT stamp_id, CASE WHEN r = 'epoch' THEN utc WHEN NOT z THEN wall - off WHEN is1 AND NOT is2 THEN wall - o1 ELSE wall - o2 END AS utc_us,
  CASE WHEN z AND o2 IS NULL THEN 'bad' ELSE r END AS rule,
  coalesce(CASE WHEN z AND o2 IS NULL THEN false ELSE r IN ('votes', 'default') OR (z AND o1 <> o2 AND is1 = is2) END, false) AS ambiguous FROM e"""


ORACLE = _oracle()

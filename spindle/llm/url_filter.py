"""URL filter: rules of host and path first, else a linear model of hashed n-grams.

The model is a logistic regression over hashed character trigrams of host and
path, trained in numpy on the driver from a small labelled table. Its weights
are whole numbers (1/4096 of a logit), so a score is the same wherever it is
summed. Judging is native: one projection over the urls, no shuffle.

Defined results: a null url, or one without ``://``, has an empty host and path
and is judged by the model on those; a very long url is read whole; repeated rows
each keep their own row; the input's own columns of an output's name are kept as
name_input.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm import shared

BUCKETS, SCALE = 8192, 4096
#: The logit above which a url is blocked.
BAR = 0.5
#: The mixing factors of the trigram hash.
MIX = (7919, 104729, 1299709)
SEED = {"host": 17, "path": 1031}

#: Fixed values: (verdict, host, start of path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

# The labelled table, host and path of each url. Endings, numbers and
# plain paths are alike in both halves, so that what they say is in their words.
BLOCKED = """
casino-royale-slots.example.com/en/101 www.onlinecasino.example.org/de/77.html m.casinobonus.example.net/play bestcasinos.example.com/
freespins-casino.example.org/es/12 live-poker.example.com/fr/8 pokerstars-bonus.example.net/en/9/ www.free-poker.example.org/table
sportsbets.example.com/en/4411 bet-now.example.net/odds m.bets365.example.org/de/5 betting-tips.example.com/en/63.html live-bets.example.org/fr/1
bigwin-jackpot.example.com/en/7 win-prizes.example.org/claim www.win-cash.example.net/es/90 jackpot-winner.example.com/de/3 instant-win.example.org/en/2
free-gifts.example.com/en/55 www.free-iphone.example.net/claim-now freebies-win.example.org/fr/6 get-free-cash.example.com/en/18 free-downloads.example.net/crack
cheap-meds.example.com/en/31 www.cheapviagra.example.org/buy pills-online.example.net/no-prescription diet-pills.example.com/de/22 buy-cheap-cialis.example.org/en/4
discount-pills.example.org/fr/41.html rx-pharmacy-cheap.example.net/en/8 weightloss-pills.example.com/es/2 cheap-replica-watches.example.net/en/6
adult-cams.example.com/en/1 www.adult-chat.example.org/live adultdating.example.net/de/9 free-adult-videos.example.com/fr/3 xxx-tube.example.org/en/5 x-rated.example.net/en/12
hot-xxx-cams.example.com/es/7 sex-hookup.example.org/en/66 porn-videos.example.net/watch m.adultx.example.com/de/11 nude-cams-x.example.org/en/8
ads-server.example.com/en/21 click-ads.example.net/redirect www.popads.example.org/en/3 adsnetwork.example.com/track ad-tracker.example.net/pixel.gif
track-clicks.example.org/en/14 tracking-ads.example.com/fr/5 banner-ads.example.net/de/8 m.adtrack.example.org/en/40 clicktrack.example.com/es/6
spam-mailer.example.com/en/2 bulk-spam.example.net/list www.linkspam.example.org/de/30 link-farm.example.com/en/19 contentfarm.example.net/fr/9
seo-spam-links.example.org/en/7 clickfarm-traffic.example.com/es/4 email-spam-list.example.net/en/15 likes-farm.example.org/buy
payday-loans-fast.example.com/en/9 crypto-doubler.example.net/invest get-rich-quick.example.org/en/3 forex-signals-win.example.com/de/6
keygen-crack.example.com/en/4 warez-torrents.example.net/crack cracked-games.example.org/fr/2 hot-deals-cheap.example.com/en/33 fake-diploma.example.net/buy
""".split()
ALLOWED = """
www.city-library.example.com/en/101 history-museum.example.org/de/77.html m.garden-blog.example.net/plants mathworld.example.com/
recipes-daily.example.org/es/12 river-news.example.com/fr/8 astronomy-club.example.net/en/9/ www.open-science.example.org/table
sports-results.example.com/en/4411 better-health.example.net/tips m.alphabet-school.example.org/de/5 betterworld.example.com/en/63.html diabetes-care.example.org/fr/1
winter-holidays.example.com/en/7 windows-help.example.org/setup www.wind-power.example.net/es/90 darwin-society.example.com/de/3 twin-cities.example.org/en/2
freedom-press.example.com/en/55 www.freelance-writers.example.net/jobs freetown-news.example.org/fr/6 free-software.example.com/en/18 carefree-travel.example.net/guide
chemistry-notes.example.com/en/31 www.cheese-makers.example.org/buy spills-response.example.net/report caterpillar-facts.example.com/de/22 buy-local-books.example.org/en/4
country-hills.example.org/fr/41.html pharmacy-school.example.net/en/8 pillar-architecture.example.com/es/2 watch-repair.example.net/en/6
adult-education.example.com/en/1 www.adulthood-study.example.org/live dating-of-rocks.example.net/de/9 video-lessons.example.com/fr/3 tube-map.example.org/en/5 xylophone.example.net/en/12
hot-springs.example.com/es/7 essex-council.example.org/en/66 sextant-navigation.example.net/read m.hexagon.example.com/de/11 x-ray-physics.example.org/en/8
roads-authority.example.com/en/21 heads-up-maths.example.net/lesson www.pads-and-pens.example.org/en/3 social-network-study.example.com/paper address-book.example.net/help
track-and-field.example.org/en/14 tracks-of-animals.example.com/fr/5 bannerman-castle.example.net/de/8 m.railtracks.example.org/en/40 click-beetles.example.com/es/6
mail-history.example.com/en/2 bulk-carriers.example.net/list www.spanish-course.example.org/de/30 organic-farm.example.com/en/19 farmers-market.example.net/fr/9
linking-words.example.org/en/7 farmhouse-cooking.example.com/es/4 email-basics.example.net/en/15 likelihood.example.org/read
day-trips.example.com/en/9 cryptography.example.net/paper richmond-park.example.org/en/3 foreign-languages.example.com/de/6
keyboard-music.example.com/en/4 wares-of-pottery.example.net/shop board-games.example.org/fr/2 hotels-review.example.com/en/33 diploma-courses.example.net/apply
library.example.com/en/825 www.weather.example.net/de/17 theatre.example.org/fr/6400.html m.station.example.com/es/3100/ shaped.example.org/en/482 thinking.example.net/en/7817
blog.nation.example.com/fr/7424.html mother.example.org/es/4918 inherent.example.net/en/2518/ then.example.com/en/1776.html another.example.org/fr/8314 onion.example.net/de/1600
""".split()


def labelled() -> list[tuple[str, str, int]]:
    """The small labelled table: (host, path, 1 to block)."""
    rows = [(u, 1) for u in BLOCKED] + [(u, 0) for u in ALLOWED]
    return [(u.partition("/")[0], "/" + u.partition("/")[2], y) for u, y in rows]


def buckets(text: str, seed: int) -> list[int]:
    codes = [ord(c) for c in f"^{text}$"]
    return [(a * MIX[0] + b * MIX[1] + c * MIX[2] + seed) % BUCKETS for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)]


def fit(rows: Sequence[tuple[str, str, int]], epochs: int = 300, rate: float = 0.5, l2: float = 1e-3) -> tuple[list[int], int]:
    """Weights by bucket and bias, in 1/4096 of a logit."""
    x = np.zeros((len(rows), BUCKETS))
    for i, (host, path, _) in enumerate(rows):
        np.add.at(x[i], buckets(host, SEED["host"]) + buckets(path, SEED["path"]), 1)
    y = np.array([r[2] for r in rows], float)
    balance = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.zeros(BUCKETS), -0.5
    for _ in range(epochs):
        g = (1 / (1 + np.exp(-(x @ w + b))) - y) * balance
        w -= rate * (x.T @ g + l2 * w)
        b -= rate * (g.sum() + l2 * b)
    return [int(v) for v in np.rint(w * SCALE)], int(round(b * SCALE))


@functools.cache
def model() -> tuple[list[int], int]:
    return fit(labelled())


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters in lower case; path: then up to ``?``, ``#`` or the end."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, pattern, 2)


def grams(text: Column, seed: int, weights: Column) -> Column:
    """Sum of the weights of a text's trigrams."""
    codes = F.transform(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: F.ascii(c).cast("bigint"))

    def step(acc: Column, c: Column) -> Column:
        bucket = F.pmod(acc["a"] * MIX[0] + acc["b"] * MIX[1] + c * MIX[2] + seed, F.lit(BUCKETS))
        return F.struct(acc["b"].alias("a"), c.alias("b"), (acc["n"] + 1).alias("n"), (acc["sum"] + F.when(acc["n"] < 2, F.lit(0)).otherwise(F.element_at(weights, (bucket + 1).cast("int")))).alias("sum"))

    zero = F.struct(*[F.lit(0).cast("bigint").alias(x) for x in ("a", "b", "n", "sum")])
    return F.aggregate(codes, zero, step, lambda a: a["sum"])


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct (verdict, rule); null if none does."""
    best = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(best)
    return best


def judge(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` with url_host, url_path, url_rule, url_score (logit) and url_verdict."""
    weights, bias = model()
    host, path = host_path(F.col(url))
    table = shared.whole_numbers(weights)
    fits, total = shared.fresh(pages, "fits"), shared.fresh(pages, "total")
    out = shared.make_room(pages.withColumn(fits, F.struct(host.alias("h"), path.alias("p"))), "url_host", "url_path", "url_rule", "url_score", "url_verdict")
    out = out.withColumns({"url_host": F.col(fits)["h"], "url_path": F.col(fits)["p"]})
    out = out.withColumns({fits: rule_for(F.col("url_host"), F.col("url_path"), rules), total: grams(F.col("url_host"), SEED["host"], table) + grams(F.col("url_path"), SEED["path"], table) + bias})
    verdict = F.coalesce(F.col(fits)["verdict"], F.when(F.col(total) > int(BAR * SCALE), "block").otherwise("allow"))
    return out.withColumns({"url_rule": F.col(fits)["rule"], "url_score": F.col(total) / SCALE, "url_verdict": verdict}).drop(fits, total)


def report(pages: DataFrame) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict."""
    found = judge(pages.select("page_id", "url"))
    return found.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


def oracle() -> str:
    """The same in DuckDB SQL, with the model's weights as a list."""
    weights, bias = model()

    def total(text: str, seed: int) -> str:
        s = f"('^' || {text} || '$')"
        h = f"ascii(substr({s}, i, 1))::BIGINT * {MIX[0]} + ascii(substr({s}, i + 1, 1)) * {MIX[1]} + ascii(substr({s}, i + 2, 1)) * {MIX[2]} + {seed}"
        return f"coalesce(list_sum(list_transform(range(1, length({s}) - 1), lambda i: w[(({h}) % {BUCKETS}) + 1])), 0)"

    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(v, h + p, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for v, h, p in rules]
    return f"""
WITH m AS (SELECT {weights!r} AS w),
p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {f} THEN '{r}'" for _, r, f in fits)} END AS rule,
  CASE {" ".join(f"WHEN {f} THEN '{v}'" for v, _, f in fits)}
  WHEN {total("host", SEED["host"])} + {total("path", SEED["path"])} + {bias} > {int(BAR * SCALE)} THEN 'block' ELSE 'allow' END AS verdict
FROM p, m"""

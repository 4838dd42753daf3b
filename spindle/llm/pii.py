"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Native: one projection over the texts, no shuffle and no Python on executors.

A span's score begins with what its pattern and checksum are worth. Words on
either side that name its kind raise it, words that name another kind of number
lower it. Spans of the base kinds are always reported, with their score; the
further kinds are reported from THRESHOLD on. ``confident`` keeps what reaches a
bar of the caller's.

Defined results: a null or empty text has no spans; positions count code
points, ends are exclusive; a very long text is read whole; repeated rows each
keep their own row; columns of the input are passed on untouched, one of the
output's name as name_input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm import shared
from spindle.llm import spans as S

KINDS = ("email", "ip", "card", "phone")
#: A span that no contract fixes is kept from this score on.
THRESHOLD = 0.6
#: Characters on either side of a span in which context words count, and what those for and against it are worth.
CONTEXT, FOR, AGAINST = 48, 0.3, -0.3

# The patterns of the base kinds. A lookbehind (or \G, the end of
# the match before) keeps the search from starting again inside a run that has
# failed, and possessive quantifiers keep it from backing off, so the time is
# linear in the text; the matches are the same.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Kinds that the method adds.
LOCAL = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
# Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL IQ", 24: "AD CZ ES MD PK RO SA SE SK TN VA", 25: "PT", 26: "IS TR",
    27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC",
}
IBAN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])"
CONTEXT_WORDS = {
    "email": r"\b(?:e-?mail|mail|contact|write)",
    "ip": r"\b(?:ip|host|server|address|client)\b",
    "card": r"\b(?:card|visa|mastercard|amex|credit|debit|payment)",
    "phone": r"\b(?:phone|tel|call|mobile|cell|fax|whatsapp)",
    "iban": r"\b(?:iban|bank|account|konto|compte|cuenta)",
    "local": r"\b(?:phone|tel|call|mobile|cell|fax|whatsapp)",
}
OTHER_WORDS = {
    "email": r"\b(?:noreply|no-reply|example)\b",
    "ip": r"\b(?:version|release|section|chapter|v)\b",
    "card": r"\b(?:isbn|order|invoice|serial|tracking|part)\b",
    "phone": r"\b(?:isbn|order|invoice|serial|equals|plus)\b",
    "iban": r"\b(?:example|serial|part)\b",
    "local": r"\b(?:isbn|order|invoice|serial|tracking|part)\b",
}


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the check sum of a string of digits is right."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if the first four characters moved to the end, letters as 10 to 35, leave 1 modulo 97."""
    clean = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(clean, 5, 64), F.substring(clean, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda a, v: F.pmod(a * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))) == 1


def octets(ip: Column) -> Column:
    """True if every part is at most 255, leading zeros or not."""
    return F.forall(F.split(ip, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(256)) <= 255))


def detect(text: Column, threshold: float = THRESHOLD, context: int = CONTEXT) -> Column:
    """The spans of a text, fixed and more: arrays of (start, rank, end, kind, score, base, text)."""
    text = F.coalesce(text, F.lit(""))

    def scored(kind: str, prior: float):
        def score(f: Column) -> Column:
            beside = F.lower(F.concat(f["before"], F.lit("\n"), f["after"]))
            weigh = lambda words, worth: F.when(beside.rlike(words[kind]), F.lit(worth)).otherwise(F.lit(0.0))
            return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(prior) + weigh(CONTEXT_WORDS, FOR) + weigh(OTHER_WORDS, AGAINST)))

        return score

    def proposed(pattern: str, kind: str, rank: int, prior: float, base: bool, needs: str | None = None, good=None) -> Column:
        found = S.find_all(text, pattern, needs=needs, around=context)
        found = found if good is None else F.filter(found, good)
        score = scored(kind, prior)
        return F.transform(found, lambda f: S.span(f, rank, kind, score(f), base))

    fixed = F.concat(
        proposed(EMAIL, "email", 0, 0.7, True, "@"),
        proposed(IP, "ip", 1, 0.5, True, good=lambda f: octets(f["text"])),
        proposed(CARD, "card", 2, 0.7, True, good=lambda f: F.length(digits_of(f["text"])).between(12, 19) & luhn(digits_of(f["text"]))),
        proposed(PHONE, "phone", 3, 0.6, True, "+", good=lambda f: F.length(digits_of(f["text"])).between(9, 15)),
    )
    more = F.concat(proposed(IBAN, "iban", 4, 0.7, False, good=lambda f: mod97(f["text"])), proposed(LOCAL, "local", 5, 0.4, False))
    return F.struct(fixed.alias("fixed"), F.filter(more, lambda s: s["score"] >= threshold).alias("more"))


def with_spans(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """``docs`` with the column ``out`` of spans; base spans win over added ones they overlap."""
    raw = shared.fresh(docs, "raw")
    found = shared.make_room(docs.withColumn(raw, detect(F.col(text))), out)
    return found.withColumn(out, S.together(F.col(raw)["fixed"], F.col(raw)["more"])).drop(raw)


def confident(spans: Column, bar: float) -> Column:
    """The spans whose score reaches ``bar``, base ones as well."""
    return F.filter(spans, lambda s: s["score"] >= bar)


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each run of overlapping spans replaced by ``[KIND]`` of its first."""
    return S.pieces(text, spans, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))


def report(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, counts of the base kinds, base_sha256 and spans."""
    found = with_spans(docs.select("doc_id", "text"))
    return found.select("doc_id", *S.digest_columns(F.col("pii_spans"), KINDS))

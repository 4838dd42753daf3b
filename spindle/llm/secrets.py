"""Secrets: fixed patterns, and tokens that two character Markov models call random.

One model is of random strings, one of ordinary identifiers; both are first
order over 67 characters, trained on labelled samples: random strings of six
alphabets, and identifiers, paths, compound words of four languages, rulers and
runs of an alphabet made from a list of words. A token's score is the mean
log-likelihood ratio of its steps in 1/1024 nats, in integers, so that it is the
same wherever it is summed. A token of few different letters and digits is never
a secret, whatever its score. Native: one projection, no shuffle, no Python on
executors.

Defined results: a null or empty text has no spans; positions count code
points, ends are exclusive; a very long text is read whole; repeated rows each
keep their own row; columns of the input are passed on untouched, one of the
output's name as name_input.
"""

from __future__ import annotations

import functools
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm import shared
from spindle.llm import spans as S

KINDS = ("assign", "access", "hex")
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
SCALE = 1024
#: Least length of a token that the models judge, different letters and digits in it, and the mean ratio from which it counts as random.
MIN_TOKEN, MIN_DIFFERENT, MIN_RATIO = 20, 8, 0.35

# The patterns of the base kinds. Runs of under 16 hex digits and
# keys of under 18 characters are never reported, so the patterns ask for them.
ASSIGN = r"""(?:(?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}+"

WORDS = (
    "get set user name file path list item node index count value total input output stream buffer reader writer "
    "create update delete insert select where order group result response request client server session config "
    "default option handler manager service factory builder parser token string number array object table column "
    "row key map filter reduce sort search find load save open close start stop begin first last next previous "
    "page content title header footer body image video audio document language message error warning info debug test "
    "module package class method function return import export public private static final local global thread "
    "process queue task worker event listener callback time date year month hour minute second version build "
    "license copyright internationalisation responsibility understanding through would because windows keyboard "
    "entwicklung verantwortung gesellschaft geschwindigkeit versicherung bundes ausbildung schutz verkehr wirtschaft "
    "developpement gouvernement etablissement aujourd heureux beaucoup maintenant desarrollo conocimiento universidad "
    "responsabilidad informacion siempre nosotros donaudampfschifffahrt rindfleisch ueberwachung freundschaft"
).split()
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/")
ROWS = (string.ascii_lowercase, string.ascii_uppercase, string.digits * 3, "qwertyuiopasdfghjklzxcvbnm", string.ascii_letters + string.digits)


def samples(seed: int = 11, n: int = 6000) -> tuple[list[str], list[str]]:
    """Labelled samples: random strings, and what texts hold otherwise."""
    rng = random.Random(seed)
    odd = ["".join(rng.choices(ALPHABETS[i % 6], k=rng.randint(20, 48))) for i in range(n)]

    def ordinary(i: int) -> str:
        words = [rng.choice(WORDS) for _ in range(rng.randint(2, 6))]
        camel = words[0] + "".join(x.title() for x in words[1:])
        number = str(rng.randint(1, 2030))
        match i % 12:
            case 0 | 1:
                return "_".join(words)
            case 2:
                return "-".join(words)
            case 3 | 4:
                return camel + (number if rng.random() < 0.3 else "")
            case 5 | 6:
                return "".join(words)
            case 7:
                return "/" + "/".join([*words, number])
            case 8:
                return "_".join(words).upper()
            case 9:
                return f"{words[0]}={words[1]}-{rng.randint(2000, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}_{words[0]}"
            case 10:
                row = rng.choice(ROWS)
                return row[rng.randint(0, 4) :]
        return "".join(rng.sample("-=_+/", rng.choice((1, 1, 2)))) * rng.randint(10, 40)

    return odd, [ordinary(i) for i in range(n)]


def fit(texts: list[str], smooth: float = 0.5) -> np.ndarray:
    """Log probabilities of a character after another."""
    at = {c: i for i, c in enumerate(ALPHABET)}
    counts = np.full((len(ALPHABET), len(ALPHABET)), smooth)
    for t in texts:
        codes = [at[c] for c in t if c in at]
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


@functools.cache
def ratio_table() -> tuple[int, ...]:
    """Log-likelihood ratios of random against ordinary, by pair of characters, in 1/1024 nats."""
    odd, ordinary = samples()
    return tuple(int(x) for x in np.rint((fit(odd) - fit(ordinary)) * SCALE).ravel())


def ratio(token: Column) -> Column:
    """Mean log-likelihood ratio of a token's steps, in nats; 0 for under two characters."""
    at = shared.whole_numbers(ALPHABET.find(chr(i)) if chr(i) in ALPHABET else ALPHABET.index("-") for i in range(128))
    table, n = shared.whole_numbers(ratio_table()), len(ALPHABET)
    codes = F.transform(F.split(token, ""), lambda c: F.element_at(at, F.least(F.ascii(c), F.lit(127)) + 1))

    def step(acc: Column, code: Column) -> Column:
        known = F.element_at(table, F.greatest(acc["last"], F.lit(0)) * n + code + 1).cast("bigint")
        return F.struct(code.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, F.lit(0)).otherwise(known)).alias("sum"))

    total = F.aggregate(codes, F.struct(F.lit(-1).alias("last"), F.lit(0).cast("bigint").alias("sum")), step, lambda a: a["sum"])
    return F.when(F.length(token) > 1, total / (SCALE * (F.length(token) - 1))).otherwise(F.lit(0.0))


def with_spans(docs: DataFrame, text: str = "text", out: str = "secret_spans", min_ratio: float = MIN_RATIO) -> DataFrame:
    """``docs`` with the column ``out`` of spans; the score is the ratio of the secret itself."""
    raw, body = shared.fresh(docs, "raw"), F.coalesce(F.col(text), F.lit(""))

    def base(pattern: str, kind: str, group: int = 0, needs: str | None = None) -> Column:
        found = S.find_all(body, pattern, group, needs)
        found = F.filter(found, lambda f: F.length(f["part"]) >= 12) if group else found
        return F.transform(found, lambda f: S.span(f, KINDS.index(kind), kind, ratio(f["part"]), True))

    fixed = F.concat(base(ASSIGN, "assign", 1), base(ACCESS, "access", needs="AKIA"), base(HEX, "hex"))
    varied = lambda f: F.size(F.array_distinct(F.split(F.regexp_replace(f["text"], "[^A-Za-z0-9]", ""), ""))) >= MIN_DIFFERENT
    more = F.filter(F.transform(F.filter(S.find_all(body, TOKEN), varied), lambda f: S.span(f, 3, "random", ratio(f["text"]), False)), lambda s: s["score"] >= min_ratio)
    found = shared.make_room(docs.withColumn(raw, F.struct(fixed.alias("fixed"), more.alias("more"))), out)
    return found.withColumn(out, S.together(F.col(raw)["fixed"], F.col(raw)["more"])).drop(raw)


def report(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, counts of the base kinds, base_sha256 and spans."""
    found = with_spans(docs.select("doc_id", "text"))
    return found.select("doc_id", *S.digest_columns(F.col("secret_spans"), KINDS))

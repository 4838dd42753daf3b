"""Language ID: averaged hashed subword embeddings and a linear softmax.

A text's subwords are the runs of 1 to 4 letters in its words, marked at their
ends, hashed into buckets. Its vector is the mean of their embeddings, over the
whole text. Embeddings and softmax are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled documents, whole texts of any
length, shared out evenly among the languages; it comes to the driver as hashed
bucket counts, never texts. A temperature and
the least score of an accepted text are set on a part of the sample that
training has not seen. As mean and softmax are linear, prediction sums one row
of logits for each subword.

Defined results: a null text, and one without a letter (a digit, a fraction, a
power or a picture is none), is ``und`` with score 0 and rejected, as is every
text when nothing was learned; repeated rows each get their own result; of the
input's columns, whatever else they are named, only text, lang and doc_id are
read; documents of null id or language are not learned from. Of more
languages than the sample has rows, the most frequent are learned.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm import shared

BUCKETS, DIM, GRAMS = 4096, 16, (1, 2, 3, 4)
#: The sample: documents learned from.
SAMPLE = 2000
#: Share of rightly labelled texts that may be rejected, and the highest bar.
REJECT_SHARE, REJECT_TOP = 0.002, 0.5
RESULT = "lang string, score double, rejected boolean"
#: Characters hashed at once, so that a very long text needs no more memory.
CHUNK = 1 << 18
#: Hashes that documents are drawn by.
TURNS = 1 << 40
_MULT = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)
#: Where a code point is a letter.
_LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)])


def codes(text: str) -> np.ndarray:
    """Code points in lower case, everything but letters as a blank."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_LETTERS[c], c, np.uint32(32))


def counts(text: str) -> tuple[np.ndarray, int]:
    """How often each bucket is hit, and the hits."""
    c, total = codes(text), np.zeros(BUCKETS, np.int64)
    for start in range(0, len(c), CHUNK):
        for n in GRAMS:
            part = c[start : start + CHUNK + n - 1]
            if len(part) < n:
                continue
            m = len(part) - n + 1
            h = np.full(m, np.uint32(n * 97))
            for i in range(n):
                h = (h ^ part[i : i + m]) * _MULT[i]
                h ^= h >> np.uint32(15)
            inner = np.ones(m, bool)  # no blank but at the ends, and not blanks alone
            for i in range(1, n - 1):
                inner &= part[i : i + m] != 32
            inner &= (part[:m] != 32) | (part[n - 1 :] != 32) if n > 1 else part != 32
            total += np.bincount(h[inner] % np.uint32(BUCKETS), minlength=BUCKETS)
    return total, int(total.sum())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # logits by bucket, divided by the temperature
    bias: np.ndarray
    bar: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        total, n = counts(text or "")
        if not n or not self.langs:
            return "und", 0.0, True
        p = softmax((total @ self.table / max(n, 1) + self.bias)[None])[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.bar)


def fit(x: np.ndarray, labels: list[str], epochs: int = 40, batch: int = 64, rate: float = 40.0, seed: int = 7) -> Model:
    """Trains on four fifths of the rows (a text's share of each bucket) and calibrates on the rest."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(v) for v in labels])
    order = rng.permutation(len(y))
    held, seen = order[: len(y) // 5], order[len(y) // 5 :]
    e = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
    w, b = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(seen), max(1, len(seen) // batch)):
            mean = x[rows] @ e
            g = softmax(mean @ w + b)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            back = g @ w.T
            w -= 0.05 * step * (mean.T @ g)
            b -= 0.005 * step * g.sum(0)
            e -= step * (x[rows].T @ back)
    table, bias = (e @ w).astype(np.float64), b.astype(np.float64)
    held = held if len(held) else seen
    logits = x[held] @ table + bias
    heats = np.geomspace(0.05, 20, 60)
    losses = [-np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in heats]
    heat = heats[int(np.argmin(losses))]
    p = softmax(logits / heat)
    right = p.max(1)[p.argmax(1) == y[held]]
    bar = min(REJECT_TOP, float(np.quantile(right, REJECT_SHARE))) if len(right) else 0.0
    return Model(langs, table / heat, bias / heat, bar)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def quota(numbers: Sequence[int], sample: int) -> int:
    """The most rows a language may have, so that all have ``sample`` at most; 1 at least."""
    left, numbers = sample, sorted(numbers)
    for i, n in enumerate(numbers):
        if n * (len(numbers) - i) > left:
            return max(1, left // (len(numbers) - i))
        left -= n
    return max([1, *numbers])


def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The buckets a text hits, and the share of each."""
    for b in batches:
        found = []
        for text in b["text"]:
            total, n = counts(text)
            at = np.flatnonzero(total)
            found.append((at.astype(np.int16).tobytes(), (total[at] / max(n, 1)).astype(np.float32).tobytes()))
        yield pd.DataFrame({"lang": b["lang"], "turn": b["turn"], "at": [f[0] for f in found], "share": [f[1] for f in found]})


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from text and lang of documents whose remainder is not 0, of each language those of the least hashes."""
    spark = docs.sparkSession
    shared.bound_batches(spark)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != 0))
    known = known.select("text", "lang", F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(TURNS)).alias("turn"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("turn").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    most = quota(list(sizes.values()), sample)

    def below(bars: dict[str, int]) -> DataFrame:
        return known.join(F.broadcast(spark.createDataFrame(list(bars.items()), "lang string, bar bigint")), "lang").filter("turn <= bar").drop("bar")  # sample languages at most

    # Somewhat more than the quota of each, as numbers are approximate and hashes fall unevenly; then the quota itself.
    turns = defaultdict(list)
    for r in below({v: int(min(1.0, (1.2 * most + 30) / max(n, 1)) * TURNS) for v, n in sizes.items()}).select("lang", "turn").distinct().collect():
        turns[r["lang"]].append(r["turn"])
    chosen = below({v: sorted(t)[:most][-1] for v, t in turns.items()})
    rows = chosen.mapInPandas(features, "lang string, turn bigint, at binary, share binary").groupBy("lang", "turn").agg(F.min(F.struct("at", "share")).alias("f")).select("lang", "turn", "f.at", "f.share").collect()
    rows = sorted(rows, key=lambda r: (r["turn"], r["lang"]))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["share"], np.float32)
    return fit(x, [r["lang"] for r in rows])


def predictor(model: Model, docs: DataFrame):
    """A function of a text column: struct (lang, score, rejected)."""
    shared.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([sent.value.predict(t) for t in texts], columns=["lang", "score", "rejected"])

    return predict


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` without those that are rejected."""
    predict = predictor(model or train(docs), docs)
    found = shared.fresh(docs, "__lang")
    return docs.withColumn(found, predict(F.col("text"))).filter(~F.col(found)["rejected"]).drop(found)


def report(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score, rejected."""
    docs = docs.select("doc_id", "text", "lang")
    found = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), predictor(train(docs), docs)(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))

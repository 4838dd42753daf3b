"""Toxicity by a chain of linear classifiers.

A text's features are its words and the beginnings of its words, hashed, by the
logarithm of their counts. The categories of the chain are kinds of toxic text
that are found in the labelled rows: the toxic ones are parted by what marks
them off from the others, so no list of words is given. Each category has a
logistic regression over the features and over the probabilities of the
categories before it; the last link is the label itself, so the verdict rests
on all earlier ones. In training those probabilities are out-of-fold: each is
given by a model that has not seen the row, as it will be for new texts. Rows
are dealt into folds by a min-hash of their features, so copies and nearly all
near copies are in one fold.

Training takes a bounded sample of labelled rows. Features are counted and
chosen on the executors; the driver gets the chosen features alone, never texts.
Prediction is one pass over the whole texts.

Defined results: a null text, and one without words, has no features and is not
toxic; rows with a null or contradictory label are not learned from; of rows of
one doc_id, one is; with nothing learned all probabilities are 0; repeated rows
each get their own; a very long text is read whole; the input's own columns of
an output's name are kept as name_input.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm import shared
from spindle.llm.shingles import WORD, mix

BITS, STARTS = 22, (4, 5, 6, 7)
#: Labelled rows learned from, characters of each at most, rows that must have a feature, folds.
SAMPLE, SAMPLE_CHARS, LEAST_ROWS, FOLDS = 4000, 200_000, 5, 5
#: Features kept; kinds of toxic text, and how much more frequent in toxic rows a feature that tells kinds apart is.
KEPT, KINDS, MARK = 1500, 3, 4.0
CUTOFF = 0.5
CHAIN = (*(f"kind_{i + 1}" for i in range(KINDS)), "toxic")


class Features(dict):
    """Hashed features by word, all or those kept; forgets all when it has grown to its limit."""

    def __init__(self, kept: np.ndarray | None = None, limit: int = 300_000):
        super().__init__()
        self.kept, self.limit = None if kept is None else set(kept.tolist()), limit

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        keys = [f"={word}", *(f"^{word[:n]}" for n in STARTS if len(word) >= n)]
        ids = (xxhash.xxh32_intdigest(k) & ((1 << BITS) - 1) for k in keys)
        found = self[word] = tuple(i for i in ids if self.kept is None or i in self.kept)
        return found

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct features and log(1 + count) of each."""
        if not text:
            return np.empty(0, np.int64), np.empty(0)
        every = [f for w in WORD.findall(text.lower()) for f in self[w]]
        ids, often = np.unique(np.array(every, np.int64), return_counts=True)
        return ids, np.log1p(often)


@dataclass
class Rows:
    """Sparse rows: features of all, one after another."""

    ids: np.ndarray
    values: np.ndarray
    row: np.ndarray
    n: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * w[self.ids], self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.ids, self.values * g[self.row], width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: Rows, extra: np.ndarray, y: np.ndarray, train: np.ndarray, width: int, steps: int = 60, l2: float = 2e-4, memory: int = 8) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of features, of earlier categories, and bias: the least regularised loss over all rows where ``train``, by L-BFGS."""
    share = train / max(train.sum(), 1)
    shrink = np.append(np.full(width + extra.shape[1], l2), 0.0)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.clip(x.dot(w[:width]) + extra @ w[width:-1] + w[-1], -40, 40)
        g = (sigmoid(z) - y) * share
        return float(share @ (np.logaddexp(0, z) - y * z) + 0.5 * (shrink @ (w * w))), np.concatenate([x.back(g, width), extra.T @ g, [g.sum()]]) + shrink * w

    w = np.zeros(width + extra.shape[1] + 1)
    value, grad = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way, turns = grad.copy(), []
        for s, d, rho in reversed(pairs):
            turns.append(rho * (s @ way))
            way -= turns[-1] * d
        if pairs:
            s, d, rho = pairs[-1]
            way /= rho * (d @ d)
        for (s, d, rho), turn in zip(pairs, reversed(turns), strict=True):
            way += (turn - rho * (d @ way)) * s
        step, down = 1.0, float(grad @ way)
        new_value, new_grad = loss(w - way)
        while new_value > value - 1e-4 * step * down and step > 1e-6:
            step /= 2
            new_value, new_grad = loss(w - step * way)
        s, d = -step * way, new_grad - grad
        if new_value >= value or float(s @ d) <= 1e-14:
            break
        pairs = [*pairs, (s, d, 1 / float(s @ d))][-memory:]
        w, value, grad = w + s, new_value, new_grad
    return w[:width], w[width:-1], float(w[-1])


@dataclass
class Model:
    """By category: weights of the kept features, of earlier categories, bias."""

    kept: np.ndarray
    links: list[tuple[np.ndarray, np.ndarray, float]] = field(default_factory=list)

    def predict(self, ids: np.ndarray, values: np.ndarray) -> list[float]:
        at = np.searchsorted(self.kept, ids)
        at[at == len(self.kept)] = 0
        known = self.kept[at] == ids if len(self.kept) else np.zeros(len(ids), bool)
        at, values, out = at[known], values[known], []
        for w, v, b in self.links:
            out.append(float(sigmoid(np.array(values @ w[at] + np.array(out) @ v + b))) if len(ids) else 0.0)
        return out if self.links else [0.0] * len(CHAIN)


def fold_of(ids: np.ndarray, folds: int = FOLDS) -> int:
    """A row's fold, by the least of its features in a mixed order."""
    return int(mix(ids.astype(np.uint64) + np.uint64(1)).min() % np.uint64(folds)) if len(ids) else 0


def kinds_of(x: Rows, toxic: np.ndarray, width: int, kinds: int = KINDS, rounds: int = 12) -> np.ndarray:
    """Kinds of the toxic rows, a column of 0 and 1 each: spherical k-means over the features that mark toxic rows.

    Begun with the row nearest to the mean, then each time with the row
    farthest from all before; a row without such a feature is of no kind.
    """
    out = np.zeros((x.n, kinds))
    there = np.zeros((x.n, width), bool)
    there[x.row, x.ids] = True
    bad, good = (there[toxic == v].mean(0) if (toxic == v).any() else np.zeros(width) for v in (1, 0))
    marks = np.flatnonzero(bad > MARK * good)
    own = np.flatnonzero((toxic == 1) & there[:, marks].any(1))
    if not len(own):
        return out
    v = there[np.ix_(own, marks)] * np.log((bad[marks] + 1e-4) / (good[marks] + 1e-4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    seeds = [int((v @ v.mean(0)).argmax())]
    while len(seeds) < min(kinds, len(own)):
        seeds.append(int((v @ v[seeds].T).max(1).argmin()))
    centres = v[seeds]
    for _ in range(rounds):
        kind = (v @ centres.T).argmax(1)
        centres = np.stack([v[kind == k].sum(0) if (kind == k).any() else centres[k] for k in range(len(seeds))])
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    out[own, (v @ centres.T).argmax(1)] = 1
    return out


def fit(features: Sequence[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, folds: int = FOLDS) -> Model:
    """The chain over the kinds of toxic rows and the label ``toxic``; ``features`` are the chosen ones of each row."""
    toxic = np.asarray(toxic, float)
    kept = np.unique(np.concatenate([f[0] for f in features])) if len(features) else np.empty(0, np.int64)
    if not len(kept) or not 0 < toxic.sum() < len(toxic):
        return Model(np.empty(0, np.int64))
    row = np.repeat(np.arange(len(features)), [len(f[0]) for f in features])
    x = Rows(np.searchsorted(kept, np.concatenate([f[0] for f in features])), np.concatenate([f[1] for f in features]), row, len(features))
    fold = np.array([fold_of(f[0], folds) for f in features])
    labels = np.column_stack([kinds_of(x, toxic, len(kept)), toxic])
    extra, links = np.zeros((len(features), 0)), []
    for y in labels.T:
        links.append(logistic(x, extra, y, np.ones(len(y)), len(kept)))
        if len(links) < labels.shape[1]:
            out = np.zeros(len(y))
            for k in range(folds):
                w, v, b = logistic(x, extra, y, (fold != k).astype(float), len(kept))
                out = np.where(fold == k, sigmoid(x.dot(w) + extra @ v + b), out)
            extra = np.column_stack([extra, out])
    return Model(kept, links)


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, toxic, text) of at most ``sample`` labelled documents, the same ones in every run."""
    one = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("top")).filter("toxic = top").drop("top")
    n = one.count()
    share = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < int(min(1.0, 1.2 * sample / max(n, 1)) * (1 << 20)) + 1
    chosen = one.filter(share).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.length("text") <= sample_chars)
    both = texts.join(F.broadcast(chosen), "doc_id")  # chosen: at most sample rows
    return both.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("doc_id", "toxic", "t.text")


def chosen_features(rows: DataFrame) -> np.ndarray:
    """The KEPT features whose presence goes furthest with or against the label, by the chi-square of a 2 x 2 table."""

    def counted(batches):
        known = Features()
        for b in batches:
            each = [known.of(t)[0] for t in b["text"]]
            ids = np.concatenate([np.empty(0, np.int64), *each])
            hit = np.repeat(b["toxic"].to_numpy(), [len(e) for e in each])
            ids, at = np.unique(ids, return_inverse=True)
            yield pd.DataFrame({"id": ids, "n": np.bincount(at, minlength=len(ids)), "hit": np.bincount(at, hit, len(ids)).astype(np.int64)})

    whole = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("y")).first()
    n, p = max(whole["n"], 1), (whole["y"] or 0) / max(whole["n"], 1)
    per = rows.mapInPandas(counted, "id bigint, n bigint, hit bigint").groupBy("id").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).filter(F.col("n") >= LEAST_ROWS)
    chi = F.pow(F.col("hit") - F.col("n") * p, 2) / F.greatest(F.col("n") * (1 - F.col("n") / n) * (p * (1 - p)), F.lit(1e-9))
    return np.array(sorted(r["id"] for r in per.orderBy(F.desc(chi), "id").limit(KEPT).collect()), np.int64)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learns from at most ``sample`` labelled documents of at most ``sample_chars`` characters."""
    shared.bound_batches(docs.sparkSession)
    table = shared.written(labelled(docs, labels, sample, sample_chars), "labelled")
    kept = chosen_features(table)

    def features(batches):
        known = Features(kept)
        for b in batches:
            pairs = [known.of(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "ids": [p[0].astype(np.int32).tobytes() for p in pairs], "tf": [p[1].astype(np.float32).tobytes() for p in pairs]})

    rows = sorted(table.mapInPandas(features, "doc_id bigint, toxic int, ids binary, tf binary").collect(), key=lambda r: r["doc_id"])
    shared.drop(table)
    return fit([(np.frombuffer(r["ids"], np.int32).astype(np.int64), np.frombuffer(r["tf"], np.float32).astype(float)) for r in rows], np.array([r["toxic"] for r in rows]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with p_<category> for each of the chain and toxic, true from the cutoff on."""
    shared.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(", ".join(f"p_{c} double" for c in CHAIN))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        known = Features(model.kept)
        for texts in batches:
            yield pd.DataFrame([model.predict(*known.of(t)) for t in texts], columns=[f"p_{c}" for c in CHAIN])

    p = shared.fresh(docs, "p")
    found = shared.make_room(docs.withColumn(p, predict(F.col(text))), *(f"p_{c}" for c in CHAIN), "toxic")
    return found.withColumns({f"p_{c}": F.col(f"{p}.p_{c}") for c in CHAIN} | {"toxic": F.col(f"{p}.p_toxic") >= CUTOFF}).drop(p)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document: doc_id, toxic, and the probability of each category."""
    docs = docs.select("doc_id", "text")
    return score(docs, train(docs, labels)).drop("text")

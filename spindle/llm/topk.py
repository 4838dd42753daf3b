"""Exact top-k by inner product with vector-approximation files.

Every vector is quantised into cells: a whole number of -31 to 31 for each
component, the cells' width (1 at least) and the length of what the cells leave
out. Only these approximations, a byte a component, are sent to the query
blocks. There a scan of the cells bounds each score from above and below (by
Cauchy's inequality over the remainder), and a candidate goes on if its upper
bound reaches the kth lower bound of its block; then all blocks' kth lower
bounds are compared. What is left is read exactly, by a join with the vectors
themselves, in the order of upper bounds: first as many as could be winners,
then those whose bound still reaches the kth exact score. A vector that its
cells give in full needs no reading, as its score is known.

Equal vectors are one candidate with their least ids, so a vector that a third
of all rows hold is sent once.

Defined results: rows whose id or vector is null, or whose vector holds a null
or a component that is not finite, take no part; all others do, however large.
A score beyond a long is the nearest long, and is ranked as that. Vectors of
another length than the query's are no candidates; rows with the query's id are
its own; of repeated query ids the least vector is asked, repeated candidates
each count; ties go to smaller ids. Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spindle.llm import shared

#: Rows of a block of candidates and of queries, queries scanned at once, steps of a component's cells to either side.
CANDIDATE_BLOCK, QUERY_BLOCK, AT_ONCE, STEPS = 32_768, 4096, 32, 31
LONG = 2**63 - 1
#: Components from which a vector's bounds are left open, and sums below which doubles are exact.
GIANT, EXACT = 2.0**480, 2.0**52
CELLS = "vec_id bigint, code bigint, copies int, dim int, width double, rest double, size double, cells binary"
ASKED = "vec_id bigint, code bigint, dim int, v binary"
BOUNDS = "query_id bigint, vec_id bigint, code bigint, copies int, low double, high double, score bigint"


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): whole, finite vectors as doubles, ids as longs."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x")).filter(F.col("x").isNotNull() & good)


def finite(vectors: DataFrame) -> DataFrame:
    """Those of them that have an id."""
    return kept(vectors).filter("vec_id IS NOT NULL")


def floored(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles; whole already where x is large. Beyond doubles it is infinite."""
    with np.errstate(over="ignore"):
        return np.floor(x * scale)


def whole(x: np.ndarray, scale: int) -> list[int]:
    """The same as Python integers, of any size."""
    return [int(c) * scale if abs(c) >= EXACT else math.floor(c * scale) for c in x.tolist()]


def exact(q: np.ndarray, c: np.ndarray, scale: int) -> int:
    """The inner product, kept within a long."""
    a, b = floored(q, scale), floored(c, scale)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(len(a), 1) < EXACT:
        return int(a @ b)
    return max(-LONG - 1, min(LONG, sum(i * j for i, j in zip(whole(q, scale), whole(c, scale), strict=True))))


def approximated(scale: int):
    """Cells of each vector: v = width * cells + a remainder of length ``rest``; ``size`` is the length of v."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x in b["x"]:
                v = floored(np.asarray(x, np.float64), scale)
                top = float(np.abs(v).max(initial=0))
                if top >= GIANT:
                    rows.append((len(v), 1.0, math.inf, math.inf, np.zeros(len(v), np.int8).tobytes()))
                    continue
                width = max(1.0, top / STEPS)
                cells = np.rint(v / width)
                rest = v - cells * width
                rows.append((len(v), width, math.sqrt(float(rest @ rest)), math.sqrt(float(v @ v)), cells.astype(np.int8).tobytes()))
            dim, width, rest, size, cells = zip(*rows, strict=True) if rows else ((),) * 5
            yield pd.DataFrame({"vec_id": b["vec_id"], "code": b["code"], "copies": b["copies"], "dim": dim, "width": width, "rest": rest, "size": size, "cells": cells})

    return run


def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        vs = [np.asarray(x, np.float64) for x in b["x"]]
        yield pd.DataFrame({"vec_id": b["vec_id"], "code": b["code"], "dim": [len(v) for v in vs], "v": [v.tobytes() for v in vs]})


def scan(q: np.ndarray, cells: np.ndarray, width: np.ndarray, rest: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower and upper bounds of every score (queries x candidates), and where both are the score itself."""
    length = np.sqrt((q * q).sum(1))[:, None]
    blank = (length == 0) | (size == 0)
    with np.errstate(over="ignore", invalid="ignore"):
        centre = (q @ cells.T) * width
        # What doubles lose in the sums is less than this share of both lengths.
        off = length * (rest + (q.shape[1] + 16) * 4e-16 * size)
        off = np.where(np.abs(q).max(1, initial=0)[:, None] >= GIANT, np.inf, off)
        sure = blank | ((rest == 0) & (width == 1) & (length * size < EXACT))
        low, high = (np.where(blank, 0.0, np.where(sure, centre, centre + d)) for d in (-off, off))
    return np.clip(low, -(2.0**63), 2.0**63), np.clip(high, -(2.0**63), 2.0**63), sure


def best_of(q_ids: np.ndarray, q: np.ndarray, part: pd.DataFrame, k: int) -> pd.DataFrame:
    """The candidates of a block that its kth lower bound, ties by id, leaves in."""
    part = part.sort_values("vec_id", kind="stable", ignore_index=True)
    ids = part["vec_id"].to_numpy()
    cells = np.frombuffer(b"".join(part["cells"]), np.int8).reshape(len(part), q.shape[1]).astype(np.float64)
    sizes = [part[c].to_numpy(np.float64) for c in ("width", "rest", "size")]
    out = []
    for at in range(0, len(q), AT_ONCE):
        low, high, sure = scan(q[at : at + AT_ONCE], cells, *sizes)
        for i, own in enumerate(q_ids[at : at + AT_ONCE]):
            others = np.flatnonzero(ids != own)
            lo, hi = low[i, others], high[i, others]
            if len(others) > k:
                bar = np.partition(lo, len(lo) - k)[len(lo) - k]
                last = np.flatnonzero(lo == bar)[k - 1 - int((lo > bar).sum())]
                kept = (hi > bar) | ((hi == bar) & (np.arange(len(hi)) <= last))
                others, lo, hi = others[kept], lo[kept], hi[kept]
            out.append((np.full(len(others), own), others, lo, hi, sure[i, others]))
    own, at, lo, hi, known = (np.concatenate(x) for x in zip(*out, strict=True))
    score = pd.array(np.where(known, lo, 0).astype(np.int64), "Int64")
    score[~known] = pd.NA
    return pd.DataFrame({"query_id": own, "vec_id": ids[at], "code": part["code"].to_numpy()[at], "copies": part["copies"].to_numpy()[at], "low": lo, "high": hi, "score": score})


def bounds(q: DataFrame, c: DataFrame, k: int, scale: int, candidate_block: int, query_block: int, n_queries: int, n_candidates: int) -> DataFrame:
    """BOUNDS of all candidates that their block leaves in. ``q`` is ASKED, ``c`` is CELLS."""
    n_q, n_c = max(1, math.ceil(n_queries / query_block)), max(1, math.ceil(n_candidates / candidate_block))

    def dealt(frame: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id", "code"), F.lit(n_own)).cast("int")
        return frame.select("*", block.alias(own), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({n.split()[0]: [] for n in BOUNDS.split(", ")})
        x = np.frombuffer(b"".join(left["v"]), np.float64).reshape(len(left), left["dim"].iloc[0])
        return best_of(left["vec_id"].to_numpy(), np.clip(floored(x, scale), -GIANT, GIANT), right, k)

    keys = ["qb", "cb", "dim"]
    return dealt(q, "qb", n_q, "cb", n_c).groupBy(*keys).cogroup(dealt(c, "cb", n_c, "qb", n_q).groupBy(*keys)).applyInPandas(meet, BOUNDS)


def reaching(rows: DataFrame, value: Column, k: int) -> DataFrame:
    """``rows`` without those that k others of their query, by ``value`` and then id, are surely before."""
    w = Window.partitionBy("query_id").orderBy(F.desc("__value"), "vec_id")
    kth = rows.withColumn("__value", value).filter("__value IS NOT NULL").withColumn("__n", F.row_number().over(w)).filter(F.col("__n") == k)
    kth = kth.select("query_id", F.col("__value").alias("__bar"), F.col("vec_id").alias("__bar_id"))
    high = F.coalesce(F.col("score").cast("double"), F.col("high"))
    level = (high == F.col("__bar")) & ((F.col("vec_id") <= F.col("__bar_id")) | (F.abs("__bar") >= EXACT))  # long scores that are one double may differ
    return rows.join(kth, "query_id", "left").filter(F.col("__bar").isNull() | (high > F.col("__bar")) | level).drop("__bar", "__bar_id")


def read(rows: DataFrame, q: DataFrame, c: DataFrame, scale: int) -> DataFrame:
    """``rows`` with exact scores, from the vectors themselves."""

    @F.pandas_udf("bigint")
    def product(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([exact(np.asarray(x, np.float64), np.asarray(y, np.float64), scale) for x, y in zip(a, b, strict=True)], dtype="int64")

    with_c = rows.join(c.select("vec_id", "code", F.col("x").alias("__c")), ["vec_id", "code"])
    both = with_c.join(q.select(F.col("vec_id").alias("query_id"), F.col("x").alias("__q")), "query_id")
    return both.withColumn("score", product("__q", "__c")).drop("__q", "__c").select(rows.columns)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: int = 64, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products of each query."""
    shared.bound_batches(queries.sparkSession)
    q = shared.written(finite(queries).groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("code", F.xxhash64("x")), "queries")
    c = finite(candidates).groupBy("vec_id", "x").agg(F.count("*").alias("n"))
    # Of equal vectors only the k + 1 least ids can win, as one of them may be the query's own.
    c = c.withColumn("__n", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).filter(F.col("__n") <= k + 1)
    c = shared.written(c.select("vec_id", "x", F.least("n", F.lit(k)).cast("int").alias("copies"), F.xxhash64("x").alias("code")), "vectors")
    cells = c.mapInPandas(approximated(scale), CELLS)
    found = shared.written(bounds(q.mapInPandas(asked, ASKED), cells, k, scale, candidate_block, query_block, q.count(), c.count()), "bounds")
    left = shared.written(reaching(found, F.col("low"), k), "left")
    shared.drop(found)
    if not left.filter("score IS NULL").isEmpty():
        by_bound = Window.partitionBy("query_id").orderBy(F.desc("high"), "vec_id")
        turned = left.withColumn("__first", F.row_number().over(by_bound) <= 2 * k)
        known, now, later = turned.filter("score IS NOT NULL"), turned.filter("__first AND score IS NULL"), turned.filter("NOT __first AND score IS NULL")
        once = shared.written(known.unionByName(read(now, q, c, scale)).unionByName(later), "read")
        rest = reaching(once, F.col("score").cast("double"), k)
        left = rest.filter("score IS NOT NULL").unionByName(read(rest.filter("score IS NULL"), q, c, scale))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = left.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("rank", F.row_number().over(order))
    return each.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    """Rows whose vec_id is divisible by 20 against every other row."""
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    return top_k(rows.filter(F.col("vec_id") % 20 == 0), rows)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

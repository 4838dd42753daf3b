"""Lloyd's rounds with a dual-tree search.

Vectors are dealt in blocks (Arrow batches, so no shuffle); a cover tree is made
once of each block and written with it. In each round a tree over the centroids
meets every block's tree: pairs of nodes go by distance bounds, leaf pairs are
compared exactly. A block gives whole sums of each of its clusters, which
Spark adds up; only a row for each centroid (and, for giant components, a few
more) reaches the driver, and only centroids go out to tasks. A vector that a
third of all rows hold is spread over all blocks, and one leaf within a block.

Everything is whole numbers: sums have no rounding and don't depend on order.

Defined results: rows whose vector is null, has another length, or holds a null
or a component that is not finite, take no part. Rows with a null id are
clustered, but start no centroid. Repeated rows each count, and each may start a
centroid; equal hashes start in the order of their vectors. With fewer rows than
centroids there are fewer centroids; an empty table gives no rows. Ties go to the
centroid of the smaller number. Distances and sums beyond a long are the greatest
long. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm import cover_tree, shared, topk

#: Centroids, rounds, components of a vector, scale of a component.
CENTROIDS, ROUNDS, DIM, SCALE = 16, 3, 64, 64
#: Components up to which distances and a block's sums are exact in 64 bits; bits of a part of a greater sum.
SMALL, LIMB = 2.0**26, 40
BLOCK = "ids array<bigint>, x binary, " + ", ".join(f"`{f}` binary" for f in ("order", "pivot", "radius", "lo", "hi", "first", "last", "roots"))
SUMS = "cluster int, part int, n bigint, looked bigint, sums array<bigint>"
PLACED = "vec_id bigint, cluster int, distance bigint"


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch with its cover tree, as one row."""
    for b in batches:
        if len(b):
            x = np.stack(b["x"].to_numpy()).astype(np.float64)
            tree = cover_tree.build(topk.floored(x, SCALE))
            yield pd.DataFrame([{"ids": [None if pd.isna(i) else int(i) for i in b["vec_id"]], "x": x.tobytes(), **tree.packed()}])


def as_double(n: int) -> float:
    try:
        return float(n)
    except OverflowError:
        return np.inf if n > 0 else -np.inf


class Search:
    """The centroids with their tree, and a block's rows against them."""

    def __init__(self, centroids: list[list[int]]):
        self.whole = centroids
        self.c = np.array([[as_double(n) for n in c] for c in centroids], np.float64).reshape(len(centroids), -1)
        self.small = bool(np.abs(self.c).max(initial=0) < SMALL)
        self.tree = cover_tree.build(self.c)

    def distances(self, x: np.ndarray, v: np.ndarray, rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Exact squared distances of pairs: 64 bits where they hold them, else Python's integers."""
        if self.small and np.abs(v).max(initial=0) < SMALL:
            gap = v[rows].astype(np.int64) - self.c[numbers].astype(np.int64)
            return (gap * gap).sum(1)
        exact = [sum((a - b) ** 2 for a, b in zip(topk.whole(x[i], SCALE), self.whole[j], strict=True)) for i, j in zip(rows, numbers, strict=True)]
        return np.array([*exact, None], object)[:-1]

    def placed(self, row) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """A block's vectors, doubles and floored, the cluster of each, and the pairs of nodes looked at."""
        x = np.frombuffer(row["x"], np.float64).reshape(len(row["ids"]), -1)
        v = topk.floored(x, SCALE)
        found, looked = cover_tree.nearest(v, cover_tree.Tree.unpacked(row), self.c, self.tree, lambda rows, numbers: self.distances(x, v, rows, numbers))
        return x, v, found, looked


def parts(total: int) -> list[int]:
    """A whole number as parts of LIMB bits, the last with its sign; one part where a long holds it."""
    if abs(total) < 2**62:
        return [total]
    out = []
    while not -(2**LIMB) <= total < 2**LIMB:
        total, low = divmod(total, 2**LIMB)
        out.append(low)
    return [*out, total]


def summed(search: Search) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                x, v, found, looked = search.placed(row)
                rows = []
                for k in np.unique(found).tolist():
                    own = found == k
                    if np.abs(v[own]).max(initial=0) < SMALL:
                        whole = [[int(s)] for s in v[own].astype(np.int64).sum(0)]
                    else:
                        whole = [parts(sum(c)) for c in zip(*(topk.whole(one, SCALE) for one in x[own]), strict=True)]
                    rows += [(k, p, int(own.sum()) * (p == 0), looked * (p == 0 and not rows), [s[p] if p < len(s) else 0 for s in whole]) for p in range(max(map(len, whole)))]
                yield pd.DataFrame(rows, columns=["cluster", "part", "n", "looked", "sums"])

    return run


def assigned(search: Search) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                x, v, found, _ = search.placed(row)
                d = np.minimum(search.distances(x, v, np.arange(len(v)), found), topk.LONG).astype(np.int64)
                yield pd.DataFrame({"vec_id": pd.array([None if i is None or i != i else int(i) for i in row["ids"]], "Int64"), "cluster": found.astype(np.int32), "distance": d})

    return run


def start(rows: DataFrame, k: int) -> list[list[int]]:
    """The first centroids: a row each of the k smallest hashes."""
    hashed = rows.filter("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), "x")
    return [topk.whole(np.array(r["x"], np.float64), SCALE) for r in hashed.orderBy("h", "x").limit(k).collect()]


def moved(trees: DataFrame, centroids: list[list[int]], dim: int) -> tuple[list[list[int]], int]:
    """The centroids after a round, and the pairs of nodes it looked at."""
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    rows = trees.mapInPandas(summed(Search(centroids)), SUMS).groupBy("cluster", "part").agg(F.sum("n").alias("n"), F.sum("looked").alias("looked"), *sums).collect()
    out, looked = list(centroids), sum(r["looked"] for r in rows)
    for k in {r["cluster"] for r in rows}:
        own = [r for r in rows if r["cluster"] == k]
        n = sum(r["n"] for r in own)
        out[k] = [sum(int(r[f"s{i}"]) << (LIMB * r["part"]) for r in own) // n for i in range(dim)]
    return out, looked


def clustered(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM) -> tuple[DataFrame, list[list[int]], list[int]]:
    """(vec_id, cluster, distance) of every vector kept, the final centroids, and the pairs of nodes that each round looked at."""
    shared.bound_batches(embeddings.sparkSession)
    rows = topk.kept(embeddings).filter(F.size("x") == dim)
    centroids, looked = start(rows, k), []
    if not centroids:
        return embeddings.sparkSession.createDataFrame([], PLACED), [], []
    trees = shared.written(rows.mapInPandas(blocks, BLOCK), "trees")
    for _ in range(rounds):
        centroids, n = moved(trees, centroids, dim)
        looked.append(n)
    return trees.mapInPandas(assigned(Search(centroids)), PLACED), centroids, looked


def report(embeddings: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector kept."""
    found, centroids, _ = clustered(embeddings)
    found = shared.written(found, "clusters")
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    by_cluster = F.array(*(F.lit(min(sums.get(i, 0), topk.LONG)).cast("bigint") for i in range(max(1, len(centroids)))))
    hashes = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids or [[]]))
    total = F.lit(min(sum(sums.values()), topk.LONG)).cast("bigint")
    return found.select("*", by_cluster[F.col("cluster")].alias("cluster_inertia"), total.alias("inertia"), hashes[F.col("cluster")].alias("centroid_sha256"))


def _oracle() -> str:
    """DuckDB SQL: every distance to every centroid, three rounds and once more."""
    names = []

    def assign(r: int) -> str:
        return f"""d{r} AS (SELECT vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM e CROSS JOIN c{r}),
a{r} AS (SELECT vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM d{r} GROUP BY vec_id, v)"""

    for r in range(ROUNDS):
        names.append(assign(r))
        names.append(f"""u{r} AS (SELECT cluster, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m FROM a{r}, (SELECT unnest(range(1, {DIM + 1})) AS i) GROUP BY cluster, i),
m{r} AS (SELECT cluster, list(m ORDER BY i) AS c FROM u{r} GROUP BY cluster),
c{r + 1} AS (SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))""")
    rounds = ",\n".join([*names, assign(ROUNDS)])
    return f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c FROM e
  WHERE vec_id IS NOT NULL QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= {CENTROIDS}),
{rounds}
SELECT vec_id, a{ROUNDS}.cluster AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY a{ROUNDS}.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (cluster)"""


ORACLE = _oracle()

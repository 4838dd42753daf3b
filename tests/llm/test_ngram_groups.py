"""Groups of chained sets are parted, and no link is lost by it."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_corpus import brute_classes, near_copies

from spindle.llm import ngram_join


def chained(n):
    """Texts each of which shares two thirds of its words with the next, so that buckets chain them."""
    return [" ".join(f"w{j}" for j in range(30 * i, 30 * i + 90)) for i in range(n)]


def test_a_chain_is_parted_and_links_stay(spark):
    rng = random.Random(8)
    texts = chained(400)
    for _ in range(12):
        texts += near_copies(rng, rng.choice(texts[:400]).split(), 3, 1)
    near = [f"n{i}" for i in range(90)]
    texts += near_copies(rng, near, 60, 2)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    want = sorted((i, *c) for (i, _), c in zip(rows, brute_classes(rows), strict=True))
    for options in ({"loose": 8, "bucket_block": 16, "crowd": 32}, {"loose": 8}):
        got = ngram_join.classes(docs, **options).collect()
        assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want


def test_groups_of_a_chain_do_not_grow_with_it(spark):
    largest = {}
    for n in (300, 1200):
        docs = spark.createDataFrame(list(enumerate(chained(n))), "doc_id bigint, text string")
        sets = docs.withColumn("hash", F.unhex(F.sha2("text", 256))).mapInPandas(ngram_join.sign, ngram_join.SETS)
        whole = Counter(r["root"] for r in ngram_join.groups_of(sets, loose=10**9).collect())
        fine = Counter(r["root"] for r in ngram_join.groups_of(sets, loose=8).collect())
        largest[n] = (max(whole.values()), max(fine.values(), default=0))
    assert largest[1200][0] > 20 and largest[1200][1] <= 8, largest


def test_only_sets_with_a_pair_left_are_compared_by_text(spark):
    """Of 400 chained texts and three near copies, near copies alone go on, as one group; a group above ``loose`` stays as it is."""
    rows = [*enumerate(chained(400)), *((1000 + i, t) for i, t in enumerate(near_copies(random.Random(3), [f"n{i}" for i in range(200)], 3, 1)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = docs.withColumn("hash", F.unhex(F.sha2("text", 256))).mapInPandas(ngram_join.sign, ngram_join.SETS)
    kinds = sets.select("key", "doc_id", "hash", "n", "sig", F.lit(1).cast("bigint").alias("copies"))
    groups = ngram_join.groups_of(kinds)
    ids = {bytes(r["key"]): r["doc_id"] for r in kinds.collect()}
    kept = ngram_join.members(kinds, groups, 0.8, 1e-5, ngram_join.LOOSE).collect()
    near = [r for r in kept if ids[bytes(r["key"])] >= 1000]
    assert len(near) == 3 and len({bytes(r["root"]) for r in near}) == 1 and len(kept) <= 3 + 8
    assert groups.count() > 100 and ngram_join.members(kinds, groups, 0.8, 1e-5, 1).count() == groups.count()

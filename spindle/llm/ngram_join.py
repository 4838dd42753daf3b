"""N-gram Jaccard self-join: MinHash, Bayesian pruning, exact verification.

1. Every text gives its set of five-word shingles, a key of the set and a
   MinHash signature. Texts with one set are copies and go on as one.
2. Bands of the signature tie sets that may be similar to the least set of
   their bucket; components of these ties are groups. Passages that many texts
   share chain unlike sets into one group, so a group of more than LOOSE sets is
   parted: within each of its buckets the sets' MinHash values are compared, a
   byte of each, and only pairs that outlive the pruning tie. Buckets of more
   than CROWD sets are parted by a second band first. Buckets and groups move as
   rows, nothing is collected.
3. A group's signatures, without texts, meet in one task. There every pair's
   MinHash values are compared a few at a time, and a pair goes when, for what was
   seen so far, the posterior probability of its similarity reaching the threshold
   falls below the tolerance. Sets without a pair left need no text; pairs that are
   left tie the others to smaller groups.
4. These groups' sets are dealt into blocks of bounded size, and texts are sent for
   them alone; two blocks meet in one task, where pairs that outlive the pruning are
   counted exactly, on shingle sets.
5. Tasks give back, per set, its number of links and a spanning tie, never
   pairs, so the rows stay in proportion to the input.

Two texts of similarity 0.8 miss each other in all 32 bands of 4 with a
probability of 5e-8, and are pruned with one below the tolerance, 1e-5; of two in
a crowded bucket, a second band in common is missed with one of about 1e-5.

Defined results: null texts and texts without a word link to nothing and are
classes of their own; copies (also repeated rows) link to each other; a class
is named by its least doc_id, null ids coming last; a very long text is read
whole; other columns of the input are not read, and kept by keep_first.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm import shared
from spindle.llm import shingles as S

THRESHOLD, TOLERANCE, CHUNK = 0.8, 1e-5, 16
#: A block: sets, and shingles in all of them.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1_000_000
#: Sets of a group from which it is parted, of a bucket's block then, and of a bucket from which a second band parts it, one of the next NEXT.
LOOSE, BUCKET_BLOCK, CROWD, NEXT = 2048, 1024, 16_384, 8
#: Sets of a group for each task that the lookup of its blocks is spread over.
SPREAD = 10_000
SETS = "doc_id bigint, hash binary, key binary, n int, sig binary"
LINKS = "key binary, links bigint, texts bigint, root binary, whole boolean"
MEMBER = "key binary, root binary, copies bigint, hash binary, n int, sig binary"


def sign(batches):
    known = S.WordHashes()
    for b in batches:
        found = [S.shingle_set(t, known) for t in b["text"]]
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "hash": b["hash"], "key": [S.set_key(u) for u in found], "n": [len(u) for u in found], "sig": [S.signature(u).tobytes() if len(u) else None for u in found]})


def posterior(matches: int, seen: int, threshold: float) -> float:
    """P(similarity >= threshold) after so many matches, from a uniform prior (a Beta distribution's tail)."""
    n = seen + 1
    return sum(comb(n, j) * threshold**j * (1 - threshold) ** (n - j) for j in range(matches + 1))


def least_matches(threshold: float, tolerance: float, chunk: int = CHUNK, hashes: int = S.HASHES) -> list[tuple[int, int]]:
    """(values seen, matches needed to go on) after each chunk."""
    return [(seen, next(m for m in range(seen + 1) if posterior(m, seen, threshold) >= tolerance)) for seen in range(chunk, hashes + 1, chunk)]


def pruned(sigs: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, needed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of an index of left and one of right, i < j where both are one block) that outlive the pruning."""
    one, kept_a, kept_b = left is right, [], []
    for at, i in enumerate(left):
        others = right[at + 1 :] if one else right
        n = sizes[others]
        others = others[np.minimum(n, sizes[i]) >= threshold * np.maximum(n, sizes[i]) - 1e-9]
        matches, start = np.zeros(len(others), np.int64), 0
        for seen, least in needed:
            if not len(others):
                break
            matches = matches + (sigs[others, start:seen] == sigs[i, start:seen]).sum(1)
            others, matches, start = others[matches >= least], matches[matches >= least], seen
        kept_a.append(np.full(len(others), i))
        kept_b.append(others)
    return np.concatenate([np.empty(0, np.int64), *kept_a]), np.concatenate([np.empty(0, np.int64), *kept_b])


def shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the given pairs."""
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, cols, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows, cols = rows[often[cols] > 1], cols[often[cols] > 1]  # what one set alone has is in no intersection
    _, cols = np.unique(cols, return_inverse=True)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    total = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers below 2^24
    for start in range(0, int(cols[-1]) + 1 if len(cols) else 0, 4096):
        lo, hi = np.searchsorted(cols, [start, start + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[rows[lo:hi], cols[lo:hi] - start] = 1
        total += m @ m.T
    return np.rint(total[a, b]).astype(np.int64)


def tied(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each one's component."""
    label = np.arange(n)
    while len(a):
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def linker(threshold: float, tolerance: float):
    needed = least_matches(threshold, tolerance)

    def link(part: pd.DataFrame) -> pd.DataFrame:
        out, known = [], S.WordHashes()
        for _, rows in part.groupby("root", sort=False):
            sets = [S.shingle_set(t, known) for t in rows["text"]]
            rows = rows.assign(at=range(len(rows))).sort_values("key").reset_index(drop=True)
            sets = [sets[i] for i in rows["at"]]
            if len(sets) < 2:
                continue
            sigs = np.stack([np.frombuffer(s, np.uint32) for s in rows["sig"]])
            sizes, copies = np.array([len(u) for u in sets]), rows["copies"].to_numpy()
            block, i, j = rows["block"].to_numpy(), int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
            left = np.flatnonzero(block == i)
            a, b = pruned(sigs, sizes, left, left if i == j else np.flatnonzero(block == j), threshold, needed)
            if not len(a):
                continue
            both = shared_counts(sets, a, b)
            good = both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9
            a, b = a[good], b[good]
            links, texts = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            for x, y in ((a, b), (b, a)):
                np.add.at(links, x, copies[y])
                np.add.at(texts, x, 1)
            root = tied(len(sets), a, b)
            at = np.flatnonzero(texts)
            out.append(pd.DataFrame({"key": rows["key"].to_numpy()[at], "links": links[at], "texts": texts[at], "root": rows["key"].to_numpy()[root[at]], "whole": rows["blocks"].to_numpy()[at] == 1}))
        return pd.concat(out) if out else pd.DataFrame({"key": [], "links": np.empty(0, np.int64), "texts": np.empty(0, np.int64), "root": [], "whole": np.empty(0, bool)})

    return link


def bands_of(sig: Column) -> Column:
    width = 4 * S.ROWS
    return F.transform(F.sequence(F.lit(0), F.lit(S.HASHES // S.ROWS - 1)), lambda i: F.xxhash64(i, F.substring(sig, i * width + 1, F.lit(width))))


def thinned(batches):
    """A byte of each MinHash value."""
    for b in batches:
        yield pd.DataFrame({"key": b["key"], "n": b["n"], "bands": b["bands"], "sig": [(np.frombuffer(s, np.uint32) & np.uint32(255)).astype(np.uint8).tobytes() for s in b["sig"]]})


def tier(threshold: float, tolerance: float):
    """Ties of a bundle of buckets, or of two blocks of a large one: a spanning forest of the pairs that outlive the pruning."""
    needed = least_matches(threshold, tolerance)

    def ties(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["bucket", "key"], ignore_index=True)
        sigs = np.frombuffer(b"".join(part["sig"]), np.uint8).reshape(len(part), -1)
        sizes, keys, block, buckets = part["n"].to_numpy(), part["key"].to_numpy(), part["block"].to_numpy(), part["bucket"].to_numpy()
        i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
        edges = np.flatnonzero(np.diff(buckets)) + 1
        froms, tos = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo, hi in zip([0, *edges], [*edges, len(part)], strict=True):
            left = lo + np.flatnonzero(block[lo:hi] == i)
            a, b = pruned(sigs, sizes, left, left if i == j else lo + np.flatnonzero(block[lo:hi] == j), threshold, needed)
            if len(a):
                root = lo + tied(hi - lo, a - lo, b - lo)
                at = np.flatnonzero(root != np.arange(lo, hi))
                froms.append(lo + at)
                tos.append(root[at])
        return pd.DataFrame({"a": keys[np.concatenate(froms)], "b": keys[np.concatenate(tos)]})

    return ties


def parted(sets: DataFrame, threshold: float, tolerance: float, bucket_block: int, crowd: int) -> DataFrame:
    """(node, root) of ``sets`` (key, n, sig) that pairs which outlive the pruning tie, by way of the buckets they share."""
    thin = sets.select("key", "n", "sig", bands_of(F.col("sig")).alias("bands")).mapInPandas(thinned, "key binary, n int, bands array<bigint>, sig binary")
    rows = thin.select("key", "n", "sig", "bands", F.posexplode("bands").alias("at", "bucket"))
    sized = lambda r: r.join(r.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"), "bucket")
    first = sized(rows)
    near = F.transform(F.sequence(F.lit(1), F.lit(NEXT)), lambda d: F.xxhash64("bucket", F.get("bands", (F.col("at") + d) % (S.HASHES // S.ROWS))))
    again = sized(first.filter(F.col("m") > crowd).select("key", "n", "sig", F.explode(near).alias("bucket")))
    every = shared.written(first.filter(F.col("m") <= crowd).select("bucket", "key", "n", "sig", "m").unionByName(again.select("bucket", "key", "n", "sig", "m")), "buckets")
    blocks = F.ceil(F.col("m") / bucket_block).cast("int")
    dealt = every.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    bundles = max(1, every.count() // (4 * bucket_block))
    bundle = F.when(blocks == 1, F.pmod(F.xxhash64("bucket"), F.lit(bundles))).otherwise(F.xxhash64("bucket", "i", "j"))
    big = F.when(blocks > 1, F.col("bucket"))
    ties = dealt.withColumns({"bundle": bundle, "big": big}).groupBy("bundle", "big", "i", "j").applyInPandas(tier(threshold, tolerance), "a binary, b binary")
    found = shared.components(ties)
    shared.drop(every)
    return found


def groups_of(kinds: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, loose: int = LOOSE, bucket_block: int = BUCKET_BLOCK, crowd: int = CROWD) -> DataFrame:
    """(node, root) of the sets of ``kinds`` (key, n, sig) that may link: pairs are compared within a root."""
    rows = kinds.select("key", F.explode(bands_of(F.col("sig"))).alias("band"))
    leads = rows.groupBy("band").agg(F.min("key").alias("lead"), F.count("*").alias("size")).filter("size > 1").select("band", "lead")
    groups = shared.written(shared.components(rows.join(leads, "band").select(F.col("key").alias("a"), F.col("lead").alias("b"))), "groups")
    large = shared.written(groups.groupBy("root").agg(F.count("*").alias("m")).filter(F.col("m") > loose).select("root"), "large")
    if large.isEmpty():
        return groups
    inside = groups.join(large, "root", "left_semi").select(F.col("node").alias("key"))
    new = parted(kinds.select("key", "n", "sig").join(inside, "key"), threshold, tolerance, bucket_block, crowd)
    return shared.written(groups.join(large, "root", "left_anti").select("node", "root").unionByName(new), "groups")


def survivor(threshold: float, tolerance: float):
    """Of a bundle of whole groups, the sets with a pair that outlives the pruning, in the groups that such pairs tie."""
    needed = least_matches(threshold, tolerance)

    def alive(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["root", "key"], ignore_index=True)
        sigs = np.frombuffer(b"".join(part["sig"]), np.uint32).reshape(len(part), -1)
        sizes, keys, roots = part["n"].to_numpy(), part["key"].to_numpy(), part["root"].to_numpy()
        edges = np.flatnonzero(roots[1:] != roots[:-1]) + 1
        root, kept = np.arange(len(part)), np.zeros(len(part), bool)
        for lo, hi in zip([0, *edges], [*edges, len(part)], strict=True):
            at = np.arange(lo, hi)
            a, b = pruned(sigs, sizes, at, at, threshold, needed)
            kept[a] = kept[b] = True
            root[lo:hi] = lo + tied(hi - lo, a - lo, b - lo)
        return part.assign(root=keys[root])[kept]

    return alive


def members(kinds: DataFrame, groups: DataFrame, threshold: float, tolerance: float, loose: int) -> DataFrame:
    """(key, root, copies, hash, n, sig) of the sets whose texts are to be compared, by group.

    Groups of up to ``loose`` sets are looked at whole, by signatures alone;
    larger ones stay as pairs that outlive the pruning have tied them.
    """
    large = shared.written(groups.groupBy("root").agg(F.count("*").alias("m")).filter(F.col("m") > loose).select("root"), "large")
    rows = lambda how: groups.join(large, "root", how).withColumnRenamed("node", "key").join(kinds, "key").select("key", "root", "copies", "hash", "n", "sig")
    bundles = max(1, groups.count() // (4 * BUCKET_BLOCK))
    bundle = F.pmod(F.xxhash64("root"), F.lit(bundles))
    return rows("left_anti").groupBy(bundle).applyInPandas(survivor(threshold, tolerance), MEMBER).unionByName(rows("left_semi"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES, **grouping: int) -> DataFrame:
    """(doc_id, hash, key, root, class_id, n_links, n_link_texts), a row for each of ``docs`` (doc_id, text).

    hash is the text's SHA-256; key names the shingle set and root the class, by the
    key of one of its sets, both null if the set is empty; n_links counts documents of
    similarity ``threshold`` or more, copies included; n_link_texts counts sets.
    """
    shared.bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    hashed = docs.withColumn("hash", F.unhex(F.sha2("text", 256)))
    sets = shared.written(hashed.mapInPandas(sign, SETS), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "n", "sig")).alias("m")
    kinds = shared.written(sets.filter(F.col("key").isNotNull()).groupBy("key").agg(first, F.count("*").alias("copies")).select("key", "copies", "m.doc_id", "m.hash", "m.n", "m.sig"), "kinds")
    groups = groups_of(kinds, threshold, tolerance, **grouping)
    alive = shared.written(members(kinds, groups, threshold, tolerance, grouping.get("loose", LOOSE)), "alive")
    # Blocks of a group are counted by its sets and its shingles. Only groups of
    # several blocks are looked up, over salts, as one may hold a third of all sets.
    sizes = shared.written(alive.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("all_n")), "sizes")
    blocks = F.greatest(F.ceil(F.col("m") / block_sets), F.ceil(F.col("all_n") / block_shingles))
    blocks = F.least(F.col("m"), blocks).cast("int").alias("blocks")
    salts = max(1, (sizes.agg(F.max("m")).first()[0] or 0) // SPREAD)
    several = sizes.select("root", blocks).filter("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    member = alive.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).join(several, ["root", "salt"], "left")
    member = shared.written(member.select("key", "root", "copies", "hash", "n", "sig", F.coalesce("blocks", F.lit(1)).alias("blocks")), "members")
    small = member.filter("blocks = 1").agg(F.sum("n")).first()[0] or 0
    bundles = max(1, small // (block_shingles // 4))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = member.withColumn("block", own).select("*", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    bundle = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bundles))).otherwise(F.xxhash64("root", "i", "j"))
    dealt = dealt.select("key", "root", "copies", "hash", "sig", "blocks", "block", "i", "j", bundle.alias("bundle"), F.when(F.col("blocks") > 1, F.col("root")).alias("big"))
    # Equal texts are put together before they are sent, and go by their hash: an id may be null or stand for many texts.
    texts = hashed.groupBy("hash").agg(F.first("text").alias("text")).join(dealt, "hash")
    links = shared.written(texts.groupBy("bundle", "big", "i", "j").applyInPandas(linker(threshold, tolerance), LINKS), "links")
    shared.drop(member, alive, sizes, groups)
    counts = links.groupBy("key").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"), F.min("root").alias("root"), F.min("whole").alias("whole"))
    roots = shared.components(links.filter("NOT whole").select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "key", "root": "far"})
    linked = counts.join(roots, "key", "left").select("key", "links", "texts", F.coalesce("far", "root").alias("root"))
    each = kinds.select("key", "copies", "doc_id").join(linked, "key", "left").select("key", "copies", "doc_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("root", "key").alias("root"))
    names = each.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = each.join(names, "root").select("key", "root", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("texts").alias("n_link_texts"))
    worded = sets.filter("key IS NOT NULL").select("doc_id", "hash", "key").join(named, "key").select("doc_id", "hash", "key", "root", "class_id", "n_links", "n_link_texts")
    wordless = sets.filter("key IS NULL").select("doc_id", "hash", "key", F.lit(None).cast("binary").alias("root"), F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(0).cast("bigint").alias("n_link_texts"))
    return worded.unionByName(wordless)


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id, set key and text hash, null ids coming last.

    Texts without a word are classes of their own and stay; of those with one
    doc_id and text, one stays.
    """
    found = classes(docs, **options)
    first = found.filter("key IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "hash")).alias("m")).select("m.doc_id", "m.hash", F.lit(False).alias("__alone"))
    alone = found.filter("key IS NULL").select("doc_id", "hash").distinct().select("doc_id", "hash", F.col("doc_id").isNull().alias("__alone"))
    own_id, own_hash, kept_id, kept_hash, alone_, turn = (shared.fresh(docs, c) for c in ("__id", "__hash", "__kept_id", "__kept_hash", "__alone", "__turn"))
    kept = first.unionByName(alone).withColumnsRenamed({"doc_id": kept_id, "hash": kept_hash, "__alone": alone_})
    rows = docs.withColumns({own_id: F.col("doc_id").cast("bigint"), own_hash: F.unhex(F.sha2("text", 256))})
    rows = rows.join(kept, F.col(own_id).eqNullSafe(F.col(kept_id)) & F.col(own_hash).eqNullSafe(F.col(kept_hash)))
    # Equal rows are one, but for those without an id and a word, of which each stays.
    rows = rows.withColumn(turn, F.when(F.col(alone_), F.monotonically_increasing_id()).otherwise(0))
    return rows.dropDuplicates([own_id, own_hash, turn]).select(docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, class_id, n_links, n_link_texts."""
    return classes(docs).drop("hash", "key", "root")


#: All pairs that share a shingle, counted exactly; classes are what links reach.
ORACLE = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS words FROM documents
), shingles AS (
  SELECT DISTINCT row_id, array_to_string(words[pos:(pos + 4)], ' ') AS shingle
  FROM (SELECT row_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS pos FROM texts WHERE len(words) > 0)
), keyed AS (
  SELECT row_id, md5(string_agg(shingle, '|' ORDER BY shingle)) AS key, count(*) AS n FROM shingles GROUP BY row_id
), kinds AS (
  SELECT key, min(row_id) AS row_id, min(doc_id) AS first_id, any_value(n) AS n, count(*) AS copies
  FROM keyed JOIN texts USING (row_id) GROUP BY key
), kind_shingles AS (
  SELECT key, n, shingle FROM kinds JOIN shingles USING (row_id)
), links AS (
  SELECT a.key AS a, b.key AS b FROM kind_shingles a JOIN kind_shingles b USING (shingle)
  WHERE a.key <> b.key AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)
  GROUP BY ALL HAVING 10 * count(*) >= 8 * (any_value(a.n) + any_value(b.n) - count(*))
), reached AS (
  SELECT key AS a, key AS b FROM kinds
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), named AS (
  SELECT a AS key, min(first_id) AS class_id FROM reached JOIN kinds ON kinds.key = b GROUP BY a
), counted AS (
  SELECT k.key, any_value(k.copies) - 1 + coalesce(sum(o.copies), 0) AS n_links, count(o.key) AS n_link_texts
  FROM kinds k LEFT JOIN links l ON l.a = k.key LEFT JOIN kinds o ON o.key = l.b GROUP BY k.key
)
SELECT doc_id, CASE WHEN key IS NULL THEN doc_id ELSE class_id END AS class_id,
  CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(n_link_texts, 0) AS BIGINT) AS n_link_texts
FROM texts LEFT JOIN keyed USING (row_id) LEFT JOIN named USING (key) LEFT JOIN counted USING (key)
"""

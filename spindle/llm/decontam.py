"""Benchmark decontamination by SimHash over item-sized windows.

A benchmark item of L words is looked for in every window of L words of every
text. A window that holds no shingle of an item of its size has a similarity of
0 with all of them, so only windows around such a shingle are fingerprinted. A
fingerprint is a 128-bit SimHash of the window's shingles; a shingle's second
occurrence is a feature of its own, so the cosine follows the weighted Jaccard
similarity. It is searched in a multi-index of the items' fingerprints: 16
blocks of 8 bits, and for each block and byte the list of items whose byte is
within 2 bits, with 3, 2 or 1 points for 0, 1 or 2. Two fingerprints within the
radius of 35 share 16 * 3 - 35 = 13 points at least, so no item within the radius
is missed; two of unlike windows have 3 on average, and 13 about once in 100,000.
The candidates' weighted Jaccard similarity is then computed exactly.

A pair of similarity 0.8 lies beyond the radius with a probability of about
6e-5 (mean 19.4, standard deviation 4.1 bits); exact copies never do.

The items are dealt into parts of bounded bytes, each of which is sent to the
executors for a pass of its own over the texts. An item takes some 2.5 KB of the
index, and 12 bytes for each of its shingles.

Defined results: null texts and texts without five words hold nothing; items
without five words or with a null text take no part, as one word would be in
nearly every text; a text shorter than an item is one window; very long texts are
read whole; repeated rows each give their own result; other columns of the input,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm import shared
from spindle.llm import shingles as S
from spindle.llm.shingles import mix

THRESHOLD, BITS, BLOCKS, RADIUS = 0.8, 128, 16, 35
#: Bytes of item texts sent to the executors at once; window starts fingerprinted at once; points counted at once.
PART_BYTES, STARTS, POINTS = 16_000_000, 4096, 1 << 20
#: Points of a block by the bits its bytes differ in, and those that two fingerprints within the radius share at least.
WORTH, LEAST = RADIUS // BLOCKS + 1, (RADIUS // BLOCKS + 1) * BLOCKS - RADIUS
FOUND = "array<struct<item_id:bigint,start_word:int,n_words:int,similarity:double,hamming:int>>"
ONES = np.array([bin(a).count("1") for a in range(256)], np.uint8)
#: What a byte may differ by and still give points.
NEAR = np.flatnonzero(ONES < WORTH).astype(np.uint8)


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array that is not empty."""
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def signs(hashes: np.ndarray) -> np.ndarray:
    """A row of -1 and 1 by bit for each shingle."""
    wide = np.stack([hashes, mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))], 1)
    return np.unpackbits(wide.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def occurrences(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each shingle, how often it is in the n shingles that end with it, and in those that begin with it."""
    _, group = np.unique(hashes, return_inverse=True)
    at = np.arange(len(hashes), dtype=np.int64)
    key = group.astype(np.int64) * (2 * len(hashes) + n) + at
    order = np.argsort(key)
    place, key = np.empty_like(at), key[order]
    place[order] = at
    own = key[place]
    return place - np.searchsorted(key, own - n + 1) + 1, np.searchsorted(key, own + n) - place


def simhash(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the windows of n shingles at ``starts``, as 16 bytes each."""
    lo, hi = int(starts[0]), int(starts[-1]) + n
    own = hashes[lo:hi]
    enter, leave = signs(own), None
    if len(np.unique(own)) < len(own):
        # A window's nth occurrence of a shingle comes with its last one and goes with its first.
        last, first = occurrences(own, n)
        salt = np.uint64(0x9E3779B97F4A7C15)
        leave = signs(np.where(first > 1, mix(own + first.astype(np.uint64) * salt), own))
        enter = signs(np.where(last > 1, mix(own + last.astype(np.uint64) * salt), own))
    leave = enter if leave is None else leave
    total = np.empty((hi - lo - n + 1, BITS), np.int32)
    total[0] = enter[:n].sum(0, dtype=np.int32)
    if len(total) > 1:
        np.cumsum(enter[n:].astype(np.int32) - leave[: hi - lo - n], axis=0, out=total[1:])
        total[1:] += total[0]
    return np.packbits(total[starts - lo] > 0, axis=1)


def lists(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inverted lists of a block's bytes: where each of the 256 begins, and item * 4 + points of all."""
    byte = (prints[:, None] ^ NEAR).ravel()
    entry = (np.arange(len(prints), dtype=np.int32)[:, None] * 4 + (WORTH - ONES[NEAR]).astype(np.int32)).ravel()
    order = np.argsort(byte, kind="stable")
    return np.searchsorted(byte[order], np.arange(257)), entry[order]


class Items:
    """The index of a part of the benchmark."""

    def __init__(self, rows: list[tuple[int, str]]):
        known = S.WordHashes()
        self.by_size: dict[int, dict] = {}
        sized: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, text in rows:
            words = S.word_hashes(text, known)
            if len(words) >= S.SIZE:
                h = S.shingles(words)
                sized.setdefault(len(h), []).append((item, h))
        for n, items in sized.items():
            prints = np.concatenate([simhash(h, np.zeros(1, np.int64), n) for _, h in items])
            counts = [np.unique(h, return_counts=True) for _, h in items]
            self.by_size[n] = {"ids": [i for i, _ in items], "counts": [(h, k.astype(np.int32)) for h, k in counts], "prints": prints, "lists": [lists(prints[:, b]) for b in range(BLOCKS)], "shingles": np.unique(np.concatenate([h for _, h in items]))}
        every = np.unique(np.concatenate([c["shingles"] for c in self.by_size.values()])) if sized else np.empty(0, np.uint64)
        self.every, self.bloom = every, np.zeros(1 << 20, bool)
        self.bloom[every & np.uint64((1 << 20) - 1)] = True

    def find(self, words: np.ndarray, threshold: float = THRESHOLD) -> list[dict]:
        """The best window of each item that one reaches the threshold with, first of equals."""
        if len(words) < S.SIZE or not len(self.every):
            return []
        h = S.shingles(words)
        hits = np.flatnonzero(self.bloom[h & np.uint64((1 << 20) - 1)])
        hits = hits[among(h[hits], self.every)]
        best: dict[int, dict] = {}
        if len(hits):
            for size, items in self.by_size.items():
                own = hits[among(h[hits], items["shingles"])]
                if len(own):
                    self._windows(h, own, size, items, threshold, best)
        return [best[i] for i in sorted(best)]

    @staticmethod
    def _windows(h: np.ndarray, hits: np.ndarray, size: int, items: dict, threshold: float, best: dict) -> None:
        n = min(size, len(h))
        marks = np.zeros(len(h) - n + 2, np.int64)  # windows with a hit, as a sum of starts and ends
        np.add.at(marks, np.maximum(hits - n + 1, 0), 1)
        np.add.at(marks, np.minimum(hits, len(h) - n) + 1, -1)
        starts = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        chunk = max(1, min(STARTS, POINTS // len(items["ids"])))
        for at in range(0, len(starts), chunk):
            own = starts[at : at + chunk]
            for run in np.split(own, np.flatnonzero(np.diff(own) > n) + 1):
                prints = simhash(h, run, n)
                w, i = Items.candidates(prints, items)
                apart = ONES[prints[w] ^ items["prints"][i]].sum(1)
                for w_at, item, bits in zip(w[apart <= RADIUS], i[apart <= RADIUS], apart[apart <= RADIUS], strict=True):
                    start, (known, often) = int(run[w_at]), items["counts"][item]
                    window, times = np.unique(h[start : start + n], return_counts=True)
                    place = np.minimum(np.searchsorted(known, window), len(known) - 1)
                    both = int(np.where(known[place] == window, np.minimum(often[place], times), 0).sum())
                    similarity = both / (n + size - both)
                    before = best.get(items["ids"][item])
                    if similarity >= threshold and (before is None or similarity > before["similarity"]):
                        best[items["ids"][item]] = {"item_id": items["ids"][item], "start_word": start, "n_words": n + S.SIZE - 1, "similarity": similarity, "hamming": int(bits)}

    @staticmethod
    def candidates(prints: np.ndarray, items: dict) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs that share LEAST points, from the lists of the windows' bytes."""
        wide = len(items["ids"])
        points = np.zeros(len(prints) * wide, np.int64)
        for b, (begin, listed) in enumerate(items["lists"]):
            value = prints[:, b].astype(np.int64)
            long = begin[value + 1] - begin[value]
            window = np.repeat(np.arange(len(prints)), long)
            entry = listed[np.arange(len(window)) + np.repeat(begin[value] - (np.cumsum(long) - long), long)]
            points[window * wide + entry // 4] += entry % 4  # a window's list names an item once
        return np.divmod(np.flatnonzero(points >= LEAST), wide)


def parts_of(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> list[DataFrame]:
    """The benchmark's items in parts of about so many bytes, by a hash of the item."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // part_bytes))
    return [rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def finder(part: DataFrame, threshold: float = THRESHOLD):
    """A function of a text column that gives the items of ``part`` it holds."""
    shared.bound_batches(part.sparkSession)
    sent = part.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part.collect()])

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items, known = Items(sent.value), S.WordHashes()
        for texts in batches:
            yield pd.Series([items.find(S.word_hashes(t, known), threshold) for t in texts])

    return found


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity, hamming) of each item that a document holds."""
    out = None
    for part in parts_of(benchmark):
        found = docs.select("doc_id", F.explode(finder(part, threshold)(F.col("text"))).alias("f")).select("doc_id", "f.*")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that hold a benchmark item."""
    items = shared.fresh(docs, "__items")
    for part in parts_of(benchmark):
        docs = docs.withColumn(items, finder(part, threshold)(F.col("text"))).filter(F.size(items) == 0).drop(items)
    return docs


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark)

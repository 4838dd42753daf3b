"""Removes bytes of passages that a document with a smaller id holds too.

A byte goes if a string of LENGTH bytes over it also starts in a document of a
smaller id. Strings are ordered by merging Burrows-Wheeler transforms of shards
(``bwt``); runs of equal strings, and the least id in each, follow from the
merged order. No task sees more than a bounded block:

1. Documents are packed into units of some megabytes, compressed, as a table.
2. Each string has an anchor: of its GRAM-byte pieces the one with the least
   hash, so equal strings have equal anchors. Units send the hashes of their
   anchors, once each, to buckets, and hear which of them other documents have too.
3. Units send what lies around such anchors, each text once, to buckets by
   anchor. There the texts are parted into shards, their transforms merged, and
   each run of equal strings gives the least id of a document that has it.
4. Units hear of these, mark the covered bytes and cut them out.

Hashes only choose what is compared: a string that two documents share always
meets itself, and only equal bytes count as equal. An anchor that over HOT
documents hold may lie in as many different texts; each of its strings then goes
by its own hash, and a unit sends an equal string once, so no bucket gets more
than a row per unit for one text.

Defined results: null texts are empty; texts below LENGTH bytes lose nothing;
rows with a null id lose nothing and take nothing from others, as they have no
order; rows with the same id are one document, so of repeated rows both stay.
A document that repeats itself loses nothing by that. Texts of any length are
read in whole. Other columns of the input are not read; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm import bwt, shared

#: Bytes of a string that counts, and of the pieces that anchors are chosen from.
LENGTH, GRAM = 50, 25
#: Bytes of a unit; bytes of text for each bucket of anchors and of texts; parts of the latter, merged one after another;
#: documents from which an anchor is hot; shards of a part.
UNIT, ANCHOR_BUCKET, TEXT_BUCKET, PARTS, HOT, SHARDS = 4_000_000, 16_000_000, 8_000_000, 8, 20_000, 4
#: Bytes hashed at once, and the bits of a hash; places within a piece take the other 17.
PIECE, HASH = 1 << 16, 47
BASE, WORD = 0x9E3779B97F4A7C15, 2**64
UNITS = "unit bigint, n_bytes bigint, ids array<bigint>, sizes binary, text binary"
SENT = "bucket int, unit bigint, hashes binary, documents binary"
HEARD = "unit bigint, hashes binary, hot binary"
TEXTS = "bucket int, unit bigint, texts binary"
SHARED = "unit bigint, runs binary"
CUT = "doc_id bigint, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary"
RUN = np.dtype([("document", "<u4"), ("at", "<i8"), ("n", "<u1"), ("low", "<i8")])
#: Columns of the texts that a unit sends to a bucket; ``places`` counts the documents and starts that follow.
SENT_TEXTS = {"part": "<u1", "size": "<u1", "low": "<i8", "high": "<i8", "places": "<u4", "document": "<u4", "at": "<i8", "text": "<u1"}


def packed(most: int):
    """Units: documents one after another, until ``most`` bytes are reached."""

    def unit(ids: list, texts: list[bytes]) -> pd.DataFrame:
        sizes = np.array([len(t) for t in texts], np.int64)
        blob = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
        return pd.DataFrame([{"unit": uuid.uuid4().int >> 65, "n_bytes": int(sizes.sum()), "ids": ids, "sizes": sizes.tobytes(), "text": blob}])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, n = [], [], 0
        for b in batches:
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                ids.append(None if pd.isna(i) else int(i))
                texts.append(t)
                n += len(t)
                if n >= most:
                    yield unit(ids, texts)
                    ids, texts, n = [], [], 0
        if ids:
            yield unit(ids, texts)

    return run


class Unit:
    """An unpacked unit: ``text``, and for each document its bounds, its id and whether it has one."""

    def __init__(self, row):
        self.text = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=max(1, int(row["n_bytes"]))), np.uint8)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.known = np.array([i is not None and i == i for i in row["ids"]], bool)
        self.ids = np.array([int(i) if k else 0 for i, k in zip(row["ids"], self.known, strict=True)], np.int64)

    def starts(self) -> np.ndarray:
        """Whether a string of LENGTH bytes starts at each byte, in a document with an id."""
        ok = np.repeat(self.known, self.sizes)
        short = np.minimum(self.sizes, LENGTH - 1)
        ok[bwt.spread(self.ends - short, short)[0]] = False
        return ok


def rolled(a: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` bytes from each place of the last axis on, by doubling."""
    cur, length, power = a.astype(np.uint64) + np.uint64(1), 1, BASE
    out, have = None, 0
    while True:
        if n & length:
            out = cur if out is None else out[..., : cur.shape[-1] - have] * np.uint64(power) + cur[..., have:]
            have += length
        if have == n:
            return out
        cur = cur[..., :-length] * np.uint64(power) + cur[..., length:]
        power, length = power * power % WORD, length * 2


def mixed(h: np.ndarray) -> np.ndarray:
    """The upper HASH bits of a hash, all of its bits stirred in."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(64 - HASH)


def anchored(unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first start, starts) of runs of strings with one anchor in one place, in order."""
    hashes, at, n = [], [], []
    ok = unit.starts()
    for x in range(0, max(0, len(unit.text) - LENGTH + 1), PIECE):
        piece = unit.text[x : x + PIECE + LENGTH - 1]
        key = (mixed(rolled(piece, GRAM)) << np.uint64(64 - HASH)) | np.arange(len(piece) - GRAM + 1, dtype=np.uint64)
        window, have = LENGTH - GRAM + 1, 1
        while have * 2 <= window:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if window > have:
            key = np.minimum(key[: len(key) - window + have], key[window - have :])
        good = ok[x : x + len(key)]
        new = good & np.r_[True, (key[1:] != key[:-1]) | ~good[:-1]]
        # A run also ends where a document does; ``good`` is false before each new one.
        first = np.flatnonzero(new)
        run = np.cumsum(new)[good] - 1
        # The least of many hashes is small: its bits are turned over, so that buckets are even.
        hashes.append((key[first] >> np.uint64(64 - HASH)) * np.uint64(BASE) & np.uint64(2**HASH - 1))
        at.append(first + x)
        n.append(np.bincount(run, minlength=len(first)))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(at), np.concatenate(n)


def to_bytes(sorted_hashes: np.ndarray) -> bytes:
    """Rising hashes as planes of the bytes of their gaps: the upper ones are zeros, and take no room once compressed."""
    return np.diff(sorted_hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets by the order of hashes."""
    return (((h >> np.uint64(HASH - 30)) * np.uint64(n)) >> np.uint64(30)).astype(np.int64)


def sending(n_buckets: int):
    """The distinct hashes of each unit, by bucket, with how many of its documents have them (255 at most)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                unit = Unit(row)
                h, at, _ = anchored(unit)
                document = np.searchsorted(unit.ends, at, side="right")
                by = np.argsort(h, kind="stable")
                h, document = h[by], document[by]
                new = np.r_[True, h[1:] != h[:-1]][: len(h)]
                other = new | np.r_[True, document[1:] != document[:-1]][: len(h)]
                first = np.flatnonzero(new)
                many = np.minimum(np.add.reduceat(other, first), 255).astype(np.uint8) if len(first) else np.zeros(0, np.uint8)
                h = h[first]
                bucket = bucket_of(h, n_buckets)
                cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(h)]), len(h)]
                rows = [(int(bucket[i]), row["unit"], to_bytes(h[i:j]), many[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pd.DataFrame(rows, columns=["bucket", "unit", "hashes", "documents"])

    return run


def repeated(most: int):
    """To each unit, those of its hashes that over one document has, and which of these over ``most`` have."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own = [from_bytes(x) for x in part["hashes"]]
        many = np.frombuffer(b"".join(part["documents"]), np.uint8)
        distinct, which = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(which, weights=many)
        rows, at = [], 0
        for unit, x in zip(part["unit"], own, strict=True):
            k = which[at : at + len(x)]
            at += len(x)
            k = k[total[k] > 1]
            if len(k):
                rows.append((unit, to_bytes(distinct[k]), (total[k] > most).astype(np.uint8).tobytes()))
        return pd.DataFrame(rows, columns=["unit", "hashes", "hot"])

    return run


def sent_texts(columns: dict[str, np.ndarray]) -> bytes:
    """SENT_TEXTS of a unit and a bucket, one column after another, compressed."""
    head = np.array([len(columns[k]) for k in ("size", "document", "text")], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(columns[k].astype(kind).tobytes() for k, kind in SENT_TEXTS.items()))


def got_texts(blob: bytes) -> dict[str, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, places, size = np.frombuffer(data, "<i8", 3).tolist()
    out, at = {}, 24
    for k, kind in SENT_TEXTS.items():
        out[k] = np.frombuffer(data, kind, size if k == "text" else places if k in ("document", "at") else n, at)
        at += out[k].nbytes
    return out


def around(n_buckets: int):
    """The texts around the anchors that a unit heard of, each once, with the least and the greatest id and the places."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["bucket", "unit", "texts"])
        unit = Unit(left.iloc[0])
        h, at, n = anchored(unit)
        heard = np.concatenate([from_bytes(x) for x in right["hashes"]])
        hot = np.frombuffer(b"".join(right["hot"]), np.uint8)
        by = np.argsort(heard)
        heard, hot = heard[by], hot[by]
        found = np.minimum(np.searchsorted(heard, h), len(heard) - 1)
        kept = heard[found] == h
        h, at, n, hot = h[kept], at[kept], n[kept], hot[found[kept]] > 0
        if hot.any():
            single, _ = bwt.spread(at[hot], n[hot])
            own = [mixed(rolled(unit.text[s[:, None] + np.arange(LENGTH)], LENGTH)[:, 0]) for s in np.array_split(single, 1 + len(single) // PIECE)]
            h = np.concatenate([h[~hot], *own])
            n = np.concatenate([n[~hot], np.ones(len(single), np.int64)])
            at = np.concatenate([at[~hot], single])
        document = np.searchsorted(unit.ends, at, side="right")
        text = unit.text.tobytes()
        bucket = bucket_of(h, n_buckets * PARTS)
        which, _ = pd.factorize(np.array([*(text[i : i + m] for i, m in zip(at.tolist(), (n + LENGTH - 1).tolist(), strict=True)), None], object)[:-1])
        by = np.lexsort((which, bucket))  # equal texts have one anchor, so one bucket
        which, bucket, at, n, document = which[by], bucket[by], at[by], n[by], document[by]
        first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]][: len(which)])
        ids = unit.ids[document]
        size = (n + LENGTH - 1)[first]
        columns = {"part": bucket[first] % PARTS, "size": size, "low": np.minimum.reduceat(ids, first), "high": np.maximum.reduceat(ids, first), "places": np.diff(np.r_[first, len(which)])}
        own = bucket[first] // PARTS
        cuts = np.r_[np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)]), len(own)]
        begins, places = at[first], np.r_[first, len(which)]
        rows = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            here = slice(places[i], places[j])
            sent = {k: v[i:j] for k, v in columns.items()} | {"document": document[here], "at": at[here]}
            sent["text"] = unit.text[bwt.spread(begins[i:j], size[i:j])[0]]
            rows.append((int(own[i]), left["unit"].iloc[0], sent_texts(sent)))
        return pd.DataFrame(rows, columns=["bucket", "unit", "texts"])

    return run


def least(texts: list[bytes], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, starts, least id) of the strings that over one document has, from the merged transforms of shards of ``texts``."""
    lengths = np.array([len(t) for t in texts], np.int64)
    whole = np.frombuffer(b"".join(texts), np.uint8)
    rank = np.zeros(256, np.uint16)
    used = np.flatnonzero(np.bincount(whole, minlength=256))
    rank[used] = np.arange(1, len(used) + 1)
    n = min(SHARDS, len(texts))
    cuts = [len(texts) * i // n for i in range(n + 1)]
    at = np.r_[0, np.cumsum(lengths)]
    shards = [bwt.shard(whole[at[i] : at[j]], lengths[i:j], rank, LENGTH) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    from_shard, place, group = bwt.merged(shards, LENGTH, len(used) + 1)
    # Back to texts and starts within them.
    starts = lengths - LENGTH + 1
    begins = np.r_[0, np.cumsum(starts)]
    of_text, offset = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    for k, s in enumerate(shards):
        mine = from_shard == k
        offset[mine] = s.offset[place[mine]]
        of_text[mine] = np.searchsorted(np.cumsum(lengths[cuts[k] : cuts[k + 1]] + 1), place[mine], side="right") + cuts[k]
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
    floor, top = np.minimum.reduceat(low[of_text], edges), np.maximum.reduceat(high[of_text], edges)
    lowest = np.empty(begins[-1], np.int64)
    shares = np.empty(begins[-1], bool)
    slot = begins[of_text] + offset
    lowest[slot], shares[slot] = floor[group], (floor < top)[group]
    of_slot = np.repeat(np.arange(len(texts)), starts)
    new = shares & np.r_[True, (lowest[1:] != lowest[:-1]) | (of_slot[1:] != of_slot[:-1]) | ~shares[:-1]]
    first = np.flatnonzero(new)
    count = np.bincount(np.cumsum(new)[shares] - 1, minlength=len(first))
    return of_slot[first], first - begins[of_slot[first]], count, lowest[first]


def sent_runs(runs: np.ndarray) -> bytes:
    """Runs of RUN, one column after another, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(len(runs).to_bytes(8, "little") + b"".join(runs[k].tobytes() for k in RUN.names))


def got_runs(blob: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(blob)
    out, at = np.empty(int.from_bytes(data[:8], "little"), RUN), 8
    for k in RUN.names:
        out[k] = np.frombuffer(data, RUN[k], len(out), at)
        at += out[k].nbytes
    return out


def compared(part: pd.DataFrame) -> pd.DataFrame:
    """To each unit, the runs of its strings that over one document has, with the least id of such a document."""
    got = [got_texts(x) for x in part["texts"]]
    whole = {k: np.concatenate([g[k] for g in got]) for k in SENT_TEXTS}
    whole["unit"] = np.repeat(part["unit"].to_numpy(np.int64), [len(g["size"]) for g in got])
    del got
    whole["from"] = np.r_[0, np.cumsum(whole["size"], dtype=np.int64)[:-1]]
    whole["first"] = np.r_[0, np.cumsum(whole["places"], dtype=np.int64)[:-1]]
    units, runs = zip(*(merged_part(whole, np.flatnonzero(whole["part"] == k)) for k in np.unique(whole["part"])), strict=True)
    unit, found = np.concatenate(units), np.concatenate(runs)
    by = np.argsort(unit, kind="stable")
    unit, found = unit[by], found[by]
    cuts = np.r_[np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]][: len(unit)]), len(unit)]
    return pd.DataFrame([(int(unit[i]), sent_runs(found[i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], columns=["unit", "runs"])


def merged_part(whole: dict[str, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit, RUN) of every place of the texts of one part of a bucket."""
    data = whole["text"].tobytes() if len(rows) == len(whole["size"]) else None
    begin, size = whole["from"][rows], whole["size"][rows].astype(np.int64)
    if data is None:
        own = whole["text"][bwt.spread(begin, size)[0]]
        data, begin = own.tobytes(), np.r_[0, np.cumsum(size)[:-1]]
    which, texts = pd.factorize(np.array([*(data[i : i + m] for i, m in zip(begin.tolist(), size.tolist(), strict=True)), None], object)[:-1])
    low, high = np.full(len(texts), np.iinfo(np.int64).max), np.full(len(texts), np.iinfo(np.int64).min)
    np.minimum.at(low, which, whole["low"][rows])
    np.maximum.at(high, which, whole["high"][rows])
    text, start, n, lowest = least(list(texts), low, high)
    first = np.searchsorted(text, np.arange(len(texts)))
    many = np.bincount(text, minlength=len(texts))
    place, row = bwt.spread(whole["first"][rows], whole["places"][rows].astype(np.int64))
    run, of = bwt.spread(first[which[row]], many[which[row]])
    found = np.empty(len(run), RUN)
    found["document"], found["at"] = whole["document"][place[of]], whole["at"][place[of]] + start[run]
    found["n"], found["low"] = n[run], lowest[run]
    return whole["unit"][rows][row[of]], found


def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The documents of a unit: the maximal runs of covered bytes, and what is left."""
    columns = ["doc_id", "n_bytes", "starts", "ends", "kept"]
    if not len(left):
        return pd.DataFrame([], columns=columns)
    unit = Unit(left.iloc[0])
    runs = np.concatenate([np.zeros(0, RUN), *map(got_runs, right["runs"])])
    runs = runs[runs["low"] < unit.ids[runs["document"]]]
    change = np.zeros(len(unit.text) + 1, np.int32)
    np.add.at(change, runs["at"], 1)
    np.add.at(change, runs["at"] + runs["n"] + (LENGTH - 1), -1)
    gone = np.cumsum(change[:-1]) > 0
    begins = unit.ends - unit.sizes
    heads = np.zeros(len(gone) + 1, bool)
    heads[begins] = True
    first = np.flatnonzero(gone & (~np.r_[False, gone[:-1]] | heads[:-1]))
    last = np.flatnonzero(gone & (~np.r_[gone[1:], False] | heads[1:])) + 1
    document = np.searchsorted(unit.ends, first, side="right")
    cuts = np.searchsorted(document, np.arange(len(unit.sizes) + 1))
    rows = []
    for k, (a, b) in enumerate(zip(begins.tolist(), unit.ends.tolist(), strict=True)):
        i, j = cuts[k], cuts[k + 1]
        kept = unit.text[a:b] if i == j else unit.text[a:b][~gone[a:b]]
        rows.append((int(unit.ids[k]) if unit.known[k] else None, b - a, first[i:j] - a, last[i:j] - a, kept.tobytes()))
    out = pd.DataFrame(rows, columns=columns)
    out["doc_id"] = pd.array([r[0] for r in rows], "Int64")
    return out


def deduplicated(documents: DataFrame, unit: int = UNIT, anchor_bucket: int = ANCHOR_BUCKET, text_bucket: int = TEXT_BUCKET, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): of every document the removed spans (start, end in bytes, end exclusive) and the bytes that stay."""
    spark = documents.sparkSession
    shared.bound_batches(spark)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    units = shared.written(rows.mapInPandas(packed(unit), UNITS), "units")
    n_bytes = units.agg(F.sum("n_bytes")).first()[0] or 0
    anchor_buckets, text_buckets = (max(1, min(2**30, -(-n_bytes // size))) for size in (anchor_bucket, text_bucket))
    heard = units.mapInPandas(sending(anchor_buckets), SENT).groupBy("bucket").applyInPandas(repeated(hot), HEARD)
    texts = units.groupBy("unit").cogroup(heard.groupBy("unit")).applyInPandas(around(text_buckets), TEXTS)
    runs = texts.groupBy("bucket").applyInPandas(compared, SHARED)
    found = units.groupBy("unit").cogroup(runs.groupBy("unit")).applyInPandas(cut, CUT)
    spans = F.transform(F.arrays_zip("starts", "ends"), lambda s: F.struct(s["starts"].alias("start"), s["ends"].alias("end")))
    return found.select("doc_id", "n_bytes", spans.alias("spans"), "kept")


def report(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    found = deduplicated(documents)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

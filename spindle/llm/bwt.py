"""Burrows-Wheeler transforms of shards of strings, and their merge by interleave refinement.

Pure numpy over bounded shards; ``suffix_dedup`` has Spark deal them out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Codes of symbol groups that a radix sort of 16 bits takes, and of symbol triples that are counted in a table.
CODES, TRIPLES = 2**16, 2**22


def spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first, first + 1, ... n of each, and which each is of."""
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n), which


@dataclass
class Shard:
    """Strings, each closed by an end mark (0), and the order of all their rotations.

    ``symbols`` holds the strings one after another, ``order`` the places of the
    rotations in sorted order; the transform is ``symbols`` just before these.
    ``offset`` and ``size`` are those of each place within its string.
    """

    symbols: np.ndarray
    offset: np.ndarray
    size: np.ndarray
    order: np.ndarray

    @property
    def transform(self) -> np.ndarray:
        before = np.where(self.offset[self.order] == 0, self.order + self.size[self.order] - 1, self.order - 1)
        return self.symbols[before]


def shard(text: np.ndarray, lengths: np.ndarray, rank: np.ndarray, depth: int) -> Shard:
    """The shard of strings given one after another; ``rank`` numbers bytes from 1, keeping their order.

    Rotations are sorted by at least ``depth`` symbols: by as many as a key
    holds, then those that are still equal by the ranks of what follows, three
    times as many symbols in each step. Strings must be of ``depth`` bytes or more.
    """
    sizes = np.asarray(lengths, np.int64) + 1
    ends = np.cumsum(sizes)
    symbols = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint16)
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    symbols[inside] = rank[text]
    narrow = np.int32 if len(symbols) < 2**31 else np.int64
    size = np.repeat(sizes, sizes).astype(narrow)
    offset = (np.arange(len(symbols)) - np.repeat(ends - sizes, sizes)).astype(narrow)

    def ahead(at: np.ndarray, n: int) -> np.ndarray:
        own = offset[at]
        return at - own + (own + n) % size[at]

    every = np.arange(len(symbols), dtype=narrow)
    bits = int(rank.max(initial=0)).bit_length()
    known, key = 1, symbols.astype(np.uint64)
    while known * 2 * bits <= 64 and known < depth:
        key = (key << np.uint64(known * bits)) | key[ahead(every, known)]
        known *= 2
    order = np.argsort(key).astype(narrow)
    slots, place, key = every, order, key[order]
    first = np.empty(len(symbols), np.uint64)  # by place: the first slot of those equal to it so far
    short = len(symbols) < 2**21
    while len(slots):
        new = np.r_[True, key[1:] != key[:-1]]
        first[place] = slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        tied = ~new
        tied[:-1] |= tied[1:]
        slots = slots[tied]
        if known >= depth or not len(slots):
            break
        place = order[slots]
        if short:
            key = (first[place] << np.uint64(42)) | (first[ahead(place, known)] << np.uint64(21)) | first[ahead(place, 2 * known)]
        else:
            key = (first[place] << np.uint64(32)) | first[ahead(place, known)]
        known *= 3 if short else 2
        by = np.argsort(key)
        place, key = place[by], key[by]
        order[slots] = place
    return Shard(symbols, offset, size, order)


def grams(shards: list[Shard], n: int, alphabet: int) -> list[np.ndarray] | None:
    """Codes of the ``n`` symbols from each place on, in their order; None if 16 bits can't tell them apart."""
    if alphabet**n > (TRIPLES if n > 2 else CODES):
        return None
    out = []
    for s in shards:
        code = s.symbols.astype(np.int32)
        for i in range(1, n):
            code = code[: len(s.symbols) - i] * alphabet + s.symbols[i:]
        out.append(np.r_[code, np.zeros(min(n - 1, len(s.symbols)), np.int32)] if n > 1 else code)
    if alphabet**n <= CODES:
        return [c.astype(np.uint16) for c in out]
    there = np.zeros(alphabet**n, bool)
    for c in out:
        there[c] = True
    dense = np.cumsum(there) - 1
    return [dense[c].astype(np.uint16) for c in out] if dense[-1] < CODES else None


def merged(shards: list[Shard], depth: int, alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, place, group) of every string of ``depth`` bytes in the shards, in sorted order; equal ones are one group.

    Only the interleave is refined: which shard the next rotation comes from.
    After a pass it is that of the rotations sorted by their first h symbols;
    the symbols before them, which each shard has in its own order as its
    transform, are dealt out stably, and give the interleave for h + n. Groups
    are the runs with h symbols in common. Rows that no string of ``depth``
    bytes comes from any more are left out of a pass. No suffix is sorted again.
    """
    steps, codes = [], {}
    for n in (3, 2, 1):
        codes[n] = grams(shards, n, alphabet)
        if codes[n] is not None:
            steps += [n] * ((depth - sum(steps)) // n)
    byte = np.uint8 if max((int(s.size.max(initial=0)) for s in shards), default=0) < 256 else np.int64
    at = [(s.offset[s.order].astype(byte), (s.size - s.offset)[s.order].astype(byte)) for s in shards]

    def rows(h: int) -> list[np.ndarray]:
        return [s.order[np.flatnonzero((off >= depth - h) & (left > h))] for s, (off, left) in zip(shards, at, strict=True)]

    from_shard = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(r) for r in rows(0)])
    group, h = np.zeros(len(from_shard), np.int32), 0
    for n in steps:
        before = np.empty(len(from_shard), np.uint16)
        for i, own in enumerate(rows(h)):
            before[np.flatnonzero(from_shard == i)] = codes[n][i][own - n]
        turn = np.argsort(before, kind="stable")
        from_shard, group, before = from_shard[turn], group[turn], before[turn]
        new = (group[1:] != group[:-1]) | (before[1:] != before[:-1])
        group = np.zeros(len(from_shard), np.int32)
        np.cumsum(new, out=group[1:])
        h += n
    place = np.empty(len(from_shard), np.int64)
    for i, own in enumerate(rows(depth)):
        place[from_shard == i] = own
    return from_shard, place, group

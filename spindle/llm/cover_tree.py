"""Cover trees over a bounded block of points, and the dual-tree search of nearest centroids.

Pure numpy over one block; ``centroids`` has Spark deal the blocks.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

#: Components from which a point stands alone, as its squares come near the end of doubles.
GIANT = 2.0**400


@dataclass
class Tree:
    """Nodes of a forest. A node covers points[lo:hi] of ``order``, all within ``radius`` of its pivot; ``first:last`` are its children."""

    order: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    last: np.ndarray
    roots: np.ndarray

    def packed(self) -> dict[str, bytes]:
        return {f.name: getattr(self, f.name).tobytes() for f in fields(self)}

    @classmethod
    def unpacked(cls, row) -> Tree:
        return cls(**{f.name: np.frombuffer(row[f.name], np.float64 if f.name == "radius" else np.int64) for f in fields(cls)})


def net(far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of insertion, level and parent of each point, from all distances of a block.

    Points are taken farthest first. One inserted at level i is over 2**i from
    all before it, and within 2**(i + 1) of its parent, the nearest point that
    was there when level i began: the separation and covering of a cover tree.
    """
    m = len(far)
    level, parent, order = np.zeros(m, np.int64), np.full(m, -1, np.int64), [0]
    gap, nearest = far[0].copy(), np.zeros(m, np.int64)
    now, above = None, nearest.copy()
    for _ in range(m - 1):
        p = int(np.argmax(gap))
        i = int(np.ceil(np.log2(gap[p]))) - 1 if gap[p] > 0 else -1100
        if i != now:
            now, above = i, nearest.copy()
        level[p], parent[p] = i, above[p]
        order.append(p)
        closer = far[p] < gap
        gap[closer], nearest[closer] = far[p][closer], p
        gap[p] = -1.0
    level[0] = level.max(initial=0) + 1
    return np.array(order), level, parent


def build(v: np.ndarray) -> Tree:
    """The cover tree of the rows of ``v``; equal rows share a leaf, giants are roots of their own."""
    giant = np.abs(v).max(1, initial=0) >= GIANT
    plain = np.flatnonzero(~giant)
    order: list[int] = []
    nodes: list[list] = []  # pivot, radius, lo, hi, children
    roots: list[int] = []
    if len(plain):
        distinct, which = np.unique(v[plain], axis=0, return_inverse=True)
        copies = np.bincount(which.ravel())
        rows = np.split(plain[np.argsort(which.ravel(), kind="stable")], np.cumsum(copies)[:-1])
        square = (distinct * distinct).sum(1)
        far = np.sqrt(np.maximum(0, square[:, None] + square[None, :] - 2 * distinct @ distinct.T))
        np.fill_diagonal(far, 0)
        off = 1e-6 * np.sqrt(square.max(initial=0))  # what doubles may lose above
        inserted, level, parent = net(far)
        kids: dict[int, list[int]] = {}
        for p in inserted[1:].tolist():
            kids.setdefault(int(parent[p]), []).append(p)
        points: list[int] = []

        def grow(p: int, below: list[int]) -> int:
            """The node of ``p`` and the points inserted under it, coarsest level first; as deep as there are levels."""
            start, lo = len(points), len(order)
            children = []
            if below:
                here = sum(level[c] == level[below[0]] for c in below)
                children = [grow(p, below[here:]), *(grow(c, kids.get(c, [])) for c in below[:here])]
            else:
                points.append(p)
                order.extend(rows[p].tolist())
            radius = float(far[p, points[start:]].max()) + off if below else 0.0
            nodes.append([int(rows[p][0]), radius, lo, len(order), children])
            return len(nodes) - 1

        roots.append(grow(int(inserted[0]), kids.get(int(inserted[0]), [])))
    for p in np.flatnonzero(giant).tolist():
        nodes.append([p, 0.0, len(order), len(order) + 1, []])
        roots.append(len(nodes) - 1)
        order.append(p)
    return _numbered(order, nodes, roots)


def _numbered(order: list[int], nodes: list[list], roots: list[int]) -> Tree:
    """The nodes numbered anew, breadth first, so that children stand together."""
    sequence, place, at = list(roots), {}, 0
    first, last = [], []
    while at < len(sequence):
        own = nodes[sequence[at]][4]
        place[sequence[at]] = at
        first.append(len(sequence))
        sequence.extend(own)
        last.append(len(sequence))
        at += 1
    whole = lambda values: np.array(values, np.int64)
    return Tree(
        order=whole(order),
        pivot=whole([nodes[i][0] for i in sequence]),
        radius=np.array([nodes[i][1] for i in sequence], np.float64),
        lo=whole([nodes[i][2] for i in sequence]),
        hi=whole([nodes[i][3] for i in sequence]),
        first=whole(first),
        last=whole(last),
        roots=np.arange(len(roots), dtype=np.int64),
    )


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of each first:last, and which range each is of."""
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n), which


def opened(tree: Tree, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes, or a leaf itself, and which node each is of."""
    leaf = tree.first[at] == tree.last[at]
    return spread(np.where(leaf, at, tree.first[at]), np.where(leaf, at + 1, tree.last[at]))


def nearest(v: np.ndarray, tree: Tree, c: np.ndarray, centres: Tree, exactly) -> tuple[np.ndarray, int]:
    """The number of the nearest centroid of each row of ``v``, ties to the smaller, and how many pairs of nodes were looked at.

    Pairs of a node of points and a node of centroids go down both trees
    together. A pair goes when all its centroids are surely farther, from all
    its points, than some other centroid; a node with one centroid left is
    settled whole. ``exactly(rows, centroids)`` compares what is left at the leaves.
    """
    out, looked = np.full(len(v), -1, np.int64), 0
    # The number of a leaf of centroids is the least of its equal ones.
    number = np.array([centres.order[a:b].min() for a, b in zip(centres.lo, centres.hi, strict=True)], np.int64)
    pn, pc = np.repeat(tree.roots, len(centres.roots)), np.tile(centres.roots, len(tree.roots))
    with np.errstate(over="ignore", invalid="ignore"):
        while len(pn):
            looked += len(pn)
            a, b = v[tree.pivot[pn]], c[centres.pivot[pc]]
            d = np.sqrt(((a - b) ** 2).sum(1))
            slack = 1e-9 * d + 1e-12 * (np.abs(a).max(1, initial=0) + np.abs(b).max(1, initial=0)) * v.shape[1]
            starts = np.flatnonzero(np.r_[True, pn[1:] != pn[:-1]])
            group = np.cumsum(np.r_[0, pn[1:] != pn[:-1]])
            bar = np.fmin.reduceat(d + tree.radius[pn] + slack, starts)[group]
            kept = ~(d - tree.radius[pn] - centres.radius[pc] - slack > bar)
            pn, pc = pn[kept], pc[kept]
            alone = np.bincount(pn, minlength=len(tree.pivot))[pn] == 1
            end_c = centres.first[pc] == centres.last[pc]
            settled = alone & end_c
            for node, centre in zip(pn[settled], number[pc[settled]], strict=True):
                out[tree.order[tree.lo[node] : tree.hi[node]]] = centre
            pn, pc, end_c = pn[~settled], pc[~settled], end_c[~settled]
            # A leaf of points whose centroids are all leaves is compared exactly.
            waits = np.zeros(len(tree.pivot), bool)
            waits[pn[~end_c]] = True
            last = (tree.first[pn] == tree.last[pn]) & ~waits[pn]
            if last.any():
                node, own = pn[last], number[pc[last]]
                score = np.unique(exactly(tree.pivot[node], own), return_inverse=True)[1].ravel()
                by = np.lexsort((own, score, node))
                by = by[np.r_[True, node[by][1:] != node[by][:-1]]]
                for n, centre in zip(node[by], own[by], strict=True):
                    out[tree.order[tree.lo[n] : tree.hi[n]]] = centre
            pn, pc = pn[~last], pc[~last]
            child, which = opened(tree, pn)
            pc = pc[which]
            under, which = opened(centres, pc)
            pn, pc = child[which], under
            by = np.lexsort((pc, pn))
            pn, pc = pn[by], pc[by]
    return out, looked

"""What pictures show, as numbers: histogram, sharpness, brightness, and motion between two of them.

Kernels over one picture or pair in numpy, for tasks that hold pixels. Pictures
are arrays of bytes: rows x columns x (blue, green, red), or rows x columns of grey.
"""

from __future__ import annotations

import numpy as np

# Bins and ranges of hue and saturation, weights of blue, green and red in grey (of 16384),
# and of the search for corners and of the tracker: their window, levels, steps and least moves.
BINS, RANGES = (50, 60), (180.0, 256.0)
GREY = np.array([1868, 9617, 4899])
CORNERS, QUALITY, APART, FEWEST = 80, 0.2, 7, 5
WINDOW, LEVELS, STEPS, LEAST_MOVE, LEAST_EIGEN = 21, 3, 30, 0.01, 1e-4


def grey(picture: np.ndarray) -> np.ndarray:
    """Brightness, 0 to 255."""
    return picture if picture.ndim == 2 else ((picture.astype(np.int64) @ GREY + 8192) >> 14).astype(np.uint8)


def hue_saturation(picture: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hue in half degrees (0 to 179) and saturation (0 to 255), rounded; greys have hue 0."""
    b, g, r = (picture[..., i].astype(float) for i in range(3))
    top, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    span = np.where(top > low, top - low, 1.0)
    degrees = np.where(top == r, (g - b) / span, np.where(top == g, 2 + (b - r) / span, 4 + (r - g) / span)) * 60
    hue = np.where(top > low, np.rint(np.where(degrees < 0, degrees + 360, degrees) / 2), 0.0) % 180
    return hue, np.rint(np.where(top > 0, 255 * (top - low) / np.where(top > 0, top, 1.0), 0.0))


def histogram(picture: np.ndarray) -> np.ndarray:
    """Counts of hue and saturation in BINS, scaled to length 1; a grey picture counts as colour without saturation."""
    colour = picture if picture.ndim == 3 else np.repeat(picture[..., None], 3, axis=2)
    at = [np.floor(x * n / most).astype(np.int64) for x, n, most in zip(hue_saturation(colour), BINS, RANGES, strict=True)]
    counts = np.bincount((at[0] * BINS[1] + at[1]).ravel(), minlength=BINS[0] * BINS[1]).astype(float)
    size = np.sqrt(counts @ counts)
    return counts / size if size > 0 else counts


def mirrored(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with ``n`` more cells on each side, mirrored at the middle of the outermost ones, or repeated where there are too few."""
    for axis in (0, 1):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (n, n)
        a = np.pad(a, pad, mode="reflect" if a.shape[axis] > n else "edge")
    return a


def laplacian_variance(picture: np.ndarray) -> float:
    """Variance of each pixel's four neighbours less four times itself: high where there are edges."""
    p = mirrored(grey(picture).astype(float), 1)
    edges = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return float(edges.var())


def slopes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes along columns and rows (Sobel)."""
    p = mirrored(a, 1)
    across, down = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    return across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]


def box(a: np.ndarray, n: int) -> np.ndarray:
    """Sums over n x n cells around each (``n`` odd)."""
    p = np.pad(mirrored(a, n // 2).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n]


def corners(picture: np.ndarray, most: int = CORNERS, quality: float = QUALITY, apart: float = APART) -> np.ndarray:
    """(x, y) of places that differ from their surroundings in all directions, strongest first.

    The strength is the lesser eigenvalue of the slopes' covariance over 3 x 3
    pixels; places are peaks of at least ``quality`` of the strongest, not within ``apart`` of a stronger one.
    """
    dx, dy = slopes(grey(picture).astype(float))
    xx, yy, xy = (box(v, 3) / 2 for v in (dx * dx, dy * dy, dx * dy))
    strength = (xx + yy) - np.sqrt((xx - yy) ** 2 + xy**2 * 4)
    if min(strength.shape) < 3 or strength.max() <= 0:
        return np.zeros((0, 2))
    p = np.pad(strength, 1, constant_values=-np.inf)
    around = np.max([p[1 + i : p.shape[0] - 1 + i, 1 + j : p.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
    peak = (strength == around) & (strength >= quality * strength.max())
    peak[[0, -1]], peak[:, [0, -1]] = False, False
    y, x = np.nonzero(peak)
    kept: list[tuple[int, int]] = []
    for k in np.argsort(-strength[y, x], kind="stable"):
        if len(kept) == most:
            break
        if all((x[k] - a) ** 2 + (y[k] - b) ** 2 >= apart**2 for a, b in kept):
            kept.append((x[k], y[k]))
    return np.array(kept, float).reshape(-1, 2)


def halved(a: np.ndarray) -> np.ndarray:
    """Half the size: smoothed by 1 4 6 4 1, then every other row and column."""
    w = np.array([1, 4, 6, 4, 1]) / 16
    p = mirrored(a, 2)
    p = sum(w[i] * p[i : p.shape[0] - 4 + i] for i in range(5))
    return sum(w[i] * p[:, i : p.shape[1] - 4 + i] for i in range(5))[::2, ::2]


def between(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values at places between pixels, linear in both directions; beyond the edge the edge's."""
    x, y = np.clip(x, 0, a.shape[1] - 1), np.clip(y, 0, a.shape[0] - 1)
    i, j = np.minimum(y.astype(np.int64), a.shape[0] - 2 if a.shape[0] > 1 else 0), np.minimum(x.astype(np.int64), a.shape[1] - 2 if a.shape[1] > 1 else 0)
    v, u = y - i, x - j
    i1, j1 = np.minimum(i + 1, a.shape[0] - 1), np.minimum(j + 1, a.shape[1] - 1)
    return (1 - v) * ((1 - u) * a[i, j] + u * a[i, j1]) + v * ((1 - u) * a[i1, j] + u * a[i1, j1])


def tracked(before: np.ndarray, after: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the surroundings of ``points`` (x, y) have moved, and which could be followed (pyramids, Lucas and Kanade).

    From the coarsest picture to the finest, each point's move is bettered by
    least squares over its window until it hardly changes. Points on flat ground,
    or that leave the picture, are not followed.
    """
    pyramid = [(before.astype(float), after.astype(float))]
    while len(pyramid) <= LEVELS and min(pyramid[-1][0].shape) >= 2 * WINDOW:
        pyramid.append(tuple(map(halved, pyramid[-1])))
    reach = np.arange(WINDOW) - WINDOW // 2
    wx, wy = (m.ravel() for m in np.meshgrid(reach, reach))
    move, good = np.zeros_like(points), np.ones(len(points), bool)
    for level in range(len(pyramid) - 1, -1, -1):
        a, b = pyramid[level]
        dx, dy = (s / 8 for s in slopes(a))
        px, py = points[:, :1] / 2**level + wx, points[:, 1:] / 2**level + wy
        own, gx, gy = between(a, px, py), between(dx, px, py), between(dy, px, py)
        xx, yy, xy = (gx * gx).sum(1), (gy * gy).sum(1), (gx * gy).sum(1)
        det = xx * yy - xy * xy
        eigen = (xx + yy - np.sqrt((xx - yy) ** 2 + 4 * xy * xy)) / (2 * WINDOW**2) / 1024
        firm = (eigen >= LEAST_EIGEN) & (det > 0)
        if level == 0:
            good &= firm
        move = move * 2 if level < len(pyramid) - 1 else move
        active = firm.copy()
        for _ in range(STEPS):
            if not active.any():
                break
            k = np.flatnonzero(active)
            gap = own[k] - between(b, px[k] + move[k, :1], py[k] + move[k, 1:])
            ex, ey = (gap * gx[k]).sum(1), (gap * gy[k]).sum(1)
            step = np.stack([yy[k] * ex - xy[k] * ey, xx[k] * ey - xy[k] * ex], 1) / det[k, None]
            move[k] += step
            active[k[(step**2).sum(1) <= LEAST_MOVE**2]] = False
    end = points + move
    good &= (end >= 0).all(1) & (end[:, 0] <= before.shape[1] - 1) & (end[:, 1] <= before.shape[0] - 1)
    return end, good


def flow(before: np.ndarray, after: np.ndarray, most: int = CORNERS, quality: float = QUALITY) -> float | None:
    """Mean way of corners from one picture to the next; None with under FEWEST corners or none that can be followed."""
    a, b = grey(before), grey(after)
    points = corners(a, most, quality)
    if len(points) < FEWEST or a.shape != b.shape:
        return None
    end, good = tracked(a, b, points)
    return float(np.sqrt(((end - points)[good] ** 2).sum(1)).mean()) if good.any() else None


def difference(before: np.ndarray, after: np.ndarray) -> float:
    """Mean change of brightness."""
    return float(np.abs(grey(before).astype(int) - grey(after).astype(int)).mean()) if before.shape == after.shape else 0.0

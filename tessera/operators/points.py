"""Point sets: hulls, enclosing shapes, fits, transforms with outliers, and clouds.

Functions take (n, 2) or (n, 3) arrays; :func:`per_group` runs one for each key of a table of points. Groups are
contours or clouds of one object; what runs over all points (voxels, normals' neighbours) is in grouped aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_group(df: DataFrame, key: str, coords: Sequence[str], f: Callable[[np.ndarray], Sequence[float]], names: Sequence[str]) -> DataFrame:
    """(key, names...): ``f`` of each key's points, in the order of their coordinates."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in coords])
        out = f(np.stack([t.column(c).to_numpy().astype(float) for c in coords], axis=1))
        return pa.table({key: t.column(key).slice(0, 1)} | {n: pa.array([float(v)]) for n, v in zip(names, out, strict=True)})

    return df.select(key, *coords).groupBy(key).applyInArrow(one, f"{key} {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names))


def convex_hull(p: np.ndarray) -> np.ndarray:
    """Counter-clockwise in a y-up plane, from the leftmost lowest point, without points on edges."""
    pts = sorted(set(map(tuple, p.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def half(order):
        out: list = []
        for q in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def hull_area(p: np.ndarray) -> list[float]:
    h = convex_hull(p)
    return [area(h), len(h)]


def min_area_rect(p: np.ndarray) -> list[float]:
    """(cx, cy, width, height, degrees) of the smallest rectangle around the points: a side lies on a side of the hull."""
    h = convex_hull(p)
    if len(h) < 3:
        lo, hi = p.min(0), p.max(0)
        return [*((lo + hi) / 2), float(np.hypot(*(hi - lo))), 0.0, float(np.degrees(np.arctan2(hi[1] - lo[1], hi[0] - lo[0])))]
    best = None
    for e in np.roll(h, -1, axis=0) - h:
        t = np.arctan2(e[1], e[0])
        r = np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
        q = h @ r.T
        lo, hi = q.min(0), q.max(0)
        size = hi - lo
        if best is None or size[0] * size[1] < best[0] - 1e-9:
            best = (size[0] * size[1], r.T @ ((lo + hi) / 2), size, np.degrees(t))
    return [*best[1], *best[2], best[3]]


def enclosing_circle(p: np.ndarray) -> list[float]:
    """(cx, cy, r) of the smallest circle around the points, by incremental construction on the hull."""

    def of(q):
        if len(q) == 1:
            return (*q[0], 0.0)
        if len(q) == 2:
            c = (q[0] + q[1]) / 2
            return (*c, float(np.hypot(*(q[0] - c))))
        (ax, ay), (bx, by), (cx, cy) = q
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if abs(d) < 1e-12:
            return (*q[0], np.inf)
        s = (q**2).sum(1)
        x = (s[0] * (by - cy) + s[1] * (cy - ay) + s[2] * (ay - by)) / d
        y = (s[0] * (cx - bx) + s[1] * (ax - cx) + s[2] * (bx - ax)) / d
        return (x, y, float(np.hypot(ax - x, ay - y)))

    h = convex_hull(p)
    inside = lambda c, q: np.hypot(q[0] - c[0], q[1] - c[1]) <= c[2] * (1 + 1e-9) + 1e-9
    c = of(h[:1])
    for i in range(1, len(h)):
        if inside(c, h[i]):
            continue
        c = of(h[i : i + 1])
        for j in range(i):
            if inside(c, h[j]):
                continue
            c = of(h[[i, j]])
            for k in range(j):
                if not inside(c, h[k]):
                    c = of(h[[i, j, k]])
    return list(c)


def fit_circle(p: np.ndarray) -> list[float]:
    """Algebraic least squares (cx, cy, r)."""
    a = np.concatenate([2 * p, np.ones((len(p), 1))], axis=1)
    x = np.linalg.lstsq(a, (p**2).sum(1), rcond=None)[0]
    return [x[0], x[1], float(np.sqrt(max(0.0, x[2] + x[0] ** 2 + x[1] ** 2)))]


def fit_line(p: np.ndarray) -> list[float]:
    """(cx, cy, dx, dy): centroid and direction of the least total squares line, the larger part of which is positive."""
    c = p.mean(0)
    d = np.linalg.svd(p - c)[2][0]
    return [*c, *(d * np.sign(d[np.abs(d).argmax()]))]


def simplify(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Points of an open line that it needs to stay within ``tolerance``."""
    keep, stack = {0, len(p) - 1}, [(0, len(p) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        d = p[j] - p[i]
        off = np.abs(d[0] * (p[i + 1 : j, 1] - p[i, 1]) - d[1] * (p[i + 1 : j, 0] - p[i, 0])) / max(np.hypot(*d), 1e-12)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep.add(i + 1 + k)
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return p[sorted(keep)]


def affine(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """2x3 least squares."""
    return np.linalg.lstsq(np.concatenate([src, np.ones((len(src), 1))], axis=1), dst, rcond=None)[0].T


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """3x3 by the normalised direct linear transform; last entry 1."""

    def norm(p):
        c = p.mean(0)
        s = np.sqrt(2) / max(np.sqrt(((p - c) ** 2).sum(1)).mean(), 1e-12)
        return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    t, u = norm(src), norm(dst)
    h = lambda p: np.concatenate([p, np.ones((len(p), 1))], axis=1)
    a, b = h(src) @ t.T, h(dst) @ u.T
    rows = np.concatenate([np.concatenate([np.zeros_like(a), -a, b[:, 1:2] * a], 1), np.concatenate([a, np.zeros_like(a), -b[:, :1] * a], 1)])
    m = np.linalg.inv(u) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ t
    return m / m[2, 2]


def apply_homography(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.concatenate([p, np.ones((len(p), 1))], axis=1) @ m.T
    return q[:, :2] / q[:, 2:]


def ransac(src: np.ndarray, dst: np.ndarray, fit: Callable, apply: Callable, size: int, tolerance: float, tries: int = 200, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(model, inlier mask) of the hypothesis with the most inliers, fitted again on them."""
    rng, best = np.random.default_rng(seed), np.zeros(len(src), dtype=bool)
    for _ in range(tries):
        pick = rng.choice(len(src), size, replace=False)
        try:
            near = np.hypot(*(apply(fit(src[pick], dst[pick]), src) - dst).T) <= tolerance
        except np.linalg.LinAlgError:
            continue
        if near.sum() > best.sum():
            best = near
    return fit(src[best], dst[best]), best


def rigid(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, translation) of least squares, without reflection."""
    a, b = src.mean(0), dst.mean(0)
    u, _, vt = np.linalg.svd((src - a).T @ (dst - b))
    fix = np.eye(src.shape[1])
    fix[-1, -1] = np.sign(np.linalg.det(vt.T @ u.T))
    r = vt.T @ fix @ u.T
    return r, b - r @ a


def icp(src: np.ndarray, dst: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, float]:
    """(rotation, translation, rms) that lay ``src`` on ``dst`` by iterated closest points."""
    r, t = np.eye(src.shape[1]), np.zeros(src.shape[1])
    cur, last = src, np.inf
    for _ in range(rounds):
        d = ((cur[:, None] - dst[None]) ** 2).sum(-1)
        near = d.argmin(1)
        rms = float(np.sqrt(d[np.arange(len(cur)), near].mean()))
        dr, dt = rigid(cur, dst[near])
        r, t, cur = dr @ r, dr @ t + dt, cur @ dr.T + dt
        if last - rms < 1e-12:
            break
        last = rms
    return r, t, rms


def normals(p: np.ndarray, k: int) -> np.ndarray:
    """The direction of least spread of each point's k nearest, pointing up in z."""
    near = ((p[:, None] - p[None]) ** 2).sum(-1).argsort(1)[:, :k]
    q = p[near] - p[near].mean(1, keepdims=True)
    n = np.linalg.eigh(np.einsum("nki,nkj->nij", q, q))[1][:, :, 0]
    return n * np.where(n[:, 2:] < 0, -1, 1)


def voxel_downsample(df: DataFrame, leaf: float, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(vx, vy, vz, n, centroid coordinates) of each filled cell."""
    cells = [F.floor(F.col(c) / leaf).alias(f"v{c}") for c in coords]
    return df.groupBy(*cells).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in coords))

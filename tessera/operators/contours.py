"""Contours of binary images and their nesting: one row a contour.

Foreground is 8-connected, background 4-connected. Every region of foreground has one outer contour, every region of
background that the outside does not reach one hole contour, on the foreground pixels around it. An image is one row and
is traced where it lies; nothing is shuffled, and a task holds the regions of one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import kernels, raster

#: Steps (dy, dx) to the eight neighbours, clockwise from the east with y downwards.
RING = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
EAST, WEST = 0, 4
MODES = ("tree", "external", "list", "two_level")


class Contour(NamedTuple):
    hole: bool
    y: int
    x: int
    parent: int  # place in the list of contours, -1 for none
    points: list[tuple[int, int]]


def follow(on: np.ndarray, y: int, x: int, empty: int) -> list[tuple[int, int]]:
    """The closed border through foreground pixel (y, x) along the background on its side ``empty``, by border following.
    Points that the border passes twice are there twice."""
    h, w = on.shape

    def turn(p: tuple[int, int], start: int, step: int) -> int | None:
        """The first direction with foreground, from the one after ``start`` on round to ``start`` itself."""
        for k in range(1, 9):
            d = (start + step * k) % 8
            q, r = p[0] + RING[d][0], p[1] + RING[d][1]
            if 0 <= q < h and 0 <= r < w and on[q, r]:
                return d
        return None

    first = turn((y, x), empty, 1)
    if first is None:
        return [(y, x)]
    last = (y + RING[first][0], x + RING[first][1])
    cur, back, out = (y, x), first, []
    while True:
        out.append(cur)
        d = turn(cur, back, -1)
        nxt = (cur[0] + RING[d][0], cur[1] + RING[d][1])
        if nxt == (y, x) and cur == last:
            return out
        cur, back = nxt, (d + 4) % 8


def corners(points: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The points at which a closed border changes direction; all of one or two points."""
    if len(points) < 3:
        return list(points)
    step = lambda p, q: (q[0] - p[0], q[1] - p[1])
    ring = [points[-1], *points, points[0]]
    return [q for p, q, r in zip(ring, ring[1:], ring[2:], strict=False) if step(p, q) != step(q, r)]


def trace(a: np.ndarray) -> list[list[Contour]]:
    """The contours of each image of a stack in raster order of their starts. An outer contour starts at its region's
    first pixel, that of a hole left of the hole's first pixel."""
    on = a > 0
    fore = kernels.label(on.astype(np.int32), 8)
    back = kernels.label(raster.copy_border((~on).astype(np.int32), 1, 1, 1, 1, "constant", 1), 4)  # 1 is the outside
    out = []
    for img, f, b in zip(on, fore, back, strict=True):
        starts = []
        for number, at in zip(*np.unique(f, return_index=True), strict=True):
            if number > 0:
                starts.append((*divmod(int(at), f.shape[1]), False, int(number)))
        for number, at in zip(*np.unique(b, return_index=True), strict=True):
            if number > 1:
                y, x = divmod(int(at), b.shape[1])
                starts.append((y - 1, x - 2, True, int(number)))
        starts.sort()
        place = {(hole, number): i for i, (_, _, hole, number) in enumerate(starts)}
        found = []
        for y, x, hole, _ in starts:
            # a hole lies in the region of its start; a region lies in the background left of its start
            parent = place[False, int(f[y, x])] if hole else place.get((True, int(b[y + 1, x])), -1)
            found.append(Contour(hole, y, x, parent, follow(img, y, x, EAST if hole else WEST)))
        out.append(found)
    return out


def retrieve(found: list[Contour], mode: str) -> list[Contour]:
    """tree: all with parents; external: outer ones within no other; list: all without parents; two_level: outer ones
    without parents, holes with that of their region."""
    if mode == "external":
        return [c for c in found if c.parent < 0]
    if mode == "list":
        return [c._replace(parent=-1) for c in found]
    if mode == "two_level":
        return [c if c.hole else c._replace(parent=-1) for c in found]
    if mode != "tree":
        raise ValueError(f"unknown mode {mode}, not one of {MODES}")
    return found


def find_contours(df: DataFrame, img: str = "img", keep: Sequence[str] = ("img_id",), shape: tuple[int, int] | None = None, mode: str = "tree", simple: bool = False) -> DataFrame:
    """``keep`` columns, contour (number in the image), parent (-1: none), hole, y, x (its start), ys, xs (its points;
    with ``simple`` only where it turns). Non-zero pixels are foreground; images that are null or have no foreground
    have no rows."""
    retrieve([], mode)
    size = (F.lit(shape[0]).alias("_r"), F.lit(shape[1]).alias("_c")) if shape else (F.col("rows").alias("_r"), F.col("cols").alias("_c"))
    src = df.where(F.size(img) > 0).select(*keep, F.col(img).alias("_img"), *size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_shape: dict[tuple[int, int], list[int]] = {}
            for i, hw in enumerate(zip(batch.column("_r").to_pylist(), batch.column("_c").to_pylist(), strict=True)):
                by_shape.setdefault(hw, []).append(i)
            for (h, w), ids in by_shape.items():
                stack = batch.column("_img").take(pa.array(ids)).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), h, w)
                rows = [(i, k, c) for i, found in zip(ids, trace(stack), strict=True) for k, c in enumerate(retrieve(found, mode))]
                lines = [corners(c.points) if simple else c.points for _, _, c in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).take(pa.array([i for i, _, _ in rows], pa.int64())) for k in keep),
                        pa.array([k for _, k, _ in rows], pa.int32()), pa.array([c.parent for _, _, c in rows], pa.int32()), pa.array([c.hole for _, _, c in rows], pa.bool_()),
                        pa.array([c.y for _, _, c in rows], pa.int32()), pa.array([c.x for _, _, c in rows], pa.int32()),
                        pa.array([[y for y, _ in p] for p in lines], pa.list_(pa.int32())), pa.array([[x for _, x in p] for p in lines], pa.list_(pa.int32())),
                    ],
                    [*keep, "contour", "parent", "hole", "y", "x", "ys", "xs"],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return src.mapInArrow(run, f"{fields}, contour int, parent int, hole boolean, y int, x int, ys array<int>, xs array<int>")

"""Plane geometry over point lists held as arrays of STRUCT<x, y>, and over boxes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(p: Column, f) -> Column:
    """f(point, next point) for each edge of a closed polygon."""
    n = F.size(p)
    return F.transform(p, lambda a, i: f(a, F.get(p, F.pmod(i + 1, n))))


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)


def signed_area(p: Column) -> Column:
    return _total(_edges(p, lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]).cast("double"))) / 2


def area(p: Column) -> Column:
    return F.abs(signed_area(p))


def perimeter(p: Column) -> Column:
    return _total(_edges(p, lambda a, b: F.hypot((b["x"] - a["x"]).cast("double"), (b["y"] - a["y"]).cast("double"))))


def centroid(p: Column) -> tuple[Column, Column]:
    """Of the polygon's area; null if that is 0."""
    six = F.nullif(6 * signed_area(p), F.lit(0.0))
    return tuple(_total(_edges(p, _moment(k))) / six for k in ("x", "y"))


def _moment(k: str):
    return lambda a, b: (a[k] + b[k]) * (a["x"] * b["y"] - b["x"] * a["y"]).cast("double")


def is_convex(p: Column) -> Column:
    """Whether all turns have one sign; straight runs are allowed."""
    n = F.size(p)

    def turn(a: Column, i: Column) -> Column:
        b, c = F.get(p, F.pmod(i + 1, n)), F.get(p, F.pmod(i + 2, n))
        return F.signum(((b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])).cast("double"))

    turns = F.transform(p, turn)
    return ~(F.exists(turns, lambda t: t > 0) & F.exists(turns, lambda t: t < 0))


def contains(p: Column, x: Column, y: Column) -> Column:
    """1 inside, 0 on an edge, -1 outside, by ray crossing."""
    fx, fy = x.cast("double"), y.cast("double")

    def on(a: Column, b: Column) -> Column:
        cross = (b["x"] - a["x"]) * (fy - a["y"]) - (b["y"] - a["y"]) * (fx - a["x"])
        return (cross == 0) & fx.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & fy.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    def hit(a: Column, b: Column) -> Column:
        spans = (a["y"] > fy) != (b["y"] > fy)
        at = (b["x"] - a["x"]) * (fy - a["y"]) / F.nullif((b["y"] - a["y"]).cast("double"), F.lit(0.0)) + a["x"]
        return F.when(spans & (fx < at), 1.0).otherwise(0.0)

    return F.when(F.exists(_edges(p, on), lambda v: v), 0).when(_total(_edges(p, hit)) % 2 == 1, 1).otherwise(-1)


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether the closed segments ab and cd meet."""
    side = lambda px, py, qx, qy, rx, ry: F.signum(((qx - px) * (ry - py) - (qy - py) * (rx - px)).cast("double"))
    o1, o2, o3, o4 = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy), side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)
    within = lambda px, py, qx, qy, rx, ry: rx.between(F.least(px, qx), F.greatest(px, qx)) & ry.between(F.least(py, qy), F.greatest(py, qy))
    return ((o1 != o2) & (o3 != o4)) | ((o1 == 0) & within(ax, ay, bx, by, cx, cy)) | ((o2 == 0) & within(ax, ay, bx, by, dx, dy)) | ((o3 == 0) & within(cx, cy, dx, dy, ax, ay)) | ((o4 == 0) & within(cx, cy, dx, dy, bx, by))


def box_intersection(a: Column, b: Column) -> Column:
    """Area that boxes STRUCT<x, y, w, h> share."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return (F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))).cast("double")


def iou(a: Column, b: Column) -> Column:
    """Shared area over joint area; 0 for empty boxes."""
    i = box_intersection(a, b)
    u = a["w"] * a["h"] + b["w"] * b["h"] - i
    return F.when(u <= 0, 0.0).otherwise(i / F.nullif(u.cast("double"), F.lit(0.0)))


def points(*xy: tuple[Column, Column]) -> Column:
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in xy))

"""Linear algebra, set, sort and point queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import linalg as A
from tessera.operators import points as G
from tessera.operators import raster as R
from tessera.plans.common import IMG, SIDE, image_pairs, images, pixels, table
from tessera.plans.registry import register


def _eliminated(n: int) -> str:
    """e0 to en: a matrix (img_id, i, j, v) of n rows, wider than it is high, whose first n columns become the identity."""
    step = "SELECT e.img_id, e.i, e.j, CASE WHEN e.i = {k} THEN e.v / p.v ELSE e.v - c.v * r.v / p.v END AS v FROM e{k} e JOIN e{k} p ON p.img_id = e.img_id AND p.i = {k} AND p.j = {k} JOIN e{k} c ON c.img_id = e.img_id AND c.i = e.i AND c.j = {k} JOIN e{k} r ON r.img_id = e.img_id AND r.i = {k} AND r.j = e.j"
    return "".join(f", e{k + 1} AS ({step.format(k=k)})" for k in range(n))


_BASE = f"WITH {IMG}, a AS (SELECT img_id, y, x, v / 16.0::DOUBLE + CASE WHEN y = x THEN 64 ELSE 0 END AS v FROM img)"
_INVERSE = f"{_BASE}, e0 AS (SELECT img_id, y AS i, x AS j, v FROM a UNION ALL SELECT img_id, y, x + 8, CASE WHEN y = x THEN 1.0::DOUBLE ELSE 0 END FROM a){_eliminated(8)} SELECT img_id, i AS y, j - 8 AS x, round(v + 0.0, 6) + 0.0 AS v FROM e8 WHERE j >= 8"
# eight equations in six unknowns, the seventh column being the right side: normal equations
_SOLVED = f"{_BASE}, e0 AS (SELECT p.img_id, p.x AS i, q.x AS j, sum(p.v * q.v) AS v FROM a p JOIN a q ON q.img_id = p.img_id AND q.y = p.y WHERE p.x < 6 AND q.x < 7 GROUP BY 1, 2, 3){_eliminated(6)} SELECT img_id, i AS y, 0 AS x, round(v + 0.0, 6) + 0.0 AS v FROM e6 WHERE j = 6"


def _m(name: str, kernel, digits: int = 6, sql: str | None = None) -> None:
    def query(s, d):
        out = R.to_pixels(R.map_images(images(s, d), kernel, shape=(SIDE, SIDE), kind="double"))
        return out.withColumn("v", F.round(F.col("v") + 0.0, digits) + 0.0)

    register(name, query, sql)


_scaled = lambda a: np.asarray(a, float) / 16
_m("matrix_inverse", lambda a: A.inverse(_scaled(a) + np.eye(SIDE) * 64), 6, _INVERSE)
_m("matrix_solve", lambda a: A.solve((_scaled(a) + np.eye(SIDE) * 64)[:, :, : SIDE - 1]), 6, _SOLVED)
_m("matrix_eigen", lambda a: A.eigen_symmetric(_scaled(a)), 4)
_m("singular_values", A.singular_values, 4)
register(
    "matrix_trace_det2",
    lambda s, d: images(s, d).select("img_id", (F.get("img", F.lit(0)) + F.get("img", F.lit(9))).alias("trace"), (F.get("img", F.lit(0)) * F.get("img", F.lit(9)) - F.get("img", F.lit(1)) * F.get("img", F.lit(8))).alias("det")),
    f"WITH {IMG}, p AS (SELECT img_id, max(v) FILTER (y = 0 AND x = 0) AS a, max(v) FILTER (y = 0 AND x = 1) AS b, max(v) FILTER (y = 1 AND x = 0) AS c, max(v) FILTER (y = 1 AND x = 1) AS d FROM img GROUP BY 1) SELECT img_id, a + d AS trace, a * d - b * c AS det FROM p",
)
_REL = lambda df: df.select(F.col("img_id").alias("i"), (F.col("y") * 8 + F.col("x")).alias("j"), F.col("v").cast("bigint").alias("v"))


def _gemm(s, d):
    """The matrix of all images, a row each, by a fixed one of 64 rows and 8 columns."""
    b = s.range(512).select(F.floor(F.col("id") / 8).cast("int").alias("i"), (F.col("id") % 8).cast("int").alias("j"))
    return A.multiply(_REL(pixels(images(s, d), F.col("img"))), b.withColumn("v", ((F.col("i") * 7 + F.col("j") * 3) % 11 - 5).cast("bigint")))


register("matrix_multiply", _gemm, f"WITH {IMG} SELECT img_id AS i, j, CAST(sum(v * (((y * 8 + x) * 7 + j * 3) % 11 - 5)) AS BIGINT) AS v FROM img, (SELECT CAST(range AS INT) AS j FROM range(8)) c GROUP BY 1, 2")
register("gram_matrix", lambda s, d: A.gram(images(s, d), "img_id", "img"), f"WITH {IMG} SELECT a.y * 8 + a.x AS i, b.y * 8 + b.x AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM img a JOIN img b ON a.img_id = b.img_id GROUP BY 1, 2")

# masks as sets of foreground coordinates
_FG = lambda s, d, c: pixels(image_pairs(s, d), F.col(c)).where("v > 130").select("img_id", "y", "x")
_MS = f"WITH {IMG}, a AS (SELECT img_id, y, x FROM img WHERE v > 130 AND img_id + 1 IN (SELECT img_id FROM img)), b AS (SELECT img_id - 1 AS img_id, y, x FROM img WHERE v > 130 AND img_id - 1 IN (SELECT img_id FROM img)) "
register("mask_union", lambda s, d: _FG(s, d, "a").union(_FG(s, d, "b")).distinct(), _MS + "SELECT * FROM a UNION SELECT * FROM b")
register("mask_intersect", lambda s, d: _FG(s, d, "a").intersect(_FG(s, d, "b")), _MS + "SELECT * FROM a INTERSECT SELECT * FROM b")
register("mask_difference", lambda s, d: _FG(s, d, "a").subtract(_FG(s, d, "b")), _MS + "SELECT * FROM a EXCEPT SELECT * FROM b")
register("mask_xor", lambda s, d: (lambda a, b: a.subtract(b).union(b.subtract(a)))(_FG(s, d, "a"), _FG(s, d, "b")), _MS + "(SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a)")
register("sort_index", lambda s, d: pixels(images(s, d), F.col("img")).withColumn("rank", F.row_number().over(Window.partitionBy("img_id").orderBy("v", "y", "x"))).select("img_id", "y", "x", "rank"), f"WITH {IMG} SELECT img_id, y, x, CAST(row_number() OVER (PARTITION BY img_id ORDER BY v, y, x) AS INT) AS rank FROM img")
register("top_pixels", lambda s, d: pixels(images(s, d), F.col("img")).withColumn("rank", F.row_number().over(Window.partitionBy("img_id").orderBy(F.desc("v"), "y", "x"))).where("rank <= 3").select("img_id", "y", "x", "v"), f"WITH {IMG} SELECT img_id, y, x, v FROM (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY v DESC, y, x) AS r FROM img) t WHERE r <= 3")

_FGP = lambda s, d: pixels(images(s, d), F.col("img")).where("v > 140").select("img_id", "x", "y")
register("hull_area", lambda s, d: G.per_group(_FGP(s, d), "img_id", ["x", "y"], G.hull_area, ["area", "corners"]))
register("min_area_rect", lambda s, d: G.per_group(_FGP(s, d), "img_id", ["x", "y"], lambda p: [round(v, 6) for v in G.min_area_rect(p)], ["cx", "cy", "w", "h", "angle"]))
register("enclosing_circle", lambda s, d: G.per_group(_FGP(s, d), "img_id", ["x", "y"], lambda p: [round(v, 6) for v in G.enclosing_circle(p)], ["cx", "cy", "r"]))
register("point_cloud_voxels", lambda s, d: G.voxel_downsample(table(s, d, "part").selectExpr("cast(p_size AS double) AS x", "p_retailprice / 100 AS y", "cast(p_partkey % 50 AS double) AS z"), 10.0).select("vx", "vy", "vz", "n", *(F.round(c, 6).alias(c) for c in "xyz")), "SELECT CAST(floor(p_size / 10.0::DOUBLE) AS BIGINT) AS vx, CAST(floor(p_retailprice / 100 / 10.0::DOUBLE) AS BIGINT) AS vy, CAST(floor((p_partkey % 50) / 10.0::DOUBLE) AS BIGINT) AS vz, count(*) AS n, round(avg(CAST(p_size AS DOUBLE)), 6) AS x, round(avg(p_retailprice / 100), 6) AS y, round(avg(CAST(p_partkey % 50 AS DOUBLE)), 6) AS z FROM part GROUP BY 1, 2, 3")

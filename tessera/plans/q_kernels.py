"""Whole-image queries: components, edges, transforms and filters on the 8x8 images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import kernels as K
from tessera.operators import raster as R
from tessera.plans.common import _PAIRS, IMG, SIDE, image_pairs, images, u8
from tessera.plans.registry import register

N = SIDE


def _q(name: str, value, sql: str | None = None, kind: str = "int", digits: int | None = None) -> None:
    def query(s, d):
        out = R.to_pixels(R.map_images(images(s, d), value, shape=(N, N), kind=kind))
        return out if digits is None else out.withColumn("v", F.round(F.col("v") + 0.0, digits) + 0.0)

    register(name, query, sql)


_ON = "o AS (SELECT img_id, y, x FROM img WHERE v > 140)"


def _components(near: str) -> str:
    return f"WITH RECURSIVE {IMG}, {_ON}, r AS (SELECT img_id, y, x, y * 8 + x AS root FROM o UNION SELECT b.img_id, b.y, b.x, r.root FROM r JOIN o b ON b.img_id = r.img_id AND {near}), m AS (SELECT img_id, y, x, min(root) AS root FROM r GROUP BY 1, 2, 3), l AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY img_id ORDER BY root) AS INT) AS k FROM m) SELECT img.img_id, img.y, img.x, coalesce(l.k, 0) AS v FROM img LEFT JOIN l USING (img_id, y, x)"


_q("connected_components_8", lambda a: K.label(np.where(a > 140, 255, 0), 8), _components("abs(b.y - r.y) <= 1 AND abs(b.x - r.x) <= 1"))
_q("connected_components_4", lambda a: K.label(np.where(a > 140, 255, 0), 4), _components("abs(b.y - r.y) + abs(b.x - r.x) = 1"))
register(
    "component_stats",
    lambda s, d: R.to_pixels(R.map_images(images(s, d), lambda a: K.label(np.where(a > 140, 255, 0), 8), shape=(N, N))).groupBy("img_id", F.col("v").alias("label")).agg(F.count("*").alias("area"), F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom"), F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy")),
    f"SELECT img_id, v AS label, count(*) AS area, min(x) AS \"left\", min(y) AS top, max(x) AS \"right\", max(y) AS bottom, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM ({_components('abs(b.y - r.y) <= 1 AND abs(b.x - r.x) <= 1')}) t GROUP BY 1, 2",
)
_q("hysteresis", lambda a: K.hysteresis(a, 130, 170), f"WITH RECURSIVE {IMG}, o AS (SELECT img_id, y, x, v FROM img WHERE v >= 130), r AS (SELECT img_id, y, x FROM o WHERE v >= 170 UNION SELECT b.img_id, b.y, b.x FROM r JOIN o b ON b.img_id = r.img_id AND abs(b.y - r.y) <= 1 AND abs(b.x - r.x) <= 1) SELECT img.img_id, img.y, img.x, CASE WHEN r.img_id IS NULL THEN 0 ELSE 255 END AS v FROM img LEFT JOIN r USING (img_id, y, x)")
_q("flood_fill", lambda a: K.flood_fill(a, 3, 3, 0, 20), f"WITH RECURSIVE {IMG}, s AS (SELECT img_id, v AS sv FROM img WHERE y = 3 AND x = 3), o AS (SELECT img.* FROM img JOIN s USING (img_id) WHERE abs(v - sv) <= 20), r AS (SELECT img_id, y, x FROM o WHERE y = 3 AND x = 3 UNION SELECT b.img_id, b.y, b.x FROM r JOIN o b ON b.img_id = r.img_id AND abs(b.y - r.y) + abs(b.x - r.x) = 1) SELECT img.img_id, img.y, img.x, CASE WHEN r.img_id IS NULL THEN v ELSE 0 END AS v FROM img LEFT JOIN r USING (img_id, y, x)")
_q("distance_transform", lambda a: K.distance_transform(np.where(a > 110, 255, 0)), f"WITH {IMG} SELECT p.img_id, p.y, p.x, round(coalesce(min(sqrt(CAST((p.y-z.y)*(p.y-z.y)+(p.x-z.x)*(p.x-z.x) AS DOUBLE))), 'inf'::DOUBLE), 6) AS v FROM img p LEFT JOIN img z ON z.img_id = p.img_id AND z.v <= 110 GROUP BY 1, 2, 3", "double", 6)
_q("region_outlines", lambda a: K.contours(np.where(a > 140, 255, 0)), f"WITH {IMG} SELECT p.img_id, p.y, p.x, CASE WHEN p.v > 140 AND count(q.v) FILTER (q.v > 140) < 4 THEN 255 ELSE 0 END AS v FROM img p LEFT JOIN img q ON q.img_id = p.img_id AND abs(q.y - p.y) + abs(q.x - p.x) = 1 GROUP BY p.img_id, p.y, p.x, p.v")
_COS = "b AS (SELECT CAST(k.range AS INT) AS k, CAST(n.range AS INT) AS n, cos(pi() * (2 * n.range + 1) * k.range / 16) * CASE WHEN k.range = 0 THEN sqrt(0.125::DOUBLE) ELSE 0.5 END AS c FROM range(8) k, range(8) n)"
_q("dct_2d", K.dct2, f"WITH {IMG}, {_COS} SELECT img_id, cy.k AS y, cx.k AS x, round(sum(v * cy.c * cx.c) + 0.0, 4) + 0.0 AS v FROM img JOIN b cy ON cy.n = y JOIN b cx ON cx.n = x GROUP BY 1, 2, 3", "double", 4)
_q("dft_magnitude", K.dft_magnitude, f"WITH {IMG}, f AS (SELECT img_id, u.range AS u, w.range AS w, sum(v * cos(pi() * (u.range * y + w.range * x) / 4)) AS re, sum(v * sin(pi() * (u.range * y + w.range * x) / 4)) AS im FROM img, range(8) u, range(8) w GROUP BY 1, 2, 3) SELECT img_id, CAST(u AS INT) AS y, CAST(w AS INT) AS x, round(sqrt(re * re + im * im), 4) AS v FROM f", "double", 4)
_q("haar_wavelet", K.haar, f"WITH {IMG} SELECT img_id, CAST(y // 2 + 4 * ky AS INT) AS y, CAST(x // 2 + 4 * kx AS INT) AS x, sum(v * (1 - 2 * ky * (y % 2)) * (1 - 2 * kx * (x % 2))) / 4.0::DOUBLE AS v FROM img, (VALUES (0), (1)) a(ky), (VALUES (0), (1)) b(kx) GROUP BY 1, 2, 3", "double", 6)
_q("template_sqdiff", lambda a: K.match_template(a, np.array([[120, 130], [130, 140]]), "sqdiff"), f"WITH {IMG}, t(dy, dx, w) AS (VALUES (0,0,120),(0,1,130),(1,0,130),(1,1,140)) SELECT p.img_id, p.y, p.x, CAST(sum((q.v - w) * (q.v - w)) AS INT) AS v FROM img p CROSS JOIN t JOIN img q ON q.img_id = p.img_id AND q.y = p.y + dy AND q.x = p.x + dx WHERE p.y < 7 AND p.x < 7 GROUP BY 1, 2, 3")
_q("template_ncc", lambda a: K.match_template(a, np.array([[120, 130], [130, 140]]), "ncc"), f"WITH {IMG}, t(dy, dx, w) AS (VALUES (0,0,-10.0::DOUBLE),(0,1,0.0),(1,0,0.0),(1,1,10.0)), m AS (SELECT p.img_id, p.y, p.x, sum(q.v * w) AS num, sum(CAST(q.v * q.v AS DOUBLE)) - sum(q.v) * sum(q.v) / 4.0::DOUBLE AS e FROM img p CROSS JOIN t JOIN img q ON q.img_id = p.img_id AND q.y = p.y + dy AND q.x = p.x + dx WHERE p.y < 7 AND p.x < 7 GROUP BY 1, 2, 3) SELECT img_id, y, x, round(CASE WHEN e <= 0 THEN 0 ELSE num / sqrt(e * 200) END + 0.0, 6) + 0.0 AS v FROM m", "double", 6)
_HV = "h AS (SELECT img_id, k.range AS k, CAST(floor(x * cos(k.range * pi() / 4) + y * sin(k.range * pi() / 4) + 0.5) AS INT) AS rho, count(*) AS n FROM img, range(4) k WHERE v > 140 GROUP BY 1, 2, 3)"
register("hough_lines", lambda s, d: R.to_pixels(R.map_images(images(s, d), lambda a: K.hough_lines(np.where(a > 140, 1, 0), 4), shape=(N, N), kind="bigint")).where("v > 0").select("img_id", F.col("y").alias("theta"), (F.col("x") - 12).alias("rho"), F.col("v").alias("votes")), f"WITH {IMG}, {_HV} SELECT img_id, CAST(k AS INT) AS theta, rho, n AS votes FROM h")
_CLAMP = "greatest(0, least(7, p.y + k.dy)) = q.y AND greatest(0, least(7, p.x + k.dx)) = q.x"
_TENSOR = f"{IMG}, k(dy, dx, sx, sy) AS (VALUES (-1,-1,-1,-1),(-1,0,0,-2),(-1,1,1,-1),(0,-1,-2,0),(0,0,0,0),(0,1,2,0),(1,-1,-1,1),(1,0,0,2),(1,1,1,1)), g AS (SELECT p.img_id, p.y, p.x, sum(q.v * k.sx) AS gx, sum(q.v * k.sy) AS gy FROM img p CROSS JOIN k JOIN img q ON q.img_id = p.img_id AND {_CLAMP} GROUP BY 1, 2, 3), t AS (SELECT p.img_id, p.y, p.x, CAST(sum(q.gx * q.gx) AS DOUBLE) AS xx, CAST(sum(q.gy * q.gy) AS DOUBLE) AS yy, CAST(sum(q.gx * q.gy) AS DOUBLE) AS xy FROM img p CROSS JOIN k JOIN g q ON q.img_id = p.img_id AND {_CLAMP} GROUP BY 1, 2, 3)"
_q("harris", K.corner_response, f"WITH {_TENSOR} SELECT img_id, y, x, round(xx * yy - xy * xy - 0.04::DOUBLE * ((xx + yy) * (xx + yy)), 3) AS v FROM t", "double", 3)
_q("min_eigenvalue", K.min_eigenvalue, f"WITH {_TENSOR} SELECT img_id, y, x, round((xx + yy) / 2 - sqrt(greatest(0, ((xx - yy) / 2) * ((xx - yy) / 2) + xy * xy)), 3) AS v FROM t", "double", 3)
_EDGES = (
    f"{IMG}, s AS (SELECT CAST(range - 2 AS INT) AS d, exp(-(range - 2) * (range - 2) / 3.92::DOUBLE) AS w FROM range(5)), b AS (SELECT p.img_id, p.y, p.x, sum(q.v * a.w * c.w) / pow((SELECT sum(w) FROM s), 2) AS v FROM img p CROSS JOIN s a CROSS JOIN s c JOIN img q ON q.img_id = p.img_id AND q.y = greatest(0, least(7, p.y + a.d)) AND q.x = greatest(0, least(7, p.x + c.d)) GROUP BY 1, 2, 3), "
    f"k(dy, dx, sx, sy) AS (VALUES (-1,-1,-1,-1),(-1,0,0,-2),(-1,1,1,-1),(0,-1,-2,0),(0,1,2,0),(1,-1,-1,1),(1,0,0,2),(1,1,1,1)), g AS (SELECT p.img_id, p.y, p.x, sum(q.v * k.sx) AS gx, sum(q.v * k.sy) AS gy FROM b p CROSS JOIN k JOIN b q ON q.img_id = p.img_id AND {_CLAMP} GROUP BY 1, 2, 3), "
    "a AS (SELECT *, sqrt(gx * gx + gy * gy) AS m, degrees(atan2(gy, gx)) - 180 * floor(degrees(atan2(gy, gx)) / 180) AS t FROM g), z AS (SELECT *, CASE WHEN t < 22.5 OR t >= 157.5 THEN 0 WHEN t < 67.5 THEN 1 WHEN t < 112.5 THEN 1 ELSE 1 END AS dy, CASE WHEN t < 22.5 OR t >= 157.5 THEN 1 WHEN t < 67.5 THEN 1 WHEN t < 112.5 THEN 0 ELSE -1 END AS dx FROM a), "
    "o AS (SELECT z.img_id, z.y, z.x, z.m FROM z JOIN z f ON f.img_id = z.img_id AND f.y = z.y + z.dy AND f.x = z.x + z.dx JOIN z h ON h.img_id = z.img_id AND h.y = z.y - z.dy AND h.x = z.x - z.dx WHERE z.m >= f.m AND z.m >= h.m AND z.m >= 40 AND z.y BETWEEN 1 AND 6 AND z.x BETWEEN 1 AND 6), "
    "r AS (SELECT img_id, y, x FROM o WHERE m >= 120 UNION SELECT o.img_id, o.y, o.x FROM r JOIN o ON o.img_id = r.img_id AND abs(o.y - r.y) <= 1 AND abs(o.x - r.x) <= 1)"
)
_q("canny", lambda a: K.canny(a, 40, 120), f"WITH RECURSIVE {_EDGES} SELECT img.img_id, img.y, img.x, CASE WHEN r.img_id IS NULL THEN 0 ELSE 255 END AS v FROM img LEFT JOIN r USING (img_id, y, x)")
_CIRCLE = "c(k, dy, dx) AS (VALUES (0,-3,0),(1,-3,1),(2,-2,2),(3,-1,3),(4,0,3),(5,1,3),(6,2,2),(7,3,1),(8,3,0),(9,3,-1),(10,2,-2),(11,1,-3),(12,0,-3),(13,-1,-3),(14,-2,-2),(15,-3,-1))"
_q("fast_corners", lambda a: K.fast_corners(a, 10), f"WITH {IMG}, {_CIRCLE}, t AS (SELECT p.img_id, p.y, p.x, c.k, q.v > p.v + 10 AS up, q.v < p.v - 10 AS down FROM img p CROSS JOIN c JOIN img q ON q.img_id = p.img_id AND q.y = p.y + dy AND q.x = p.x + dx WHERE p.y IN (3, 4) AND p.x IN (3, 4)), a AS (SELECT img_id, y, x, s.range AS s, bool_and(up) OR bool_and(down) AS hit FROM t JOIN range(16) s ON (t.k - s.range + 16) % 16 < 9 GROUP BY 1, 2, 3, 4), o AS (SELECT img_id, y, x, bool_or(hit) AS hit FROM a GROUP BY 1, 2, 3) SELECT img.img_id, img.y, img.x, CASE WHEN o.hit THEN 255 ELSE 0 END AS v FROM img LEFT JOIN o USING (img_id, y, x)")
_RING = lambda r: f"k(dy, dx) AS (SELECT a.range - {r}, b.range - {r} FROM range({2 * r + 1}) a, range({2 * r + 1}) b)"
_q("bilateral", lambda a: K.bilateral(a, 5, 30.0, 2.0), f"WITH {IMG}, {_RING(2)}, t AS (SELECT p.img_id, p.y, p.x, q.v, exp(-(dy * dy + dx * dx) / 8.0::DOUBLE - (q.v - p.v) * (q.v - p.v) / 1800.0::DOUBLE) AS w FROM img p CROSS JOIN k JOIN img q ON q.img_id = p.img_id AND {_CLAMP}) SELECT img_id, y, x, {u8('sum(w * v) / sum(w)')} AS v FROM t GROUP BY 1, 2, 3")
_q("non_local_means", lambda a: K.non_local_means(a, 5, 3, 20.0), f"WITH {IMG}, {_RING(2)}, u AS (SELECT p.img_id, p.y, p.x, k.dy AS oy, k.dx AS ox, q.v, (p.v - q.v) * (p.v - q.v) AS e FROM img p CROSS JOIN k JOIN img q ON q.img_id = p.img_id AND {_CLAMP}), n AS (SELECT * FROM k WHERE abs(dy) <= 1 AND abs(dx) <= 1), d AS (SELECT p.img_id, p.y, p.x, p.oy, p.ox, p.v, exp(-(sum(q.e) / 9.0::DOUBLE) / 400.0::DOUBLE) AS w FROM u p CROSS JOIN n k JOIN u q ON q.img_id = p.img_id AND q.oy = p.oy AND q.ox = p.ox AND {_CLAMP} GROUP BY 1, 2, 3, 4, 5, 6) SELECT img_id, y, x, {u8('sum(w * v) / sum(w)')} AS v FROM d GROUP BY 1, 2, 3")
_q("guided_filter", lambda a: K.guided_filter(a, a, 3, 100.0), f"WITH {IMG}, {_RING(1)}, m AS (SELECT p.img_id, p.y, p.x, p.v, sum(q.v) / 9.0::DOUBLE AS m, sum(q.v * q.v) / 9.0::DOUBLE AS mm FROM img p CROSS JOIN k JOIN img q ON q.img_id = p.img_id AND {_CLAMP} GROUP BY 1, 2, 3, 4), c AS (SELECT *, (mm - m * m) / (mm - m * m + 100) AS a FROM m), e AS (SELECT *, m - a * m AS b FROM c) SELECT p.img_id, p.y, p.x, {u8('sum(q.a) / 9.0::DOUBLE * p.v + sum(q.b) / 9.0::DOUBLE')} AS v FROM e p CROSS JOIN k JOIN e q ON q.img_id = p.img_id AND {_CLAMP} GROUP BY p.img_id, p.y, p.x, p.v")
_FLOW = "".join(f", d{i + 1} AS (SELECT p.img_id, p.y, p.x, p.v + 0.2::DOUBLE * sum(exp(-((q.v - p.v) / 20.0::DOUBLE) * ((q.v - p.v) / 20.0::DOUBLE)) * (q.v - p.v)) AS v FROM d{i} p CROSS JOIN k JOIN d{i} q ON q.img_id = p.img_id AND {_CLAMP} GROUP BY p.img_id, p.y, p.x, p.v)" for i in range(5))
_q("anisotropic_diffusion", lambda a: K.anisotropic_diffusion(a, 5, 20.0), f"WITH {IMG}, k(dy, dx) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)), d0 AS (SELECT img_id, y, x, CAST(v AS DOUBLE) AS v FROM img){_FLOW} SELECT img_id, y, x, {u8('v')} AS v FROM d5")
# four tiles of 4 x 4 pixels, counts clipped at one: a level's share is the tile's distinct levels up to it and a part of the excess
_TILES = (
    f"{IMG}, l AS (SELECT DISTINCT img_id, y // 4 AS ty, x // 4 AS tx, v FROM img), e AS (SELECT img_id, ty, tx, 16 - count(*) AS over FROM l GROUP BY 1, 2, 3), "
    "p AS (SELECT *, floor((y + 0.5) / 4 - 0.5) AS y0, floor((x + 0.5) / 4 - 0.5) AS x0 FROM img), "
    "n AS (SELECT img_id, y, x, v, greatest(0, least(1, y0 + a.range)) AS ty, greatest(0, least(1, x0 + b.range)) AS tx, CASE WHEN a.range = 1 THEN (y + 0.5) / 4.0::DOUBLE - 0.5 - y0 ELSE 1.5 + y0 - (y + 0.5) / 4.0::DOUBLE END * CASE WHEN b.range = 1 THEN (x + 0.5) / 4.0::DOUBLE - 0.5 - x0 ELSE 1.5 + x0 - (x + 0.5) / 4.0::DOUBLE END AS w FROM p, range(2) a, range(2) b), "
    "d AS (SELECT DISTINCT img_id, y, x, v, ty, tx FROM n), s AS (SELECT d.img_id, d.y, d.x, d.ty, d.tx, count(*) FILTER (l.v <= d.v) AS below FROM d JOIN l USING (img_id, ty, tx) GROUP BY 1, 2, 3, 4, 5)"
)
_q("clahe", lambda a: K.clahe(a, 2, 4.0), f"WITH {_TILES} SELECT img_id, y, x, {u8('sum(w * (below + (v + 1) * over / 256.0::DOUBLE) * (255 / 16.0::DOUBLE))')} AS v FROM n JOIN e USING (img_id, ty, tx) JOIN s USING (img_id, y, x, ty, tx) GROUP BY 1, 2, 3")
_SPECTRUM = f"{IMG}, f AS (SELECT img_id, u.range AS u, w.range AS w, sum(v * cos(pi() * (u.range * y + w.range * x) / 4)) AS re, sum(v * sin(pi() * (u.range * y + w.range * x) / 4)) AS im FROM img, range(8) u, range(8) w GROUP BY 1, 2, 3)"
_back = lambda gain: f"WITH {_SPECTRUM}, h AS (SELECT *, {gain} AS g FROM f) SELECT img_id, CAST(yy.range AS INT) AS y, CAST(xx.range AS INT) AS x, {u8('sum(g * (re * cos(pi() * (u * yy.range + w * xx.range) / 4) + im * sin(pi() * (u * yy.range + w * xx.range) / 4))) / 64')} AS v FROM h, range(8) yy, range(8) xx GROUP BY 1, 2, 3"
_q("butterworth_lowpass", lambda a: R.u8(K.butterworth_lowpass(a, 0.25)), _back("1 / (1 + pow((least(u, 8 - u) * least(u, 8 - u) + least(w, 8 - w) * least(w, 8 - w)) / 64.0::DOUBLE * 16, 2))"))
_BOX = "((1 + 2 * cos(pi() * u / 4)) * (1 + 2 * cos(pi() * w / 4)) / 9)"
_q("wiener", lambda a: R.u8(K.wiener(a, np.full((3, 3), 1 / 9), 0.01)), _back(f"{_BOX} / ({_BOX} * {_BOX} + 0.01::DOUBLE)"))
_q("watershed", lambda a: K.watershed(a, np.where(a <= np.partition(a.reshape(len(a), -1), 3, axis=1)[:, 3][:, None, None], K.label(np.ones_like(a)) + np.arange(N * N).reshape(N, N), 0)), None, "bigint")
_THIN = "".join(f", e{i + 1} AS (SELECT p.img_id, p.y, p.x FROM e{i} p JOIN e{i} q ON q.img_id = p.img_id AND abs(q.y - p.y) + abs(q.x - p.x) = 1 GROUP BY 1, 2, 3 HAVING count(*) = 4)" for i in range(5))
_KEPT = " UNION ".join(f"SELECT p.img_id, p.y, p.x FROM e{i} p WHERE NOT EXISTS (SELECT 1 FROM e{i + 1} q WHERE q.img_id = p.img_id AND abs(q.y - p.y) + abs(q.x - p.x) <= 1)" for i in range(5))
_q("skeleton", lambda a: K.skeleton(np.where(a > 128, 255, 0)), f"WITH {IMG}, e0 AS (SELECT img_id, y, x FROM img WHERE v > 128){_THIN}, s AS ({_KEPT}) SELECT img.img_id, img.y, img.x, CASE WHEN s.img_id IS NULL THEN 0 ELSE 255 END AS v FROM img LEFT JOIN s USING (img_id, y, x)")
_q("superpixels", lambda a: K.superpixels(a, 4, 10.0), None, "bigint")
_q("inpaint", lambda a: K.inpaint(a, np.where(a > 170, 255, 0)))
_RESIDUAL = (
    f"{_SPECTRUM}, l AS (SELECT *, ln(sqrt(re * re + im * im) + 1e-9::DOUBLE) AS l, atan2(-im, re) AS phase FROM f), k AS (SELECT a.range - 1 AS du, b.range - 1 AS dw FROM range(3) a, range(3) b), "
    "g AS (SELECT p.img_id, p.u, p.w, p.phase, exp(p.l - sum(q.l) / 9) AS m FROM l p CROSS JOIN k JOIN l q ON q.img_id = p.img_id AND q.u = greatest(0, least(7, p.u + du)) AND q.w = greatest(0, least(7, p.w + dw)) GROUP BY p.img_id, p.u, p.w, p.phase, p.l), "
    "b AS (SELECT img_id, yy.range AS y, xx.range AS x, pow(sum(m * cos(phase + pi() * (u * yy.range + w * xx.range) / 4)) / 64, 2) + pow(sum(m * sin(phase + pi() * (u * yy.range + w * xx.range) / 4)) / 64, 2) AS v FROM g, range(8) yy, range(8) xx GROUP BY 1, 2, 3), "
    "s AS (SELECT range - 2 AS d, exp(-(range - 2) * (range - 2) / 2.0::DOUBLE) AS w FROM range(5)), t AS (SELECT p.img_id, p.y, p.x, sum(q.v * a.w * c.w) / pow((SELECT sum(w) FROM s), 2) AS v FROM b p CROSS JOIN s a CROSS JOIN s c JOIN b q ON q.img_id = p.img_id AND q.y = greatest(0, least(7, p.y + a.d)) AND q.x = greatest(0, least(7, p.x + c.d)) GROUP BY 1, 2, 3), "
    "r AS (SELECT *, min(v) OVER (PARTITION BY img_id) AS low, max(v) OVER (PARTITION BY img_id) AS high FROM t)"
)
_q("saliency", K.saliency, f"WITH {_RESIDUAL} SELECT img_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {u8('(v - low) / greatest(high - low, 1e-12::DOUBLE) * 255')} AS v FROM r")
_q("fill_holes", lambda a: R.fill_holes(np.where(a > 128, 255, 0)), f"WITH RECURSIVE {IMG}, o AS (SELECT img_id, y, x FROM img WHERE v <= 128), r AS (SELECT img_id, y, x FROM o WHERE y IN (0, 7) OR x IN (0, 7) UNION SELECT o.img_id, o.y, o.x FROM r JOIN o ON o.img_id = r.img_id AND abs(o.y - r.y) + abs(o.x - r.x) = 1) SELECT img.img_id, img.y, img.x, CASE WHEN r.img_id IS NULL THEN 255 ELSE 0 END AS v FROM img LEFT JOIN r USING (img_id, y, x)")


def _resampled(weight: str, reach: int) -> str:
    """8 -> 12 samples with a kernel of the distance z, weights divided by their sum."""
    taps = f"t AS (SELECT o.range AS o, floor((o.range + 0.5) * 2 / 3.0::DOUBLE - 0.5) + k.range - {reach - 1} AS i, (o.range + 0.5) * 2 / 3.0::DOUBLE - 0.5 AS f FROM range(12) o, range({2 * reach}) k), z AS (SELECT o, i, abs(f - i) AS z FROM t), w AS (SELECT o, greatest(0, least(7, i)) AS i, {weight} AS w FROM z), n AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM w)"
    return f"WITH {IMG}, {taps} SELECT img_id, CAST(a.o AS INT) AS y, CAST(b.o AS INT) AS x, {u8('round(sum(v * a.w * b.w), 9)')} AS v FROM img JOIN n a ON a.i = y JOIN n b ON b.i = x GROUP BY 1, 2, 3"


_q("resize_cubic", lambda a: R.resample(a, 12, 12, R.cubic_weight, 2), _resampled("CASE WHEN z <= 1 THEN 1.5 * z * z * z - 2.5 * z * z + 1 WHEN z < 2 THEN -0.5 * (z * z * z - 5 * z * z + 8 * z - 4) ELSE 0 END", 2))
_q("resize_lanczos", lambda a: R.resample(a, 12, 12, R.lanczos_weight, 3), _resampled("CASE WHEN z = 0 THEN 1 WHEN z < 3 THEN sin(pi() * z) / (pi() * z) * sin(pi() * z / 3) / (pi() * z / 3) ELSE 0 END", 3))
_GROWN = "t AS (SELECT o.range AS o, 15 - abs(15 - abs(o.range + k.range - 2)) AS i, [1, 4, 6, 4, 1][k.range + 1] AS w FROM range(16) o, range(5) k), n AS (SELECT o, i // 2 AS i, w FROM t WHERE i % 2 = 0)"
_q("pyr_up", R.pyr_up, f"WITH {IMG}, {_GROWN} SELECT img_id, CAST(a.o AS INT) AS y, CAST(b.o AS INT) AS x, {u8('sum(v * a.w * b.w) / 64.0::DOUBLE')} AS v FROM img JOIN n a ON a.i = y JOIN n b ON b.i = x GROUP BY 1, 2, 3")
_SHRUNK = "s(d, w) AS (VALUES (-2,1),(-1,4),(0,6),(1,4),(2,1)), e AS (SELECT p.img_id, p.y // 2 AS y, p.x // 2 AS x, " + u8("sum(q.v * a.w * b.w) / 256.0::DOUBLE") + " AS v FROM img p CROSS JOIN s a CROSS JOIN s b JOIN img q ON q.img_id = p.img_id AND q.y = greatest(0, least(7, p.y + a.d)) AND q.x = greatest(0, least(7, p.x + b.d)) WHERE p.y % 2 = 0 AND p.x % 2 = 0 GROUP BY 1, 2, 3)"
_GROWN4 = _GROWN.replace("15 - abs(15 - abs", "7 - abs(7 - abs").replace("range(16)", "range(8)")
_q("laplacian_pyramid", R.laplacian_level, f"WITH {IMG}, {_SHRUNK}, {_GROWN4}, u AS (SELECT img_id, a.o AS y, b.o AS x, {u8('sum(v * a.w * b.w) / 64.0::DOUBLE')} AS v FROM e JOIN n a ON a.i = y JOIN n b ON b.i = x GROUP BY 1, 2, 3) SELECT img_id, y, x, img.v - u.v AS v FROM img JOIN u USING (img_id, y, x)")
_q("bernsen", lambda a: R.bernsen(a, 3, 15), f"WITH {IMG}, k(dy, dx) AS (SELECT a.range - 1, b.range - 1 FROM range(3) a, range(3) b), m AS (SELECT p.img_id, p.y, p.x, p.v, max(q.v) AS hi, min(q.v) AS lo FROM img p CROSS JOIN k JOIN img q ON q.img_id = p.img_id AND q.y = greatest(0, least(7, p.y + dy)) AND q.x = greatest(0, least(7, p.x + dx)) GROUP BY ALL) SELECT img_id, y, x, CASE WHEN hi - lo < 15 THEN CASE WHEN (hi + lo) / 2.0 >= 128 THEN 255 ELSE 0 END WHEN v >= (hi + lo) / 2.0 THEN 255 ELSE 0 END AS v FROM m")
_q("census", R.census, f"WITH {IMG}, k(dy, dx, w) AS (VALUES (-1,-1,128),(-1,0,64),(-1,1,32),(0,-1,16),(0,1,8),(1,-1,4),(1,0,2),(1,1,1)) SELECT p.img_id, p.y, p.x, CAST(sum(CASE WHEN q.v < p.v THEN w ELSE 0 END) AS BIGINT) AS v FROM img p CROSS JOIN k JOIN img q ON q.img_id = p.img_id AND {_CLAMP} GROUP BY 1, 2, 3", "bigint")
_POLAR = "t AS (SELECT CAST(a.range AS INT) AS ang, CAST(r.range AS INT) AS r, 3.5 + r.range * sin(pi() * a.range / 8) AS fy, 3.5 + r.range * cos(pi() * a.range / 8) AS fx FROM range(16) a, range(4) r), s AS (SELECT ang, r, floor(fy) + i.range AS y, floor(fx) + j.range AS x, (1 - abs(fy - floor(fy) - i.range)) * (1 - abs(fx - floor(fx) - j.range)) AS w FROM t, range(2) i, range(2) j)"
_q("warp_polar", lambda a: R.warp_polar(a, 16, 4, 3.5, 3.5, 4.0), f"WITH {IMG}, {_POLAR} SELECT i.img_id, s.ang AS y, s.r AS x, {u8('round(sum(coalesce(img.v, 0) * w), 9)')} AS v FROM (SELECT DISTINCT img_id FROM img) i CROSS JOIN s LEFT JOIN img ON img.img_id = i.img_id AND img.y = s.y AND img.x = s.x GROUP BY 1, 2, 3")


def _stacked(s, d):
    return image_pairs(s, d).select("img_id", F.concat("a", "b").alias("img"))


def _pair(name: str, kernel, kind: str = "int", digits: int | None = None, sql: str | None = None) -> None:
    """A kernel of two images, stacked one above the other on the way in."""

    def query(s, d):
        out = R.to_pixels(R.map_images(_stacked(s, d), lambda a: kernel(a[:, :N], a[:, N:]), shape=(2 * N, N), kind=kind))
        return out if digits is None else out.withColumn("v", F.round(F.col("v") + 0.0, digits) + 0.0)

    register(name, query, sql)


_SLOPE = "g AS (SELECT img_id, y, x, (va[y * 8 + least(7, x + 1) + 1] + vb[y * 8 + least(7, x + 1) + 1] - va[y * 8 + greatest(0, x - 1) + 1] - vb[y * 8 + greatest(0, x - 1) + 1]) / 4.0::DOUBLE AS gx, (va[least(7, y + 1) * 8 + x + 1] + vb[least(7, y + 1) * 8 + x + 1] - va[greatest(0, y - 1) * 8 + x + 1] - vb[greatest(0, y - 1) * 8 + x + 1]) / 4.0::DOUBLE AS gy, CAST(b.v - a.v AS DOUBLE) AS gt FROM places JOIN two USING (img_id)), k(dy, dx, w) AS (VALUES (-1,-1,1/12.0::DOUBLE),(-1,0,1/6.0::DOUBLE),(-1,1,1/12.0::DOUBLE),(0,-1,1/6.0::DOUBLE),(0,1,1/6.0::DOUBLE),(1,-1,1/12.0::DOUBLE),(1,0,1/6.0::DOUBLE),(1,1,1/12.0::DOUBLE)), d0 AS (SELECT *, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v FROM g)"
_ROUNDS = "".join(f", m{i} AS (SELECT p.img_id, p.y, p.x, p.gx, p.gy, p.gt, sum(k.w * q.u) AS u, sum(k.w * q.v) AS v FROM g p CROSS JOIN k JOIN d{i} q ON q.img_id = p.img_id AND {_CLAMP} GROUP BY 1, 2, 3, 4, 5, 6), d{i + 1} AS (SELECT img_id, y, x, u - gx * (gx * u + gy * v + gt) / (100 + gx * gx + gy * gy) AS u, v - gy * (gx * u + gy * v + gt) / (100 + gx * gx + gy * gy) AS v FROM m{i})" for i in range(20))
_pair("optical_flow_u", lambda a, b: K.horn_schunck(a, b, 10.0, 20)[0], "double", 4, f"WITH {_PAIRS}, {_SLOPE}{_ROUNDS} SELECT img_id, y, x, round(u + 0.0, 4) + 0.0 AS v FROM d20")
_QY, _QX = "greatest(0, least(7, y + dy))", "greatest(0, least(7, x + dx))"
_pair("stereo_disparity", lambda a, b: K.block_disparity(a, b, 4, 3), "bigint", None, f"WITH {_PAIRS}, {_RING(1)}, c AS (SELECT img_id, y, x, d.range AS d, sum(abs(va[{_QY} * 8 + {_QX} + 1] - vb[{_QY} * 8 + greatest(0, {_QX} - d.range) + 1])) AS cost FROM places JOIN two USING (img_id) CROSS JOIN k CROSS JOIN range(4) d GROUP BY 1, 2, 3, 4) SELECT img_id, y, x, arg_min(d, (cost, d)) AS v FROM c GROUP BY 1, 2, 3")

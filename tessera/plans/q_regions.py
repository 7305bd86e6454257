"""Contours, component filters, clipped local thresholds, histogram maps and run-length features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import pixel as P
from tessera.functions import vector as V
from tessera.operators import contours as C
from tessera.operators import histogram as H
from tessera.operators import kernels as K
from tessera.operators import measure as M
from tessera.operators import raster as R
from tessera.operators import records as RC
from tessera.plans.common import _PAIRS, IMG, SIDE, image_pairs, images, pixels, table
from tessera.plans.q_color_hist import _CUM, _MOM, _PHIST, _PSQL, _QH, _flag
from tessera.plans.q_kernels import _components, _q
from tessera.plans.q_measure import _LEV
from tessera.plans.q_search import _AH, _AHS
from tessera.plans.registry import register

N = SIDE

# regions of both kinds on the padded grid, numbered by their first place; where two of different kind touch is a border
_REGIONS = f"""{IMG}, g AS (
  SELECT i.img_id, CAST(a.range - 1 AS INT) AS y, CAST(b.range - 1 AS INT) AS x, coalesce(img.v > 140, false) AS o, CAST(a.range * 10 + b.range AS INT) AS cell
  FROM (SELECT DISTINCT img_id FROM img) i CROSS JOIN range(10) a CROSS JOIN range(10) b LEFT JOIN img ON img.img_id = i.img_id AND img.y = a.range - 1 AND img.x = b.range - 1
), seeds AS (
  SELECT g.*, lag(o) OVER (PARTITION BY img_id, y ORDER BY x) AS lft, lag(o) OVER (PARTITION BY img_id, x ORDER BY y) AS up FROM g
), r AS (
  SELECT img_id, y, x, o, cell AS root FROM seeds WHERE lft IS DISTINCT FROM o AND up IS DISTINCT FROM o
  UNION
  SELECT g.img_id, g.y, g.x, g.o, r.root FROM r JOIN g ON g.img_id = r.img_id AND g.o = r.o AND abs(g.y - r.y) <= 1 AND abs(g.x - r.x) <= 1 AND (g.o OR abs(g.y - r.y) + abs(g.x - r.x) = 1)
), m AS (
  SELECT img_id, y, x, o, min(root) AS root FROM r GROUP BY 1, 2, 3, 4
), t AS (
  SELECT p.img_id, p.root AS fr, q.root AS br, count(DISTINCT p.y * 10 + p.x) AS points FROM m p JOIN m q ON q.img_id = p.img_id AND p.o AND NOT q.o AND abs(p.y - q.y) + abs(p.x - q.x) = 1 GROUP BY 1, 2, 3
), k AS (
  SELECT t.*, m.root <> t.br AS hole FROM t JOIN m ON m.img_id = t.img_id AND (m.y + 1) * 10 + m.x + 1 = t.fr - 1
), c AS (
  SELECT *, (CASE WHEN hole THEN br - 1 ELSE fr END) // 10 - 1 AS y, (CASE WHEN hole THEN br - 1 ELSE fr END) % 10 - 1 AS x FROM k
), d AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY y, x, hole) - 1 AS contour FROM c)"""
register(
    "contours",
    lambda s, d: C.find_contours(images(s, d).withColumn("img", P.each(F.col("img"), lambda v: (v > 140).cast("int"))), shape=(N, N)).select("img_id", "contour", "parent", "hole", "y", "x", F.size(F.array_distinct(F.arrays_zip("ys", "xs"))).alias("points")),
    f"WITH RECURSIVE {_REGIONS} SELECT d.img_id, CAST(d.contour AS INT) AS contour, CAST(coalesce(p.contour, -1) AS INT) AS parent, d.hole, CAST(d.y AS INT) AS y, CAST(d.x AS INT) AS x, CAST(d.points AS INT) AS points FROM d LEFT JOIN d p ON p.img_id = d.img_id AND p.hole <> d.hole AND CASE WHEN d.hole THEN p.fr = d.fr ELSE p.br = d.br END",
)

# components by size
_L8 = _components("abs(b.y - r.y) <= 1 AND abs(b.x - r.x) <= 1")
_AREA = f"WITH c AS ({_L8}), s AS (SELECT img_id, v, count(*) AS n FROM c WHERE v > 0 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY n DESC, v) AS place FROM s) SELECT c.img_id, c.y, c.x, CASE WHEN {{}} THEN 255 ELSE 0 END AS v FROM c LEFT JOIN k ON k.img_id = c.img_id AND k.v = c.v"
_q("keep_largest", lambda a: K.keep_largest(np.where(a > 140, 255, 0), 2), _AREA.format("place <= 2"))
_q("filter_area", lambda a: K.filter_area(np.where(a > 140, 255, 0), 2, 12), _AREA.format("n BETWEEN 2 AND 12"))

# local thresholds over windows clipped at the border
_W = f"{IMG}, w AS (SELECT p.img_id, p.y, p.x, p.v, CAST(count(*) AS DOUBLE) AS n, CAST(sum(q.v) AS DOUBLE) AS s, CAST(sum(q.v * q.v) AS DOUBLE) AS q FROM img p JOIN img q ON q.img_id = p.img_id AND abs(q.y - p.y) <= 2 AND abs(q.x - p.x) <= 2 GROUP BY 1, 2, 3, 4), z AS (SELECT *, s / n AS mean, sqrt(greatest(0, q / n - (s / n) * (s / n))) AS std FROM w)"
_over = lambda t, src="z": f"WITH {_W} SELECT img_id, y, x, CASE WHEN v > {t} THEN 255 ELSE 0 END AS v FROM {src}"
_q("wolf", lambda a: R.wolf(a, 5, 0.5), _over("mean - 0.5::DOUBLE * (1 - std / most) * (mean - low)", "(SELECT *, CASE WHEN max(std) OVER p = 0 THEN 1 ELSE max(std) OVER p END AS most, min(v) OVER p AS low FROM z WINDOW p AS (PARTITION BY img_id)) u"))
_q("nick", lambda a: R.nick(a, 5, -0.2), _over("mean + (-0.2)::DOUBLE * sqrt(greatest(0, (q - mean * mean) / n))"))
_q("phansalkar", lambda a: R.phansalkar(a, 5), _over("255 * (mean / 255) * (1 + 2 * exp(-10 * (mean / 255)) + 0.25::DOUBLE * (sqrt(greatest(0, q / n / 65025 - (mean / 255) * (mean / 255))) / 0.5::DOUBLE - 1))"))

# histograms
register("hist_summary", lambda s, d: H.summary(_PHIST(s, d), ["k"]).select("k", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), "peak"), f"WITH {_PSQL} SELECT k, round(sum(bin * n) / CAST(sum(n) AS DOUBLE), 6) AS mean, round(sum(bin * bin * n) / CAST(sum(n) AS DOUBLE) - pow(sum(bin * n) / CAST(sum(n) AS DOUBLE), 2), 4) AS variance, arg_max(bin, (n, -bin)) AS peak FROM h GROUP BY k")
register("back_project", lambda s, d: H.back_project_map(_PHIST(s, d), ["k"]), f"WITH {_PSQL} SELECT k, bin, CAST(floor(n / CAST(max(n) OVER (PARTITION BY k) AS DOUBLE) * 255 + 0.5) AS INT) AS v FROM h")
_FO = "c AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY bin) AS cdf, sum(n) OVER (PARTITION BY l_returnflag, l_linestatus) AS total FROM h)"
register("match_histogram", lambda s, d: H.match_map(_flag(s, d, "F"), _flag(s, d, "O"), ["l_returnflag"], 50), f"WITH {_QH}, {_FO} SELECT a.l_returnflag, a.bin, CAST(CASE WHEN count(b.bin) = 0 THEN a.bin ELSE least(49, count(*) FILTER (b.cdf * a.total < a.cdf * b.total)) END AS INT) AS v FROM (SELECT * FROM c WHERE l_linestatus = 'F') a LEFT JOIN (SELECT * FROM c WHERE l_linestatus = 'O') b ON b.l_returnflag = a.l_returnflag GROUP BY 1, 2")
register("multi_otsu", lambda s, d: H.multi_otsu(_PHIST(s, d), ["k"]), f"WITH {_PSQL}{_MOM}, j AS (SELECT a.k, a.bin AS t1, b.bin AS t2, round((a.s0 * a.s0 / a.w0 + (b.s0 - a.s0) * (b.s0 - a.s0) / (b.w0 - a.w0) + (b.s - b.s0) * (b.s - b.s0) / (b.w - b.w0)) / b.w, 6) AS score FROM m a JOIN m b ON a.k = b.k AND a.bin < b.bin WHERE a.w0 > 0 AND a.w0 < b.w0 AND b.w0 < b.w) SELECT k, arg_max(t1, (score, -t1, -t2)) AS t1, arg_max(t2, (score, -t1, -t2)) AS t2 FROM j GROUP BY k")
register(
    "hist_divergence",
    lambda s, d: H.divergence(_flag(s, d, "F"), _flag(s, d, "O"), ["l_returnflag"]).select("l_returnflag", *(F.round(c, 6).alias(c) for c in ("chi_square_alt", "jensen_shannon"))),
    f"WITH {_QH}, j AS (SELECT coalesce(a.l_returnflag, b.l_returnflag) AS l_returnflag, coalesce(a.n, 0) AS p, coalesce(b.n, 0) AS q FROM (SELECT * FROM h WHERE l_linestatus = 'F') a FULL JOIN (SELECT * FROM h WHERE l_linestatus = 'O') b ON a.l_returnflag = b.l_returnflag AND a.bin = b.bin), z AS (SELECT *, p / nullif(sum(p) OVER w, 0) AS x, q / nullif(sum(q) OVER w, 0) AS y FROM j WINDOW w AS (PARTITION BY l_returnflag)) SELECT l_returnflag, round(sum(CASE WHEN p + q > 0 THEN 2 * (p - q) * (p - q) / (p + q) ELSE 0 END), 6) AS chi_square_alt, round(sum(CASE WHEN x > 0 THEN x * ln(x / ((x + y) / 2)) ELSE 0 END + CASE WHEN y > 0 THEN y * ln(y / ((x + y) / 2)) ELSE 0 END) / 2, 6) AS jensen_shannon FROM z GROUP BY 1",
)

# texture
_RF = ["short_run", "long_run", "level_nonuniformity", "length_nonuniformity", "low_level", "high_level", "run_percentage"]
register(
    "run_length_features",
    lambda s, d: M.run_features(M.run_lengths(pixels(_LEV(s, d), F.col("img")), ["img_id"]), ["img_id"]).select("img_id", *(F.round(c, 6).alias(c) for c in _RF)),
    f"WITH {IMG}, l AS (SELECT img_id, y, x, CAST(v // 32 AS INT) AS v FROM img), r AS (SELECT *, x - row_number() OVER (PARTITION BY img_id, y, v ORDER BY x) AS g FROM l), o AS (SELECT img_id, v + 1.0::DOUBLE AS i, CAST(count(*) AS DOUBLE) AS j FROM r GROUP BY img_id, y, v, g), a AS (SELECT img_id, sum(n * n) AS sq FROM (SELECT img_id, i, CAST(count(*) AS DOUBLE) AS n FROM o GROUP BY 1, 2) u GROUP BY 1), b AS (SELECT img_id, sum(n * n) AS sq FROM (SELECT img_id, j, CAST(count(*) AS DOUBLE) AS n FROM o GROUP BY 1, 2) u GROUP BY 1) "
    "SELECT o.img_id, round(avg(1 / (j * j)), 6) AS short_run, round(avg(j * j), 6) AS long_run, round(max(a.sq) / count(*), 6) AS level_nonuniformity, round(max(b.sq) / count(*), 6) AS length_nonuniformity, round(avg(1 / (i * i)), 6) AS low_level, round(avg(i * i), 6) AS high_level, round(count(*) / 64.0::DOUBLE, 6) AS run_percentage FROM o JOIN a USING (img_id) JOIN b USING (img_id) GROUP BY 1",
)

# two images
_STACK = lambda s, d: image_pairs(s, d).select("img_id", F.concat("a", "b").alias("img"))


def _two(kernel, s, d):
    return R.map_images(_STACK(s, d), lambda a: kernel(a[:, :N], a[:, N:]), shape=(2 * N, N), kind="double")


_PREWITT = "k(dy, dx, gx, gy) AS (VALUES (-1,-1,-1,-1),(-1,0,0,-1),(-1,1,1,-1),(0,-1,-1,0),(0,1,1,0),(1,-1,-1,1),(1,0,0,1),(1,1,1,1))"
_AT = "greatest(0, least(7, y + dy)) * 8 + greatest(0, least(7, x + dx)) + 1"
register(
    "gradient_similarity",
    lambda s, d: R.to_pixels(_two(K.gradient_similarity, s, d)).groupBy("img_id").agg(F.round(F.stddev_pop("v"), 6).alias("deviation"), F.round(F.avg("v"), 6).alias("mean")),
    f"WITH {_PAIRS}, {_PREWITT}, t AS (SELECT img_id, y, x, sum(va[{_AT}] * gx) / 3.0::DOUBLE AS ax, sum(va[{_AT}] * gy) / 3.0::DOUBLE AS ay, sum(vb[{_AT}] * gx) / 3.0::DOUBLE AS bx, sum(vb[{_AT}] * gy) / 3.0::DOUBLE AS b_y FROM places JOIN two USING (img_id) CROSS JOIN k GROUP BY 1, 2, 3), g AS (SELECT img_id, sqrt(ax * ax + ay * ay) AS p, sqrt(bx * bx + b_y * b_y) AS q FROM t), z AS (SELECT img_id, (2 * p * q + 170) / (p * p + q * q + 170) AS v FROM g) SELECT img_id, round(stddev_pop(v), 6) AS deviation, round(avg(v), 6) AS mean FROM z GROUP BY 1",
)
register(
    "universal_quality",
    lambda s, d: _two(K.universal_quality, s, d).select("img_id", F.round(F.col("img")[0], 6).alias("uqi")),
    f"WITH {_PAIRS}, z AS (SELECT img_id, avg(a.v) AS p, avg(b.v) AS q, var_samp(a.v) AS vp, var_samp(b.v) AS vq, covar_samp(a.v, b.v) AS c FROM places GROUP BY 1) SELECT img_id, round(CASE WHEN (vp + vq) * (p * p + q * q) > 0 THEN 4 * c * p * q / ((vp + vq) * (p * p + q * q)) ELSE 1 END, 6) AS uqi FROM z",
)


def _polar(s, d):
    p = image_pairs(s, d).select("img_id", F.posexplode(F.arrays_zip("a", "b")).alias("i", "p"))
    x, y = P.polar_to_cart(F.col("p.a").cast("double"), F.col("p.b").cast("double"))
    return p.select("img_id", "i", F.round(x + 0.0, 6).alias("px"), F.round(y + 0.0, 6).alias("py"))


register("polar_to_cart", _polar, f"WITH {_PAIRS} SELECT img_id, y * 8 + x AS i, round(a.v * cos(radians(b.v)) + 0.0, 6) AS px, round(a.v * sin(radians(b.v)) + 0.0, 6) AS py FROM places")
register("accumulate_products", lambda s, d: image_pairs(s, d).select(F.posexplode(F.arrays_zip("a", "b")).alias("i", "p")).groupBy("i").agg(F.sum(F.col("p.a")).alias("total"), F.sum(F.col("p.a") * F.col("p.a")).alias("squares"), F.sum(F.col("p.a") * F.col("p.b")).alias("products")), f"WITH {_PAIRS} SELECT y * 8 + x AS i, CAST(sum(a.v) AS BIGINT) AS total, CAST(sum(a.v * a.v) AS BIGINT) AS squares, CAST(sum(a.v * b.v) AS BIGINT) AS products FROM places GROUP BY 1")


# channels: 64 values as 16 pixels of 4
def _flat(df, value, name: str = "v"):
    return df.select("img_id", F.posexplode(value).alias("i", name))


def _mixed(s, d):
    return _flat(image_pairs(s, d), P.mix_channels([(F.col("a"), 4), (F.col("b"), 4)], [(1, 3), (0, 0), (0, 2)]))


register("extract_channel", lambda s, d: _flat(images(s, d), P.extract_channel(F.col("img"), 4, 2)), f"WITH {IMG} SELECT img_id, CAST((y * 8 + x) // 4 AS INT) AS i, v FROM img WHERE x % 4 = 2")
register("insert_channel", lambda s, d: _flat(image_pairs(s, d).withColumn("plane", P.extract_channel(F.col("b"), 4, 1)), P.insert_channel(F.col("a"), 4, 2, F.col("plane"))), f"WITH {_PAIRS} SELECT img_id, y * 8 + x AS i, CASE WHEN x % 4 = 2 THEN vb[y * 8 + x] ELSE a.v END AS v FROM places JOIN two USING (img_id)")
register("mix_channels", _mixed, f"WITH {_PAIRS} SELECT img_id, CAST(p.range * 3 + c.range AS INT) AS i, CASE c.range WHEN 0 THEN vb[p.range * 4 + 4] WHEN 1 THEN va[p.range * 4 + 1] ELSE va[p.range * 4 + 3] END AS v FROM two, range(16) p, range(3) c")
register("lut_channels", lambda s, d: _flat(images(s, d), P.lut_channels(F.col("img"), [F.array(*(F.lit((j * (2 * k + 1) + k) % 256) for j in range(256))) for k in range(4)])), f"WITH {IMG} SELECT img_id, y * 8 + x AS i, (v * (2 * (x % 4) + 1) + x % 4) % 256 AS v FROM img")

# sums and copies
_GRID9 = "FROM (SELECT DISTINCT img_id FROM img) i CROSS JOIN (SELECT CAST(range AS INT) AS gy FROM range(9)) a CROSS JOIN (SELECT CAST(range AS INT) AS gx FROM range(9)) b LEFT JOIN img ON img.img_id = i.img_id AND img.y < gy"
_q("integral_squared", lambda a: R.integral(a.astype(np.int64) ** 2), f"WITH {IMG} SELECT i.img_id, gy AS y, gx AS x, CAST(coalesce(sum(v * v), 0) AS BIGINT) AS v {_GRID9} AND img.x < gx GROUP BY 1, 2, 3", "bigint")
_q("integral_tilted", R.integral_tilted, f"WITH {IMG} SELECT i.img_id, gy AS y, gx AS x, CAST(coalesce(sum(v), 0) AS BIGINT) AS v {_GRID9} AND abs(img.x - gx + 1) < gy - img.y GROUP BY 1, 2, 3", "bigint")
_q("repeat", lambda a: R.repeat(a, 2, 3), f"WITH {IMG} SELECT img_id, CAST(y + 8 * a.range AS INT) AS y, CAST(x + 8 * b.range AS INT) AS x, v FROM img, range(2) a, range(3) b")
_q("region", lambda a: R.region(a, 2, 5, 4, 9), f"WITH {IMG} SELECT img_id, y - 2 AS y, x - 5 AS x, v FROM img WHERE y BETWEEN 2 AND 5 AND x >= 5")

# records: bright pixels as scored points, and segments between the ends of orders
_POINTS = lambda s, d: pixels(images(s, d), F.col("img"))
register("filter_by_response", lambda s, d: RC.within(_POINTS(s, d), F.col("v"), 120, 180), f"WITH {IMG} SELECT img_id, y, x, v FROM img WHERE v BETWEEN 120 AND 180")
register("filter_by_border", lambda s, d: RC.off_border(_POINTS(s, d), N, N, 2), f"WITH {IMG} SELECT img_id, y, x, v FROM img WHERE y >= 2 AND y <= 5 AND x >= 2 AND x <= 5")
register("retain_best", lambda s, d: RC.retain_best(_POINTS(s, d), ["img_id"], "v", 5, ["y", "x"]), f"WITH {IMG} SELECT img_id, y, x, v FROM img QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY v DESC, y, x) <= 5")
_SEG = "SELECT p_partkey, p_partkey % 11 AS x1, p_size % 7 AS y1, p_partkey % 5 + 6 AS x2, p_size % 9 + 2 AS y2 FROM part"
register(
    "filter_by_length",
    lambda s, d: RC.within(table(s, d, "part").selectExpr("p_partkey", "p_partkey % 11 AS x1", "p_size % 7 AS y1", "p_partkey % 5 + 6 AS x2", "p_size % 9 + 2 AS y2"), RC.length("x1", "y1", "x2", "y2"), 5.0).select("p_partkey", F.round(RC.length("x1", "y1", "x2", "y2"), 6).alias("length")),
    f"SELECT p_partkey, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) AS length FROM ({_SEG}) s WHERE (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) >= 25",
)
_HEX = "array_to_string(list_transform(range(16), lambda k: substr('0123456789abcdef', CAST(1 + 8 * CAST(substr(bits, CAST(4 * k + 1 AS BIGINT), 1) AS INT) + 4 * CAST(substr(bits, CAST(4 * k + 2 AS BIGINT), 1) AS INT) + 2 * CAST(substr(bits, CAST(4 * k + 3 AS BIGINT), 1) AS INT) + CAST(substr(bits, CAST(4 * k + 4 AS BIGINT), 1) AS INT) AS BIGINT), 1)), '')"
register("hash_hex", lambda s, d: _AH(s, d).select("id", V.code_to_hex(F.col("code")).alias("digits"), (V.hex_to_code(V.code_to_hex(F.col("code"))) == F.col("code")).alias("same"), V.hamming_share(F.col("code"), F.lit(0).cast("bigint")).alias("share")), f"WITH {_AHS} SELECT id, {_HEX} AS digits, true AS same, length(replace(bits, '0', '')) / 64.0::DOUBLE AS share FROM h")

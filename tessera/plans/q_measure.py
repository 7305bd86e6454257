"""Geometry, check digits, moments, texture, metrics, quality and clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import codes as C
from tessera.functions import geometry as G
from tessera.functions import pixel as P
from tessera.functions import symbology as SY
from tessera.operators import measure as M
from tessera.plans.common import IMG, image_pairs, images, pixels, table
from tessera.plans.registry import register

# polygons: a quadrilateral for each part, from its key and size
_PTS = [("p_partkey % 7", "p_size % 5"), ("p_partkey % 7 + 10 + p_size", "p_size % 3"), ("p_partkey % 5 + 12", "p_size + 9"), ("p_partkey % 3", "p_partkey % 11 + 6")]


def _poly(s, d):
    return table(s, d, "part").select("p_partkey", "p_size", G.points(*((F.expr(x).cast("double"), F.expr(y).cast("double")) for x, y in _PTS)).alias("poly"))


_V = "v AS (" + " UNION ALL ".join(f"SELECT p_partkey, {i} AS i, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM part" for i, (x, y) in enumerate(_PTS)) + "), e AS (SELECT a.p_partkey, a.i, a.x, a.y, b.x AS x2, b.y AS y2, c.x AS x3, c.y AS y3 FROM v a JOIN v b ON a.p_partkey = b.p_partkey AND b.i = (a.i + 1) % 4 JOIN v c ON a.p_partkey = c.p_partkey AND c.i = (a.i + 2) % 4)"
_p = lambda: F.col("poly")
register("polygon_area", lambda s, d: _poly(s, d).select("p_partkey", F.round(G.area(_p()), 6).alias("area"), F.round(G.perimeter(_p()), 6).alias("perimeter"), F.round(G.signed_area(_p()), 6).alias("signed")), f"WITH {_V} SELECT p_partkey, round(abs(sum(x * y2 - x2 * y)) / 2, 6) AS area, round(sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))), 6) AS perimeter, round(sum(x * y2 - x2 * y) / 2, 6) AS signed FROM e GROUP BY 1")
register("polygon_centroid", lambda s, d: _poly(s, d).select("p_partkey", *(F.round(c, 6).alias(n) for c, n in zip(G.centroid(_p()), ("cx", "cy"), strict=True))), f"WITH {_V} SELECT p_partkey, round(sum((x + x2) * (x * y2 - x2 * y)) / nullif(3 * sum(x * y2 - x2 * y), 0), 6) AS cx, round(sum((y + y2) * (x * y2 - x2 * y)) / nullif(3 * sum(x * y2 - x2 * y), 0), 6) AS cy FROM e GROUP BY 1")
register("convexity", lambda s, d: _poly(s, d).select("p_partkey", G.is_convex(_p()).alias("convex")), f"WITH {_V}, t AS (SELECT p_partkey, (x2 - x) * (y3 - y2) - (y2 - y) * (x3 - x2) AS z FROM e) SELECT p_partkey, NOT (bool_or(z > 0) AND bool_or(z < 0)) AS convex FROM t GROUP BY 1")
register("point_in_polygon", lambda s, d: _poly(s, d).select("p_partkey", G.contains(_p(), F.expr("p_partkey % 13"), F.expr("p_size % 12")).alias("side")), f"WITH {_V}, q AS (SELECT e.*, CAST(e.p_partkey % 13 AS DOUBLE) AS px, CAST(p_size % 12 AS DOUBLE) AS py FROM e JOIN part USING (p_partkey)) SELECT p_partkey, CASE WHEN bool_or((x2 - x) * (py - y) = (y2 - y) * (px - x) AND px BETWEEN least(x, x2) AND greatest(x, x2) AND py BETWEEN least(y, y2) AND greatest(y, y2)) THEN 0 WHEN sum(CASE WHEN (y > py) <> (y2 > py) AND px < (x2 - x) * (py - y) / nullif(y2 - y, 0) + x THEN 1 ELSE 0 END) % 2 = 1 THEN 1 ELSE -1 END AS side FROM q GROUP BY 1")
_SEG = ["p_partkey % 11", "p_size % 7", "p_partkey % 5 + 6", "p_size % 9 + 2", "p_partkey % 8", "p_size % 10", "p_partkey % 4 + 3", "p_size % 6 + 1"]
_SG = "sign((CAST({2} AS DOUBLE) - {0}) * ({5} - {1}) - ({3} - {1}) * ({4} - {0}))"
_IN = "({4} BETWEEN least({0}, {2}) AND greatest({0}, {2}) AND {5} BETWEEN least({1}, {3}) AND greatest({1}, {3}))"
_n = ["ax", "ay", "bx", "b_y", "cx", "cy", "dx", "dy"]
_o = [(0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 6, 7), (4, 5, 6, 7, 0, 1), (4, 5, 6, 7, 2, 3)]
register("segments_cross", lambda s, d: table(s, d, "part").select("p_partkey", G.segments_cross(*(F.expr(e) for e in _SEG)).alias("meet")), "WITH s AS (SELECT p_partkey, " + ", ".join(f"{e} AS {n}" for e, n in zip(_SEG, _n, strict=True)) + " FROM part), o AS (SELECT *, " + ", ".join(f"{_SG.format(*(_n[i] for i in ix))} AS o{k}, {_IN.format(*(_n[i] for i in ix))} AS i{k}" for k, ix in enumerate(_o)) + " FROM s) SELECT p_partkey, (o0 <> o1 AND o2 <> o3) OR (o0 = 0 AND i0) OR (o1 = 0 AND i1) OR (o2 = 0 AND i2) OR (o3 = 0 AND i3) AS meet FROM o")

# check digits on zero-padded keys
_K = lambda n: F.lpad(F.col("o_orderkey").cast("string"), n, "0")


def _dig(n: int) -> str:
    return f"d AS (SELECT o_orderkey, CAST(i AS INT) AS i, CAST(substr(lpad(CAST(o_orderkey AS VARCHAR), {n}, '0'), CAST({n} - i AS BIGINT), 1) AS INT) AS v FROM orders, (SELECT range AS i FROM range({n})) r)"


for _name, _len in (("ean13", 12), ("upca", 11), ("itf14", 13), ("ean8", 7)):
    register(f"check_{_name}", (lambda n: lambda s, d: table(s, d, "orders").select("o_orderkey", C.gs1_check_digit(_K(n)).alias("digit")))(_len), f"WITH {_dig(_len)} SELECT o_orderkey, CAST((10 - sum(v * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END) % 10) % 10 AS INT) AS digit FROM d GROUP BY 1")
register("check_luhn", lambda s, d: table(s, d, "orders").select("o_orderkey", C.luhn_check_digit(_K(10)).alias("digit")), f"WITH {_dig(10)} SELECT o_orderkey, CAST((10 - sum(CASE WHEN i % 2 = 1 THEN v WHEN v > 4 THEN v * 2 - 9 ELSE v * 2 END) % 10) % 10 AS INT) AS digit FROM d GROUP BY 1")
register("check_isbn10", lambda s, d: table(s, d, "orders").select("o_orderkey", C.isbn10_check(_K(9)).alias("check_char")), f"WITH {_dig(9)}, t AS (SELECT o_orderkey, (11 - sum(v * (i + 2)) % 11) % 11 AS c FROM d GROUP BY 1) SELECT o_orderkey, CASE WHEN c = 10 THEN 'X' ELSE CAST(CAST(c AS INT) AS VARCHAR) END AS check_char FROM t")
register("check_mod97", lambda s, d: table(s, d, "orders").select("o_orderkey", C.mod97(_K(12)).alias("rest")), "SELECT o_orderkey, CAST(o_orderkey % 97 AS INT) AS rest FROM orders")

# moments
_PX = lambda s, d: pixels(images(s, d), F.col("img"))
_RAW = [(p, q) for p in range(4) for q in range(4 - p)]
_RSQL = "m AS (SELECT img_id, " + ", ".join(f"sum(CAST(v AS DOUBLE){' * x' * p}{' * y' * q}) AS m{p}{q}" for p, q in _RAW) + " FROM img GROUP BY img_id)"
register("moments_raw", lambda s, d: M.raw_moments(_PX(s, d), ["img_id"]), f"WITH {IMG}, {_RSQL} SELECT * FROM m")
_MU = {"mu20": (2, 0), "mu11": (1, 1), "mu02": (0, 2), "mu30": (3, 0), "mu21": (2, 1), "mu12": (1, 2), "mu03": (0, 3)}
_CSQL = f"{_RSQL}, c AS (SELECT img.*, m00, m10 / m00 AS cx, m01 / m00 AS cy FROM img JOIN m USING (img_id)), u AS (SELECT img_id, max(m00) AS m00, " + ", ".join(f"sum(v{' * (x - cx)' * p}{' * (y - cy)' * q}) AS {n}" for n, (p, q) in _MU.items()) + " FROM c GROUP BY img_id)"
register("moments_central", lambda s, d: M.central_moments(M.raw_moments(_PX(s, d), ["img_id"])).select("img_id", *(F.round(c, 4).alias(c) for c in _MU)), f"WITH {IMG}, {_CSQL} SELECT img_id, {', '.join(f'round({c}, 4) AS {c}' for c in _MU)} FROM u")
_NU = ", n AS (SELECT img_id, " + ", ".join(f"{c} / (m00 * m00{' * sqrt(m00)' if sum(pq) == 3 else ''}) AS nu{c[2:]}" for c, pq in _MU.items()) + " FROM u)"
register("moments_hu", lambda s, d: M.hu_moments(M.central_moments(M.raw_moments(_PX(s, d), ["img_id"]))).select("img_id", *(F.round(F.col(f"h{i}") * 1e6, 6).alias(f"h{i}") for i in (1, 2, 3, 4))), f"WITH {IMG}, {_CSQL}{_NU} SELECT img_id, round((nu20 + nu02) * 1e6, 6) AS h1, round(((nu20 - nu02) * (nu20 - nu02) + 4 * nu11 * nu11) * 1e6, 6) AS h2, round(((nu30 - 3 * nu12) * (nu30 - 3 * nu12) + (3 * nu21 - nu03) * (3 * nu21 - nu03)) * 1e6, 6) AS h3, round(((nu30 + nu12) * (nu30 + nu12) + (nu21 + nu03) * (nu21 + nu03)) * 1e6, 6) AS h4 FROM n")

# texture, 8 levels
_LEV = lambda s, d: images(s, d).select("img_id", P.each(F.col("img"), lambda v: F.floor(v / 32).cast("int")).alias("img"))
_G = "l AS (SELECT img_id, y, x, CAST(v // 32 AS INT) AS v FROM img), pr AS (SELECT a.img_id, a.v AS i, b.v AS j FROM l a JOIN l b ON a.img_id = b.img_id AND a.y = b.y AND b.x = a.x + 1), sy AS (SELECT * FROM pr UNION ALL SELECT img_id, j, i FROM pr), g AS (SELECT img_id, i, j, count(*) / CAST(112 AS DOUBLE) AS p FROM sy GROUP BY 1, 2, 3)"
register("glcm", lambda s, d: M.glcm(_LEV(s, d), ["img_id"], 8, 8, 0, 1).withColumn("p", F.round("p", 9)), f"WITH {IMG}, {_G} SELECT img_id, i, j, round(p, 9) AS p FROM g")
_HF = ["contrast", "dissimilarity", "homogeneity", "asm", "entropy", "correlation"]
register("glcm_features", lambda s, d: M.haralick(M.glcm(_LEV(s, d), ["img_id"], 8, 8, 0, 1), ["img_id"]).select("img_id", *(F.round(c, 9).alias(c) for c in _HF)), f"WITH {IMG}, {_G}, f AS (SELECT img_id, sum(p*(i-j)*(i-j)) AS contrast, sum(p*abs(i-j)) AS dissimilarity, sum(p/(1+(i-j)*(i-j))) AS homogeneity, sum(p*p) AS asm, -sum(p*ln(p)) AS entropy, sum(p*i) AS mi, sum(p*j) AS mj, sum(p*i*j) AS ij, sum(p*i*i) AS ii, sum(p*j*j) AS jj FROM g GROUP BY 1), h AS (SELECT *, sqrt(greatest(0, ii - mi*mi) * greatest(0, jj - mj*mj)) AS s FROM f) SELECT img_id, round(contrast, 9) AS contrast, round(dissimilarity, 9) AS dissimilarity, round(homogeneity, 9) AS homogeneity, round(asm, 9) AS asm, round(entropy, 9) AS entropy, round(CASE WHEN s < 1e-12 THEN 0 ELSE (ij - mi*mj) / s END, 9) AS correlation FROM h")
register("run_length", lambda s, d: M.run_lengths(pixels(_LEV(s, d), F.col("img")), ["img_id"]), f"WITH {IMG}, l AS (SELECT img_id, y, x, CAST(v // 32 AS INT) AS v FROM img), r AS (SELECT *, x - row_number() OVER (PARTITION BY img_id, y, v ORDER BY x) AS g FROM l), o AS (SELECT img_id, y, v, g, count(*) AS length FROM r GROUP BY ALL) SELECT img_id, v AS level, length, count(*) AS n FROM o GROUP BY ALL")

# metrics: labels.quality against a length rule; scores from the number of characters
_LAB = lambda s, d: table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select("quality", (F.col("n_chars") > 600).cast("int").alias("guess"), (F.col("n_chars") % 1000).alias("score"), "n_chars")
_LS = "l AS (SELECT quality, CAST(n_chars > 600 AS INT) AS guess, n_chars % 1000 AS score, n_chars FROM labels JOIN documents USING (doc_id))"
register("confusion_matrix", lambda s, d: M.confusion(_LAB(s, d), "quality", "guess"), f"WITH {_LS} SELECT quality AS truth, guess AS predicted, count(*) AS n FROM l GROUP BY 1, 2")
register("precision_recall_f1", lambda s, d: M.class_scores(M.confusion(_LAB(s, d), "quality", "guess")).select("label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1"))), f"WITH {_LS}, s AS (SELECT k AS label, CAST(count(*) FILTER (quality = k AND guess = k) AS DOUBLE) AS tp, count(*) FILTER (quality <> k AND guess = k) AS fp, count(*) FILTER (quality = k AND guess <> k) AS fn FROM l, (VALUES (0), (1)) v(k) GROUP BY k) SELECT label, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM s")
register("accuracy", lambda s, d: _LAB(s, d).agg(F.round(F.avg((F.col("quality") == F.col("guess")).cast("double")), 9).alias("accuracy")), f"WITH {_LS} SELECT round(avg(CASE WHEN quality = guess THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy FROM l")
register("roc_curve", lambda s, d: M.roc_curve(_LAB(s, d), "score", "quality").select("threshold", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr")), f"WITH {_LS}, g AS (SELECT score AS threshold, sum(quality) AS p, sum(1 - quality) AS q FROM l GROUP BY 1) SELECT threshold, round(sum(p) OVER w / CAST(sum(p) OVER () AS DOUBLE), 9) AS tpr, round(sum(q) OVER w / CAST(sum(q) OVER () AS DOUBLE), 9) AS fpr FROM g WINDOW w AS (ORDER BY threshold DESC)")
register("roc_auc", lambda s, d: M.auc(_LAB(s, d), "score", "quality").select(F.round("auc", 9).alias("auc")), f"WITH {_LS} SELECT round(sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / CAST(count(*) AS DOUBLE), 9) AS auc FROM (SELECT * FROM l WHERE quality = 1) a, (SELECT * FROM l WHERE quality = 0) b")
register("regression_metrics", lambda s, d: M.regression_scores(_LAB(s, d), "n_chars", "score").select(*(F.round(c, 4).alias(c) for c in ("mse", "rmse", "mae", "r2"))), f"WITH {_LS} SELECT round(avg(CAST((n_chars - score) * (n_chars - score) AS DOUBLE)), 4) AS mse, round(sqrt(avg(CAST((n_chars - score) * (n_chars - score) AS DOUBLE))), 4) AS rmse, round(avg(CAST(abs(n_chars - score) AS DOUBLE)), 4) AS mae, round(1 - avg(CAST((n_chars - score) * (n_chars - score) AS DOUBLE)) / var_pop(n_chars), 4) AS r2 FROM l")
register("image_quality", lambda s, d: M.image_quality(image_pairs(s, d), ["img_id"]).select("img_id", *(F.round(c, 6).alias(c) for c in ("mse", "mae", "psnr", "ssim"))), f"WITH {IMG}, s AS (SELECT a.img_id, avg(CAST((a.v-b.v)*(a.v-b.v) AS DOUBLE)) AS mse, avg(CAST(abs(a.v-b.v) AS DOUBLE)) AS mae, avg(CAST(a.v AS DOUBLE)) AS sa, avg(CAST(b.v AS DOUBLE)) AS sb, avg(CAST(a.v*a.v AS DOUBLE)) AS aa, avg(CAST(b.v*b.v AS DOUBLE)) AS bb, avg(CAST(a.v*b.v AS DOUBLE)) AS ab FROM img a JOIN img b ON b.img_id = a.img_id + 1 AND a.y = b.y AND a.x = b.x GROUP BY 1) SELECT img_id, round(mse, 6) AS mse, round(mae, 6) AS mae, round(CASE WHEN mse = 0 THEN 'inf'::DOUBLE ELSE 10 * log10(65025 / mse) END, 6) AS psnr, round((2*sa*sb + 6.5025) * (2*(ab - sa*sb) + 58.5225) / ((sa*sa + sb*sb + 6.5025) * ((aa - sa*sa) + (bb - sb*sb) + 58.5225)), 6) AS ssim FROM s")

# covariance and clustering of four measures of the images' quadrants
_Q4 = lambda s, d: images(s, d).select("img_id", F.array(*(F.round(F.aggregate(F.slice("img", 1 + 16 * k, 16), F.lit(0.0), lambda a, v: a + v) / 16.0, 6) for k in range(4))).alias("vec"))
_Q4S = "q AS (SELECT img_id, CAST(y // 2 AS INT) AS k, round(avg(CAST(v AS DOUBLE)), 6) AS v FROM img GROUP BY 1, 2)"
register("covariance", lambda s, d: M.covariance(_Q4(s, d), "vec").withColumn("cov", F.round("cov", 6)), f"WITH {IMG}, {_Q4S} SELECT a.k AS i, b.k AS j, round(covar_pop(a.v, b.v), 6) AS cov FROM q a JOIN q b ON a.img_id = b.img_id AND a.k <= b.k GROUP BY 1, 2")
_C0 = [[100.0] * 4, [128.0] * 4, [150.0] * 4]
_W = "w AS (SELECT img_id, max(v) FILTER (k = 0) AS a, max(v) FILTER (k = 1) AS b, max(v) FILTER (k = 2) AS c, max(v) FILTER (k = 3) AS d FROM q GROUP BY 1), c0(k, a, b, c, d) AS (VALUES (0, 100.0::DOUBLE, 100.0::DOUBLE, 100.0::DOUBLE, 100.0::DOUBLE), (1, 128.0, 128.0, 128.0, 128.0), (2, 150.0, 150.0, 150.0, 150.0))"


def _step(i: int) -> str:
    near = f"n{i} AS (SELECT w.*, arg_min(c.k, (round((w.a-c.a)*(w.a-c.a)+(w.b-c.b)*(w.b-c.b)+(w.c-c.c)*(w.c-c.c)+(w.d-c.d)*(w.d-c.d), 9), c.k)) AS cluster FROM w, c{i} c GROUP BY ALL)"
    return f", {near}, c{i + 1} AS (SELECT c.k, " + ", ".join(f"coalesce(round(sum(n.{x}) / count(n.{x}), 9), max(c.{x})) AS {x}" for x in "abcd") + f" FROM c{i} c LEFT JOIN n{i} n ON n.cluster = c.k GROUP BY c.k)"


register("kmeans_fixed_init", lambda s, d: M.nearest_centre(_Q4(s, d), M.kmeans_steps(_Q4(s, d), [list(c) for c in _C0], 3)).select("img_id", "cluster"), f"WITH {IMG}, {_Q4S}, {_W}{_step(0)}{_step(1)}{_step(2)}{_step(3)} SELECT img_id, cluster FROM n3")
register("voxel_downsample", lambda s, d: table(s, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 5).alias("vx"), F.floor((F.col("l_discount") + 0.0) * 50 + 1e-9).alias("vy"), F.floor((F.col("l_tax") + 0.0) * 50 + 1e-9).alias("vz")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("cx"), F.round(F.avg(F.col("l_discount") + 0.0), 6).alias("cy"), F.round(F.avg(F.col("l_tax") + 0.0), 6).alias("cz")), "SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS vx, CAST(floor((l_discount + 0.0) * 50 + 1e-9) AS BIGINT) AS vy, CAST(floor((l_tax + 0.0) * 50 + 1e-9) AS BIGINT) AS vz, count(*) AS n, round(avg(l_quantity), 6) AS cx, round(avg(l_discount + 0.0), 6) AS cy, round(avg(l_tax + 0.0), 6) AS cz FROM lineitem GROUP BY 1, 2, 3")


# bar codes: written as modules and read back; the round trip must give the keys
_BARS = lambda kind, n: lambda s, d: table(s, d, "orders").withColumn("k", _K(n)).withColumn("m", SY.encode(F.col("k"), kind)).select("o_orderkey", F.length("m").alias("modules"), F.substring(SY.read(F.col("m"), kind), 1, n).alias("text"))
for _kind, _len, _size in (("code128", 8, "(8 + 2) * 11 + 13"), ("ean13", 12, "95"), ("itf", 10, "4 + 10 * 9 + 5")):
    register(f"bars_{_kind}", _BARS(_kind, _len), f"SELECT o_orderkey, {_size} AS modules, lpad(CAST(o_orderkey AS VARCHAR), {_len}, '0') AS text FROM orders")

"""Colour queries on three columns of ``lineitem`` as channels, and histogram queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import color as K
from tessera.functions.pixel import u8 as pu8
from tessera.operators import histogram as H
from tessera.plans.common import IMG, images, table, u8
from tessera.plans.registry import register

_KEY = ["l_orderkey", "l_linenumber"]
_RGB = f"rgb AS (SELECT l_orderkey, l_linenumber, {u8('l_quantity * 5')} AS r, {u8('(l_discount + 0.0) * 2500')} AS g, {u8('(l_tax + 0.0) * 3000')} AS b FROM lineitem)"
_ID = "l_orderkey, l_linenumber"


def _rgb(s, d):
    t = table(s, d, "lineitem")
    return t.select(*_KEY, pu8(F.col("l_quantity") * 5).alias("r"), pu8((F.col("l_discount") + 0.0) * 2500).alias("g"), pu8((F.col("l_tax") + 0.0) * 3000).alias("b"))


def _c(name: str, make, names: list[str], sqls: list[str], extra: str = "") -> None:
    def query(s, d):
        out = make(F.col("r"), F.col("g"), F.col("b"))
        out = out if isinstance(out, (tuple, list)) else [out]
        return _rgb(s, d).select(*_KEY, *(c.alias(n) for c, n in zip(out, names, strict=True)))

    register(name, query, f"WITH {_RGB}{extra} SELECT {_ID}, " + ", ".join(f"{e} AS {n}" for e, n in zip(sqls, names, strict=True)) + f" FROM {'x' if extra else 'rgb'}")


_Y = "(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE)"
_HUE = "CAST(floor((CASE WHEN h < 0 THEN h + 360 ELSE h END) / 2 + 0.5) AS INT)"
_HX = ", x AS (SELECT *, greatest(r, g, b) AS v, least(r, g, b) AS lo, CASE WHEN greatest(r,g,b) = least(r,g,b) THEN 0.0::DOUBLE WHEN greatest(r,g,b) = r THEN 60.0::DOUBLE * (g - b) / (greatest(r,g,b) - least(r,g,b)) WHEN greatest(r,g,b) = g THEN 120.0::DOUBLE + 60.0::DOUBLE * (b - r) / (greatest(r,g,b) - least(r,g,b)) ELSE 240.0::DOUBLE + 60.0::DOUBLE * (r - g) / (greatest(r,g,b) - least(r,g,b)) END AS h FROM rgb)"
_c("color_gray601", K.gray601, ["gray"], [u8(_Y)])
_c("color_gray709", K.gray709, ["gray"], [u8("r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE")])
_c("color_hsv", K.hsv, ["h", "s", "v"], [_HUE, f"CASE WHEN v = 0 THEN 0 ELSE {u8('(v - lo) * 255.0::DOUBLE / v')} END", "v"], _HX)
_c("color_hls", K.hls, ["h", "l", "s"], [_HUE, u8("(v / 255.0::DOUBLE + lo / 255.0::DOUBLE) / 2 * 255"), u8("CASE WHEN v = lo THEN 0 WHEN (v / 255.0::DOUBLE + lo / 255.0::DOUBLE) / 2 < 0.5 THEN (v / 255.0::DOUBLE - lo / 255.0::DOUBLE) / (v / 255.0::DOUBLE + lo / 255.0::DOUBLE) ELSE (v / 255.0::DOUBLE - lo / 255.0::DOUBLE) / (2 - v / 255.0::DOUBLE - lo / 255.0::DOUBLE) END * 255")], _HX)
_c("color_ycrcb", K.ycrcb, ["y", "cr", "cb"], [u8(_Y), u8(f"(r - {_Y}) * 0.713::DOUBLE + 128"), u8(f"(b - {_Y}) * 0.564::DOUBLE + 128")])
_c("color_yuv", K.yuv, ["y", "u", "v"], [u8(_Y), u8(f"(b - {_Y}) * 0.492::DOUBLE + 128"), u8(f"(r - {_Y}) * 0.877::DOUBLE + 128")])
_c("color_xyz", K.xyz, ["x", "y", "z"], [u8(f"r * {m[0]}::DOUBLE + g * {m[1]}::DOUBLE + b * {m[2]}::DOUBLE") for m in K.XYZ])
_c("color_sepia", K.sepia, ["r2", "g2", "b2"], [u8(f"r * {m[0]}::DOUBLE + g * {m[1]}::DOUBLE + b * {m[2]}::DOUBLE") for m in ((0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131))])
_KX = ", x AS (SELECT *, 1 - greatest(r, g, b) / 255.0::DOUBLE AS k FROM rgb)"
_c("color_cmyk", K.cmyk, ["c", "m", "y", "k2"], [*(f"CASE WHEN k >= 1 THEN 0 ELSE {u8(f'(1 - {x} / 255.0::DOUBLE - k) / nullif(1 - k, 0) * 255')} END" for x in "rgb"), u8("k * 255")], _KX)


# inverses: the three columns taken as channels of the other space, hue in 0..179
_R2 = ["r2", "g2", "b2"]
_wrap = lambda x, p: f"({x} - floor({x} / {p}::DOUBLE) * {p})"
_hue = lambda step, n, p: _wrap(f"((r % 180) / {step}::DOUBLE + {n})", p)
_D = "{} / 255.0::DOUBLE"
_SV = [u8(f"({_D.format('b')} - {_D.format('b')} * ({_D.format('g')}) * greatest(0.0::DOUBLE, least({_hue(30, n, 6)}, 4 - {_hue(30, n, 6)}, 1.0::DOUBLE))) * 255") for n in (5, 3, 1)]
_c("color_rgb_of_hsv", lambda r, g, b: K.rgb_of_hsv(r % 180, g, b), _R2, _SV)
_LS = [u8(f"({_D.format('g')} - {_D.format('b')} * least({_D.format('g')}, 1 - {_D.format('g')}) * greatest(-1.0::DOUBLE, least({_hue(15, n, 12)} - 3, 9 - {_hue(15, n, 12)}, 1.0::DOUBLE))) * 255") for n in (0, 8, 4)]
_c("color_rgb_of_hls", lambda r, g, b: K.rgb_of_hls(r % 180, g, b), _R2, _LS)
_c("color_rgb_of_ycrcb", K.rgb_of_ycrcb, _R2, [u8("r + (g - 128) * 1.403::DOUBLE"), u8("r - (g - 128) * 0.714::DOUBLE - (b - 128) * 0.344::DOUBLE"), u8("r + (b - 128) * 1.773::DOUBLE")])
_c("color_rgb_of_yuv", K.rgb_of_yuv, _R2, [u8("r + (b - 128) * 1.13983::DOUBLE"), u8("r - (g - 128) * 0.39465::DOUBLE - (b - 128) * 0.58060::DOUBLE"), u8("r + (g - 128) * 2.03211::DOUBLE")])
_c("color_rgb_of_xyz", K.rgb_of_xyz, _R2, [u8(f"r * {m[0]}::DOUBLE + g * ({m[1]})::DOUBLE + b * ({m[2]})::DOUBLE") for m in K.RGB_OF_XYZ])
_F3 = ", t AS (SELECT *, (r * 100.0::DOUBLE / 255 + 16) / 116 AS fy FROM rgb), f AS (SELECT *, fy + (g - 128) / 500.0::DOUBLE AS fx, fy - (b - 128) / 200.0::DOUBLE AS fz FROM t), x AS (SELECT *, " + ", ".join(f"CASE WHEN f{n} * f{n} * f{n} > 0.008856 THEN f{n} * f{n} * f{n} ELSE (f{n} - 16 / 116.0::DOUBLE) / 7.787::DOUBLE END * {w}::DOUBLE AS l{n}" for n, w in zip("xyz", K.WHITE, strict=True)) + " FROM f)"
_c("color_rgb_of_lab", K.rgb_of_lab, _R2, [u8(f"(lx * ({m[0]})::DOUBLE + ly * ({m[1]})::DOUBLE + lz * ({m[2]})::DOUBLE) * 255") for m in K.RGB_OF_XYZ], _F3)
_c("color_rgb_of_cmyk", lambda r, g, b: K.rgb_of_cmyk(r, g, b, F.abs(r - g)), _R2, [u8(f"(1 - {x} / 255.0::DOUBLE) * (1 - abs(r - g) / 255.0::DOUBLE) * 255") for x in "rgb"])


def _fsql(m, w) -> str:
    t = f"((r / 255.0::DOUBLE * {m[0]}::DOUBLE + g / 255.0::DOUBLE * {m[1]}::DOUBLE + b / 255.0::DOUBLE * {m[2]}::DOUBLE) / {w}::DOUBLE)"
    return f"CASE WHEN {t} > 0.008856 THEN pow({t}, 1 / 3.0::DOUBLE) ELSE 7.787::DOUBLE * {t} + 16 / 116.0::DOUBLE END"


_LAB = ", x AS (SELECT *, " + ", ".join(f"{_fsql(m, w)} AS f{n}" for m, w, n in zip(K.XYZ, K.WHITE, "xyz", strict=True)) + " FROM rgb)"
_c("color_lab", lambda r, g, b: [F.round(c, 6) for c in K.lab(r, g, b)], ["l", "a", "bb"], ["round(116 * fy - 16, 6)", "round(500 * (fx - fy), 6)", "round(200 * (fy - fz), 6)"], _LAB)
_c("delta_e76", lambda r, g, b: F.round(K.delta_e76(K.lab(r, g, b), (F.lit(50.0), F.lit(10.0), F.lit(-10.0))), 6), ["de"], ["round(sqrt(pow(116 * fy - 66, 2) + pow(500 * (fx - fy) - 10, 2) + pow(200 * (fy - fz) + 10, 2)), 6)"], _LAB)
_DE94 = (
    _LAB.replace(", x AS", ", lab AS")
    + ", y AS (SELECT *, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS bb FROM lab), x AS (SELECT *, sqrt(a * a + bb * bb) AS c1, sqrt(a * a + bb * bb) - sqrt(200::DOUBLE) AS dc FROM y)"
)
_c("delta_e94", lambda r, g, b: F.round(K.delta_e94(K.lab(r, g, b), (F.lit(50.0), F.lit(10.0), F.lit(-10.0))), 6), ["de"], ["round(sqrt((l - 50) * (l - 50) + (dc / (1 + 0.045 * c1)) * (dc / (1 + 0.045 * c1)) + greatest(0, (a - 10) * (a - 10) + (bb + 10) * (bb + 10) - dc * dc) / ((1 + 0.015 * c1) * (1 + 0.015 * c1))), 6)"], _DE94)
_HUEOF = "CASE WHEN {a} = 0 AND {b} = 0 THEN 0 WHEN atan2({b}, {a}) < 0 THEN degrees(atan2({b}, {a})) + 360 ELSE degrees(atan2({b}, {a})) END"
_DE2000 = _LAB.replace(", x AS", ", lab AS") + (
    ", y AS (SELECT *, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS bb FROM lab), g AS (SELECT *, pow((sqrt(a * a + bb * bb) + sqrt(200::DOUBLE)) / 2, 7) AS m7 FROM y), "
    "s AS (SELECT *, a * (1.5 - 0.5 * sqrt(m7 / (m7 + pow(25::DOUBLE, 7)))) AS a1, 10 * (1.5 - 0.5 * sqrt(m7 / (m7 + pow(25::DOUBLE, 7)))) AS a2 FROM g), "
    f"p AS (SELECT *, sqrt(a1 * a1 + bb * bb) AS c1, sqrt(a2 * a2 + 100) AS c2, {_HUEOF.format(a='a1', b='bb')} AS h1, degrees(atan2(-10::DOUBLE, a2)) + 360 AS h2 FROM s), "
    "q AS (SELECT *, CASE WHEN c1 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 > h1 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh, CASE WHEN c1 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2) / 2 + 180 ELSE (h1 + h2) / 2 - 180 END AS mh, (l + 50) / 2 AS ml, (c1 + c2) / 2 AS mc FROM p), "
    "w AS (SELECT *, 1 - 0.17 * cos(radians(mh - 30)) + 0.24 * cos(radians(2 * mh)) + 0.32 * cos(radians(3 * mh + 6)) - 0.2 * cos(radians(4 * mh - 63)) AS t FROM q), "
    "z AS (SELECT *, (50 - l) / (1 + 0.015 * (ml - 50) * (ml - 50) / sqrt(20 + (ml - 50) * (ml - 50))) AS dx, (c2 - c1) / (1 + 0.045 * mc) AS dy, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * mc * t) AS dz, 2 * sqrt(pow(mc, 7) / (pow(mc, 7) + pow(25::DOUBLE, 7))) * sin(radians(60 * exp(-((mh - 275) / 25) * ((mh - 275) / 25)))) AS rt FROM w), "
    "x AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz - rt * dy * dz) AS de2000 FROM z)"
)
_c("delta_e2000", lambda r, g, b: F.round(K.delta_e2000(K.lab(r, g, b), (F.lit(50.0), F.lit(10.0), F.lit(-10.0))), 6), ["de"], ["round(de2000, 6)"], _DE2000)
_c("color_transform", lambda r, g, b: K.transform([r, g, b], [[0.5, 0.25, 0.25], [0.0, 1.0, -0.5]], [4.0, 8.0]), ["p", "q"], [u8("4.0 + r * 0.5::DOUBLE + g * 0.25::DOUBLE + b * 0.25::DOUBLE"), u8("8.0 + r * 0::DOUBLE + g * 1.0::DOUBLE + b * (-0.5)::DOUBLE")])

# histograms: image pixels per label-free image id, and prices by priority
_PIX = lambda s, d: images(s, d).select("img_id", F.explode("img").alias("v"))
_HIST16 = lambda s, d: H.histogram(_PIX(s, d), ["img_id"], H.bin_of(F.col("v"), 16, 0, 256), 16)
_BINS = "bins AS (SELECT i.img_id, CAST(b.range AS INT) AS bin FROM (SELECT DISTINCT img_id FROM img) i, range(16) b), hist AS (SELECT bins.img_id, bins.bin, count(img.v) AS n FROM bins LEFT JOIN img ON img.img_id = bins.img_id AND img.v // 16 = bins.bin GROUP BY ALL)"
register("hist_1d", _HIST16, f"WITH {IMG}, {_BINS} SELECT img_id, bin, n FROM hist")
_PRICE = lambda s, d: table(s, d, "orders").select(F.col("o_orderpriority").alias("k"), H.bin_of(F.col("o_totalprice"), 256, 0, 500000).alias("b"))
_PHIST = lambda s, d: H.histogram(_PRICE(s, d), ["k"], F.col("b"), 256)
_PSQL = "o AS (SELECT o_orderpriority AS k, CAST(greatest(0, least(255, floor((o_totalprice - 0) * (256 / 500000.0::DOUBLE)))) AS INT) AS bin FROM orders), h AS (SELECT ks.k, CAST(b.range AS INT) AS bin, count(o.bin) AS n FROM (SELECT DISTINCT k FROM o) ks CROSS JOIN range(256) b LEFT JOIN o ON o.k = ks.k AND o.bin = b.range GROUP BY ALL)"
_CUM = ", c AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY bin) AS cdf, sum(n) OVER (PARTITION BY k) AS total FROM h), c2 AS (SELECT *, min(CASE WHEN cdf > 0 THEN cdf END) OVER (PARTITION BY k) AS first FROM c)"
register("hist_cdf", lambda s, d: H.cumulative(_PHIST(s, d), ["k"]).select("k", "bin", "cdf"), f"WITH {_PSQL}{_CUM} SELECT k, bin, CAST(cdf AS BIGINT) AS cdf FROM c2")
register("equalize_hist", lambda s, d: H.equalize_map(_PHIST(s, d), ["k"]), f"WITH {_PSQL}{_CUM} SELECT k, bin, CASE WHEN total = first THEN bin ELSE CAST(floor(greatest(0.0, least(255.0, (cdf - first) * 255.0::DOUBLE / (total - first) + 0.5))) AS INT) END AS v FROM c2")
_MOM = ", m AS (SELECT *, CAST(sum(n) OVER u AS DOUBLE) AS w0, CAST(sum(bin * n) OVER u AS DOUBLE) AS s0, CAST(sum(n) OVER p AS DOUBLE) AS w, CAST(sum(bin * n) OVER p AS DOUBLE) AS s FROM h WINDOW u AS (PARTITION BY k ORDER BY bin), p AS (PARTITION BY k))"
_PICK = "SELECT k, CAST(arg_max(bin, (score, -bin)) AS INT) AS t FROM z GROUP BY k"
register("otsu", lambda s, d: H.otsu(_PHIST(s, d), ["k"]), f"WITH {_PSQL}{_MOM}, z AS (SELECT k, bin, round(w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)), 6) AS score FROM m WHERE w0 > 0 AND w0 < w) {_PICK}")
register("isodata", lambda s, d: H.isodata(_PHIST(s, d), ["k"]), f"WITH {_PSQL}{_MOM}, z AS (SELECT k, bin, -abs(floor((s0 / w0 + (s - s0) / (w - w0)) / 2) - bin) AS score FROM m WHERE w0 > 0 AND w0 < w) {_PICK}")
register("kapur", lambda s, d: H.kapur(_PHIST(s, d), ["k"]), f"WITH {_PSQL}, p AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY k) AS p FROM h), e AS (SELECT *, CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END AS e FROM p), m AS (SELECT *, sum(p) OVER u AS p0, sum(e) OVER u AS e0, sum(e) OVER a AS e1, sum(n) OVER u AS w0, sum(n) OVER a AS w FROM e WINDOW u AS (PARTITION BY k ORDER BY bin), a AS (PARTITION BY k)), z AS (SELECT k, bin, round(ln(p0) - e0 / p0 + ln(1 - p0) - (e1 - e0) / (1 - p0), 9) AS score FROM m WHERE w0 > 0 AND w0 < w) {_PICK}")
register("yen", lambda s, d: H.yen(_PHIST(s, d), ["k"]), f"WITH {_PSQL}, m AS (SELECT *, sum(CAST(n AS DOUBLE)) OVER u AS w0, sum(CAST(n AS DOUBLE) * n) OVER u AS q0, sum(CAST(n AS DOUBLE)) OVER a AS w, sum(CAST(n AS DOUBLE) * n) OVER a AS q FROM h WINDOW u AS (PARTITION BY k ORDER BY bin), a AS (PARTITION BY k)), z AS (SELECT k, bin, round(2 * ln(w0 * (w - w0)) - ln(q0 * (q - q0)), 9) AS score FROM m WHERE w0 > 0 AND w0 < w AND q0 > 0 AND q0 < q) {_PICK}")
register("cross_entropy", lambda s, d: H.cross_entropy(_PHIST(s, d), ["k"]), f"WITH {_PSQL}, m AS (SELECT *, CAST(sum(n) OVER u AS DOUBLE) AS w0, CAST(sum((bin + 1) * n) OVER u AS DOUBLE) AS s0, CAST(sum(n) OVER a AS DOUBLE) AS w, CAST(sum((bin + 1) * n) OVER a AS DOUBLE) AS s FROM h WINDOW u AS (PARTITION BY k ORDER BY bin), a AS (PARTITION BY k)), z AS (SELECT k, bin, round(s0 * ln(s0 / w0) + (s - s0) * ln((s - s0) / (w - w0)), 6) AS score FROM m WHERE w0 > 0 AND w0 < w) {_PICK}")
register("minimum_error", lambda s, d: H.minimum_error(_PHIST(s, d), ["k"]), f"WITH {_PSQL}, m AS (SELECT *, CAST(sum(n) OVER u AS DOUBLE) AS w0, CAST(sum(bin * n) OVER u AS DOUBLE) AS s0, CAST(sum(bin * bin * n) OVER u AS DOUBLE) AS q0, CAST(sum(n) OVER a AS DOUBLE) AS w, CAST(sum(bin * n) OVER a AS DOUBLE) AS s, CAST(sum(bin * bin * n) OVER a AS DOUBLE) AS q FROM h WINDOW u AS (PARTITION BY k ORDER BY bin), a AS (PARTITION BY k)), v AS (SELECT *, w - w0 AS w1, w0 * q0 - s0 * s0 AS d0, (w - w0) * (q - q0) - (s - s0) * (s - s0) AS d1 FROM m WHERE w0 > 0 AND w0 < w), z AS (SELECT k, bin, round(-(w0 * (ln(sqrt(d0) / w0) - ln(w0 / w)) + w1 * (ln(sqrt(d1) / w1) - ln(w1 / w))) / w, 9) AS score FROM v WHERE d0 > 0 AND d1 > 0) {_PICK}")
register("triangle", lambda s, d: H.triangle(_PHIST(s, d), ["k"]), f"WITH {_PSQL}, a AS (SELECT *, min(CASE WHEN n > 0 THEN bin END) OVER w AS lo, max(CASE WHEN n > 0 THEN bin END) OVER w AS hi, max(n) OVER w AS top FROM h WINDOW w AS (PARTITION BY k)), b AS (SELECT *, min(CASE WHEN n = top THEN bin END) OVER (PARTITION BY k) AS peak FROM a), c AS (SELECT *, CASE WHEN peak - lo > hi - peak THEN lo ELSE hi END AS e FROM b), z AS (SELECT k, bin, abs((e - peak) * (n - top) + top * (bin - peak)) AS score FROM c WHERE bin BETWEEN least(peak, e) AND greatest(peak, e)) {_PICK}")
register("percentile_threshold", lambda s, d: H.percentile_bin(_PHIST(s, d), ["k"], 0.9), f"WITH {_PSQL}{_CUM} SELECT k, min(bin) AS t FROM c2 WHERE cdf >= 0.9 * total GROUP BY k")


def _flag(s, d, flag):
    t = table(s, d, "lineitem").where(F.col("l_linestatus") == flag)
    return H.histogram(t, ["l_returnflag"], H.bin_of(F.col("l_quantity"), 50, 1, 51), 50)


_QH = "q AS (SELECT l_returnflag, l_linestatus, CAST(greatest(0, least(49, floor(l_quantity - 1))) AS INT) AS bin FROM lineitem), g AS (SELECT DISTINCT l_returnflag, l_linestatus FROM q), h AS (SELECT g.*, CAST(b.range AS INT) AS bin, CAST(count(q.bin) AS DOUBLE) AS n FROM g CROSS JOIN range(50) b LEFT JOIN q ON q.l_returnflag = g.l_returnflag AND q.l_linestatus = g.l_linestatus AND q.bin = b.range GROUP BY ALL)"
_J = ", j0 AS (SELECT coalesce(a.l_returnflag, b.l_returnflag) AS l_returnflag, coalesce(a.bin, b.bin) AS bin, coalesce(a.n, 0) AS p, coalesce(b.n, 0) AS q FROM (SELECT * FROM h WHERE l_linestatus = 'F') a FULL JOIN (SELECT * FROM h WHERE l_linestatus = 'O') b ON a.l_returnflag = b.l_returnflag AND a.bin = b.bin), j AS (SELECT *, sum(p) OVER w AS sp, sum(q) OVER w AS sq, count(*) OVER w AS k FROM j0 WINDOW w AS (PARTITION BY l_returnflag)), jj AS (SELECT *, sum(p / sp - q / sq) OVER (PARTITION BY l_returnflag ORDER BY bin) AS up, p - sp / k AS dp, q - sq / k AS dq FROM j)"
register(
    "hist_compare",
    lambda s, d: H.compare(_flag(s, d, "F"), _flag(s, d, "O"), ["l_returnflag"]).select("l_returnflag", *(F.round(c, 6).alias(c) for c in ("correlation", "chi_square", "intersection", "bhattacharyya", "kl", "emd"))),
    f"""WITH {_QH}{_J} SELECT l_returnflag,
    round(CASE WHEN sqrt(sum(dp*dp)*sum(dq*dq)) = 0 THEN 1 ELSE sum(dp*dq) / nullif(sqrt(sum(dp*dp)*sum(dq*dq)), 0) END, 6) AS correlation,
    round(sum(CASE WHEN p > 0 THEN (p-q)*(p-q)/p ELSE 0 END), 6) AS chi_square, round(sum(least(p, q)), 6) AS intersection,
    round(sqrt(greatest(0, 1 - sum(sqrt(p*q)) / nullif(sqrt(max(sp)*max(sq)), 0))), 6) AS bhattacharyya,
    round(sum(CASE WHEN p > 0 AND q > 0 THEN p/sp*ln((p/sp)/(q/sq)) WHEN p > 0 THEN 'inf'::DOUBLE ELSE 0 END), 6) AS kl, round(sum(abs(up)), 6) AS emd FROM jj GROUP BY l_returnflag""",
)
register("hist_2d", lambda s, d: table(s, d, "lineitem").groupBy(H.bin_of(F.col("l_quantity"), 10, 1, 51).alias("bq"), H.bin_of(F.col("l_discount") + 0.0, 11, -0.005, 0.105).alias("bd")).agg(F.count("*").alias("n")), "SELECT CAST(greatest(0, least(9, floor((l_quantity - 1) * 0.2::DOUBLE))) AS INT) AS bq, CAST(greatest(0, least(10, floor((l_discount + 0.0 - (-0.005)) * (11 / (0.105::DOUBLE - (-0.005)))))) AS INT) AS bd, count(*) AS n FROM lineitem GROUP BY 1, 2")

# global statistics per image
register(
    "image_stats",
    lambda s, d: _PIX(s, d).groupBy("img_id").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.sum("v").alias("total"), F.round(F.sqrt(F.sum(F.col("v") * F.col("v")).cast("double")), 6).alias("l2"), F.max("v").alias("linf"), F.min("v").alias("low"), F.median("v").alias("median"), F.count_if(F.col("v") != 0).alias("nonzero")),
    f"WITH {IMG} SELECT img_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, CAST(sum(v) AS BIGINT) AS total, round(sqrt(CAST(sum(v * v) AS DOUBLE)), 6) AS l2, max(v) AS linf, min(v) AS low, median(v) AS median, count(*) FILTER (v <> 0) AS nonzero FROM img GROUP BY img_id",
)
register("min_max_loc", lambda s, d: images(s, d).select("img_id", F.array_min("img").alias("lo"), (F.array_position("img", F.array_min("img")) - 1).alias("lo_at"), F.array_max("img").alias("hi"), (F.array_position("img", F.array_max("img")) - 1).alias("hi_at")), f"WITH {IMG} SELECT img_id, min(v) AS lo, arg_min(y * 8 + x, (v, y * 8 + x)) AS lo_at, max(v) AS hi, arg_min(y * 8 + x, (-v, y * 8 + x)) AS hi_at FROM img GROUP BY img_id")
register("entropy", lambda s, d: _HIST16(s, d).where("n > 0").groupBy("img_id").agg(F.round(-F.sum(F.col("n") / 64.0 * F.log2(F.col("n") / 64.0)), 6).alias("bits")), f"WITH {IMG}, {_BINS} SELECT img_id, round(-sum(n / 64.0::DOUBLE * log2(n / 64.0::DOUBLE)), 6) AS bits FROM hist WHERE n > 0 GROUP BY img_id")
register("reduce_rows", lambda s, d: images(s, d).select("img_id", F.posexplode("img").alias("i", "v")).groupBy("img_id", F.floor(F.col("i") / 8).cast("int").alias("y")).agg(F.sum("v").alias("total"), F.max("v").alias("high"), F.min("v").alias("low"), F.avg("v").alias("mean")), f"WITH {IMG} SELECT img_id, y, CAST(sum(v) AS BIGINT) AS total, max(v) AS high, min(v) AS low, avg(v) AS mean FROM img GROUP BY img_id, y")
register("reduce_cols", lambda s, d: images(s, d).select("img_id", F.posexplode("img").alias("i", "v")).groupBy("img_id", (F.col("i") % 8).alias("x")).agg(F.sum("v").alias("total"), F.max("v").alias("high"), F.min("v").alias("low"), F.avg("v").alias("mean")), f"WITH {IMG} SELECT img_id, x, CAST(sum(v) AS BIGINT) AS total, max(v) AS high, min(v) AS low, avg(v) AS mean FROM img GROUP BY img_id, x")

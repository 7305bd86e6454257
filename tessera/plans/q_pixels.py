"""Point-wise queries: arithmetic, masks, tone and colour-free mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import pixel as P
from tessera.plans.common import image_pairs, images, pair_sql, pixels, point_sql, u8
from tessera.plans.registry import register


def _two(name: str, f, sql: str) -> None:
    register(name, lambda s, d: pixels(image_pairs(s, d), P.both(F.col("a"), F.col("b"), f)), pair_sql(sql))


def _one(name: str, f, sql: str) -> None:
    register(name, lambda s, d: pixels(images(s, d), P.each(F.col("img"), f)), point_sql(sql))


_two("px_add_sat", P.add, "least(255, a.v + b.v)")
_two("px_sub_sat", P.subtract, "greatest(0, a.v - b.v)")
_two("px_absdiff", P.absdiff, "abs(a.v - b.v)")
_two("px_addweighted", lambda a, b: P.add_weighted(a, 0.75, b, 0.5, -20.0), u8("a.v * 0.75 + b.v * 0.5 + (-20.0)"))
_two("px_mul", lambda a, b: P.multiply(a, b, 1 / 128), u8("CAST(a.v AS DOUBLE) * b.v * 0.0078125"))
_two("px_div", lambda a, b: P.divide(a, b, 64.0), f"CASE WHEN b.v = 0 THEN 0 ELSE {u8('CAST(a.v AS DOUBLE) * 64 / b.v')} END")
_two("px_and", P.bit_and, "a.v & b.v")
_two("px_or", P.bit_or, "a.v | b.v")
_two("px_xor", P.bit_xor, "xor(a.v, b.v)")
_two("px_min", lambda a, b: F.least(a, b), "least(a.v, b.v)")
_two("px_max", lambda a, b: F.greatest(a, b), "greatest(a.v, b.v)")
def _compare(op: str):
    return lambda a, b: P.compare(a, b, op)


def _threshold(mode: str):
    return lambda v: P.threshold(v, 120, 200, mode)


for _op, _sign in (("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<="), ("eq", "="), ("ne", "<>")):
    _two(f"cmp_{_op}", _compare(_op), f"CASE WHEN a.v {_sign} b.v THEN 255 ELSE 0 END")
_two("px_magnitude", lambda a, b: F.round(F.sqrt((a * a + b * b).cast("double")), 6), "round(sqrt(CAST(a.v * a.v + b.v * b.v AS DOUBLE)), 6)")
_two("px_phase", lambda a, b: F.round(P.phase(a - 128, b - 128), 6), "round(CASE WHEN atan2(b.v - 128, a.v - 128) < 0 THEN atan2(b.v - 128, a.v - 128) + 6.283185307179586 ELSE atan2(b.v - 128, a.v - 128) END, 6)")
_two("px_scale_add", lambda a, b: a * 0.5 + b, "a.v * CAST(0.5 AS DOUBLE) + b.v")
_two("mask_copy", lambda a, b: F.when(b > 127, a).otherwise(0), "CASE WHEN b.v > 127 THEN a.v ELSE 0 END")
_one("px_not", P.bit_not, "255 - v")
_one("px_convertscaleabs", lambda v: P.convert_scale_abs(v, -1.5, 100.0), u8("abs(v * (-1.5) + 100.0)"))
_one("px_sqrt", lambda v: F.round(F.sqrt(v.cast("double")), 6), "round(sqrt(CAST(v AS DOUBLE)), 6)")
_one("px_exp", lambda v: F.round(F.exp(v / 64.0), 6), "round(exp(v / CAST(64 AS DOUBLE)), 6)")
_one("px_log", lambda v: F.round(P.safe_log(v + 1), 6), "round(ln(CAST(v + 1 AS DOUBLE)), 6)")
_one("px_pow", lambda v: F.round(P.power(v - 128, 1.5), 4), "round(pow(CAST(abs(v - 128) AS DOUBLE), 1.5), 4)")
_one("lut_gamma", lambda v: P.gamma(v, 0.5), u8("pow(v / CAST(255 AS DOUBLE), 0.5) * 255"))
_one("log_transform", P.log_scale, u8("ln(1.0 + CAST(v AS DOUBLE)) * 45.98590442833571"))
_one("lut_table", lambda v: P.lut(v, F.array(*(F.lit((i * 7 + 3) % 256) for i in range(256)))), "(v * 7 + 3) % 256")
_one("bit_plane", lambda v: P.bit_plane(v, 6), "CASE WHEN (v >> 6) & 1 = 1 THEN 255 ELSE 0 END")
_one("posterize", lambda v: P.posterize(v, 8), "least(255, (v // 32) * 32 + 16)")
_one("in_range", lambda v: P.in_range(v, 90, 160), "CASE WHEN v BETWEEN 90 AND 160 THEN 255 ELSE 0 END")
for _mode, _sql in (
    ("binary", "CASE WHEN v > 120 THEN 200 ELSE 0 END"),
    ("binary_inv", "CASE WHEN v > 120 THEN 0 ELSE 200 END"),
    ("trunc", "CASE WHEN v > 120 THEN 120 ELSE v END"),
    ("tozero", "CASE WHEN v > 120 THEN v ELSE 0 END"),
    ("tozero_inv", "CASE WHEN v > 120 THEN 0 ELSE v END"),
):
    _one(f"threshold_{_mode}", _threshold(_mode), _sql)
register(
    "px_normalize",
    lambda s, d: pixels(images(s, d), P.normalize(F.col("img"), 0, 255)),
    point_sql(f"CASE WHEN max(v) OVER w = min(v) OVER w THEN 0 ELSE {u8('(v - min(v) OVER w) * (CAST(255 AS DOUBLE) / nullif(max(v) OVER w - min(v) OVER w, 0)) + 0')} END") + " WINDOW w AS (PARTITION BY img_id)",
)
register("find_nonzero", lambda s, d: pixels(images(s, d), P.each(F.col("img"), lambda v: P.threshold(v, 140, 255, "tozero"))).where("v <> 0").select("img_id", "y", "x"), point_sql("v").replace(", v AS v", "") + " WHERE v > 140")

"""Inverse conversions against Python's own colour module, and round trips."""

import colorsys
import math

from pyspark.sql import functions as F

from tessera.functions import color as K


def _u8(x):
    return math.floor(min(255, max(0, x * 255 + 0.5)))


def test_inverses_of_hue_spaces(spark):
    rows = [(h, s, v) for h in (0, 15, 30, 59, 60, 90, 120, 150, 179) for s in (0, 1, 128, 255) for v in (0, 77, 200, 255)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    got = df.select("a", "b", "c", F.array(*K.rgb_of_hsv(F.col("a"), F.col("b"), F.col("c"))).alias("hsv"), F.array(*K.rgb_of_hls(F.col("a"), F.col("b"), F.col("c"))).alias("hls")).collect()
    for r in got:
        for out, want in ((r.hsv, colorsys.hsv_to_rgb(r.a / 180, r.b / 255, r.c / 255)), (r.hls, colorsys.hls_to_rgb(r.a / 180, r.b / 255, r.c / 255))):
            assert all(abs(x - _u8(w)) <= 1 for x, w in zip(out, want, strict=True))


def test_primaries_come_back(spark):
    rows = [(r, g, b) for r in (0, 255) for g in (0, 255) for b in (0, 255)] + [(10, 200, 90), (33, 34, 35)]
    df = spark.createDataFrame(rows, "r int, g int, b int")
    rgb = [F.col(c) for c in "rgb"]
    lab = K.lab(*rgb)
    there = {"hsv": K.hsv(*rgb), "hls": K.hls(*rgb), "ycrcb": K.ycrcb(*rgb), "yuv": K.yuv(*rgb), "cmyk": K.cmyk(*rgb), "lab": (K.u8(lab[0] * 255 / 100), K.u8(lab[1] + 128), K.u8(lab[2] + 128))}
    for name, channels in there.items():
        slack = {"hsv": 3, "hls": 3, "cmyk": 2}.get(name, 6)
        names = [f"c{i}" for i in range(len(channels))]
        mid = df.select(*rgb, *(c.alias(n) for c, n in zip(channels, names, strict=True)))
        for row in mid.select(*rgb, F.array(*getattr(K, f"rgb_of_{name}")(*(F.col(n) for n in names))).alias("back")).collect():
            if name in ("ycrcb", "yuv") and 255 in row[:3]:
                continue  # chroma of saturated colours leaves the 8 bits
            assert all(abs(x - y) <= slack for x, y in zip(row[:3], row.back, strict=True)), (name, row)

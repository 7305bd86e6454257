"""Record filters, channel functions and codes on nulls, ties and empty rows; window sums against loops."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import pixel as P
from tessera.functions import vector as V
from tessera.operators import histogram as H
from tessera.operators import raster as R
from tessera.operators import records as RC


def test_filters_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, 0, 0, 5.0), (1, 4, 4, 5.0), (1, 2, 2, None), (2, 9, 9, 1.0)], "k int, y int, x int, s double")
    assert {(r.y, r.x) for r in RC.within(df, F.col("s"), 2).collect()} == {(0, 0), (4, 4)}
    assert RC.within(df, F.col("s")).count() == 3 and RC.within(df, F.col("s"), most=1).count() == 1
    assert {(r.y, r.x) for r in RC.off_border(df, 10, 10, 1).collect()} == {(4, 4), (2, 2)}
    assert {(r.k, r.y) for r in RC.retain_best(df, ["k"], "s", 1, ["y"]).collect()} == {(1, 0), (2, 9)}
    assert {r.y for r in RC.retain_best(df, ["k"], "s", 9, ["y"]).where("k = 1").collect()} == {0, 2, 4}
    assert RC.retain_best(df.where("k > 5"), ["k"], "s", 1, ["y"]).collect() == []


def test_channels_of_null_and_empty_images(spark):
    df = spark.createDataFrame([(0, [1, 2, 3, 4, 5, 6], [7, 8]), (1, [], []), (2, None, None)], "id int, a array<int>, b array<int>")
    out = df.select("id", P.extract_channel(F.col("a"), 3, 1).alias("e"), P.insert_channel(F.col("a"), 3, 0, F.col("b")).alias("i"), P.mix_channels([(F.col("a"), 3), (F.col("b"), 1)], [(1, 0), (0, 2)]).alias("m"))
    got = {r.id: (r.e, r.i, r.m) for r in out.collect()}
    assert got[0] == ([2, 5], [7, 2, 3, 8, 5, 6], [7, 3, 8, 6])
    assert got[1] == ([], [], []) and got[2] == (None, None, None)


def test_codes_survive_hex(spark):
    df = spark.createDataFrame([(0,), (1,), (-1,), (-(2**63),), (2**63 - 1,), (None,)], "c long")
    for r in df.select("c", V.code_to_hex(F.col("c")).alias("h")).withColumn("d", V.hex_to_code(F.col("h"))).collect():
        assert r.c == r.d and (r.c is None or r.h == f"{r.c % 2**64:016x}")
    assert spark.sql("SELECT 'xyz' AS t").select(V.hex_to_code(F.col("t"))).first()[0] is None


def test_window_and_tilted_sums():
    a = np.random.default_rng(3).integers(0, 256, (2, 5, 7))
    n, s, q = R.window_stats(a, 3)
    t = R.integral_tilted(a)
    for i in range(2):
        for y in range(5):
            for x in range(7):
                w = a[i, max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
                assert (n[i, y, x], s[i, y, x], q[i, y, x]) == (w.size, w.sum(), (w * w).sum())
        for y in range(6):
            for x in range(8):
                assert t[i, y, x] == sum(a[i, r, c] for r in range(y) for c in range(7) if abs(c - x + 1) < y - r)
    assert R.region(a, -1, 5, 3, 9).shape == (2, 2, 2) and R.repeat(a, 2, 2).shape == (2, 10, 14)


def test_histogram_maps_without_counts(spark):
    h = spark.createDataFrame([("a", 0, 2), ("a", 1, 2), ("b", 0, 0), ("b", 1, 0)], "k string, bin int, n long")
    assert {(r.k, r.bin): r.v for r in H.back_project_map(h, ["k"]).collect()} == {("a", 0): 255, ("a", 1): 255, ("b", 0): 0, ("b", 1): 0}
    s = {r.k: (r["mean"], r.variance, r.peak) for r in H.summary(h, ["k"]).collect()}
    assert s == {"a": (0.5, 0.25, 0), "b": (None, None, None)}
    assert {(r.k, r.bin): r.v for r in H.match_map(h, h.where("k = 'a'"), ["k"], 2).collect()} == {("a", 0): 0, ("a", 1): 1, ("b", 0): 0, ("b", 1): 1}

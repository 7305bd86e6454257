"""Operators over ordered frames or events: differences, trailing windows, folds, motion history, shots, resampling.

Frames are rows with a key (a pixel, a user, a camera), an order and a value. Window functions partition by key, so
keys spread over the cluster; folds run as one pass over a key's rows in order. The same steps for unbounded input are
in ``tessera.streaming``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def frame_difference(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str) -> DataFrame:
    """``diff``: absolute change from the frame before; rows without one go."""
    return df.withColumn("diff", F.abs(F.col(v) - F.lag(v).over(_w(keys, order)))).where("diff is not null")


def three_frame_difference(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str) -> DataFrame:
    """``diff``: the smaller of the changes from the frame before and to the frame after."""
    w = _w(keys, order)
    d = F.least(F.abs(F.col(v) - F.lag(v).over(w)), F.abs(F.lead(v).over(w) - F.col(v)))
    return df.withColumn("diff", F.when(F.lag(v).over(w).isNotNull() & F.lead(v).over(w).isNotNull(), d)).where("diff is not null")


def moving_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str, n: int) -> DataFrame:
    """``mean`` of the last n frames, fewer at the start."""
    return df.withColumn("mean", F.avg(v).over(_w(keys, order).rowsBetween(-(n - 1), 0)))


def smooth(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str, radius: int) -> DataFrame:
    """``smooth``: the mean of a symmetric window, shorter at both ends."""
    return df.withColumn("smooth", F.avg(v).over(_w(keys, order).rowsBetween(-radius, radius)))


def cumulative_path(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str) -> DataFrame:
    return df.withColumn("path", F.sum(v).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, step, kind: str = "double") -> DataFrame:
    """``df`` with column ``out``: ``step(state, row dict) -> (state, value)`` over each key's rows in order.

    Rows meet by key in one shuffle, sorted, and stream through with one state in memory, however long a key's run.
    """
    names = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for f in frames:
            values = []
            for row in f.to_dict("records"):
                k = tuple(row[c] for c in keys)
                if k != key:
                    key, state = k, None
                state, value = step(state, row)
                values.append(value)
            yield f.assign(**{out: values})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*names).mapInPandas(run, f"{fields}, `{out}` {kind}")


def ema(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str, alpha: float) -> DataFrame:
    """``ema``: s + alpha * (v - s), starting at the first value."""

    def step(s, row):
        s = row[v] if s is None else s + alpha * (row[v] - s)
        return s, s

    return fold(df, keys, order, "ema", step)


def kalman_1d(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str, q: float, r: float) -> DataFrame:
    """``filtered``: a constant-position Kalman filter with process noise q and measurement noise r."""

    def step(s, row):
        if s is None:
            return (row[v], 1.0), row[v]
        x, p = s
        p += q
        k = p / (p + r)
        x += k * (row[v] - x)
        return (x, (1 - k) * p), x

    return fold(df, keys, order, "filtered", step)


def kalman_velocity(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str, q: float, r: float) -> DataFrame:
    """``filtered``: a constant-velocity Kalman filter."""

    def step(s, row):
        if s is None:
            return (np.array([row[v], 0.0]), np.eye(2)), float(row[v])
        x, p = s
        a = np.array([[1.0, 1.0], [0.0, 1.0]])
        x, p = a @ x, a @ p @ a.T + q * np.eye(2)
        k = p[:, 0] / (p[0, 0] + r)
        x = x + k * (row[v] - x[0])
        p = p - np.outer(k, p[0])
        return (x, p), float(x[0])

    return fold(df, keys, order, "filtered", step)


def cusum(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str, drift: float, limit: float) -> DataFrame:
    """``alarm``: 1 where the sum of rises above ``drift`` from the running mean passes ``limit``, and starts anew."""

    def step(s, row):
        n, mean, up = s or (0, 0.0, 0.0)
        up = max(0.0, up + row[v] - mean - drift) if n else 0.0
        mean = (mean * n + row[v]) / (n + 1)
        return (0, 0.0, 0.0) if up > limit else (n + 1, mean, up), int(up > limit)

    return fold(df, keys, order, "alarm", step, "int")


def running_background(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str, rate: float, threshold: float) -> DataFrame:
    """``foreground`` 255/0: whether a value differs from the running average background by more than ``threshold``;
    the background then moves by ``rate``."""

    def step(s, row):
        if s is None:
            return float(row[v]), 0
        return s + rate * (row[v] - s), 255 if abs(row[v] - s) > threshold else 0

    return fold(df, keys, order, "foreground", step, "int")


def gaussian_background(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str, rate: float, sigmas: float, start_var: float = 225.0) -> DataFrame:
    """``foreground`` 255/0 under one adaptive Gaussian a key; matched values update mean and variance."""

    def step(s, row):
        if s is None:
            return (float(row[v]), start_var), 0
        m, var = s
        d = row[v] - m
        if d * d > sigmas * sigmas * var:
            return s, 255
        return (m + rate * d, max(4.0, var + rate * (d * d - var))), 0

    return fold(df, keys, order, "foreground", step, "int")


def motion_history(df: DataFrame, keys: Sequence[str], order: Sequence[str], t: str, moving: Column, duration: float) -> DataFrame:
    """``mhi``: the time of the last motion at or before a row, 0 if older than ``duration`` or never."""
    last = F.max(F.when(moving, F.col(t))).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("mhi", F.when(last >= F.col(t) - duration, last).otherwise(0.0))


def shot_boundaries(hist: DataFrame, frame: str, bin_col: str, n: str, threshold: float) -> DataFrame:
    """(frame, change): where the L1 distance of a frame's normalised histogram from the one before exceeds
    ``threshold``. ``hist`` has every bin of every frame."""
    share = F.col(n) / F.sum(n).over(Window.partitionBy(frame))
    s = hist.withColumn("_s", share)
    prev = F.lag("_s").over(Window.partitionBy(bin_col).orderBy(frame))
    return s.withColumn("_p", prev).where("_p is not null").groupBy(frame).agg(F.sum(F.abs(F.col("_s") - F.col("_p"))).alias("change")).where(F.col("change") > threshold)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, values: Sequence[str]) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` at or before its time, per key: one union and one
    window, no join of ranges."""
    a = left.withColumn("_side", F.lit(1))
    b = right.select(*keys, t, *(F.col(v).alias(f"_{v}") for v in values)).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({v: F.last(F.when(F.col("_side") == 0, F.struct(F.col(f"_{v}").alias("x"))), ignorenulls=True).over(w)["x"] for v in values})
    return out.where("_side = 1").select(*left.columns, *values)


def resample(df: DataFrame, keys: Sequence[str], t: str, v: str, step: int) -> DataFrame:
    """(keys..., tick, v): the value that holds at each multiple of ``step`` seconds between a key's first and last row."""
    sec = F.unix_timestamp(t)
    last = df.withColumn("_s", sec).withColumn("_end", F.lead("_s").over(Window.partitionBy(*keys).orderBy("_s", t)))
    ticks = F.sequence((F.ceil(F.col("_s") / step) * step).cast("bigint"), (F.ceil(F.col("_end") / step) * step).cast("bigint") - step, F.lit(step).cast("bigint"))
    span = last.where((F.col("_end").isNotNull()) & (F.ceil(F.col("_s") / step) < F.ceil(F.col("_end") / step)))
    return span.select(*keys, F.explode(ticks).alias("tick"), v)

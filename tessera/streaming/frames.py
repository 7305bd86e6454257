"""Frame operators on unbounded input: event-time windows, and keyed state for trackers and filters.

Late rows are dropped behind the watermark; state of keys that fall silent can time out, so that it stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_stats(stream: DataFrame, t: str, keys: Sequence[str], v: str, window: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, sum, mean and extremes of ``v`` per key and tumbling or sliding window."""
    w = F.window(t, window, slide) if slide else F.window(t, window)
    g = stream.withWatermark(t, late).groupBy(w.alias("w"), *keys)
    out = g.agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "mean", "low", "high")


def sessions(stream: DataFrame, t: str, keys: Sequence[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """(start, end, keys..., n) of runs without a pause of ``gap``."""
    out = stream.withWatermark(t, late).groupBy(F.session_window(t, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def distinct_within(stream: DataFrame, t: str, ids: Sequence[str], late: str) -> DataFrame:
    """The first row of each id within the watermark's horizon."""
    return stream.withWatermark(t, late).dropDuplicatesWithinWatermark(list(ids))


def keyed_fold(stream: DataFrame, key: str, order: str, step, state_schema: str, out: str, kind: str, idle_ms: int | None = None) -> DataFrame:
    """(key, order, out) with ``step(state tuple or None, row dict) -> (state tuple, value)`` over each key's rows.

    Rows of a micro-batch are taken in order; the state persists between batches and, if ``idle_ms`` is set, goes
    that long after a key's last row.
    """
    schema = stream.schema
    key_type, order_type = schema[key].dataType.simpleString(), schema[order].dataType.simpleString()

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        s, values = (state.get if state.exists else None), []
        for row in rows.to_dict("records"):
            s, value = step(s, row)
            values.append(value)
        state.update(s)
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), out: values})

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {key_type}, {order} {order_type}, {out} {kind}", state_schema, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def ema(stream: DataFrame, key: str, order: str, v: str, alpha: float) -> DataFrame:
    def step(s, row):
        m = row[v] if s is None else s[0] + alpha * (row[v] - s[0])
        return (float(m),), float(m)

    return keyed_fold(stream, key, order, step, "m double", "ema", "double")


def kalman_1d(stream: DataFrame, key: str, order: str, v: str, q: float, r: float) -> DataFrame:
    def step(s, row):
        if s is None:
            return (float(row[v]), 1.0), float(row[v])
        x, p = s
        p += q
        k = p / (p + r)
        x += k * (row[v] - x)
        return (float(x), float((1 - k) * p)), float(x)

    return keyed_fold(stream, key, order, step, "x double, p double", "filtered", "double")


def running_background(stream: DataFrame, key: str, order: str, v: str, rate: float, threshold: float) -> DataFrame:
    def step(s, row):
        if s is None:
            return (float(row[v]),), 0
        return (float(s[0] + rate * (row[v] - s[0])),), 255 if abs(row[v] - s[0]) > threshold else 0

    return keyed_fold(stream, key, order, step, "m double", "foreground", "int")


def run_to_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a query on what its source holds now and return the rows: for tests and bounded replays only."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)

"""Filters of detected things: rows with a score, a place, a size or two ends. Nothing here shuffles but
:func:`retain_best`, whose tasks first drop what cannot be among the best of their own rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(df: DataFrame, measure: Column, least: float | None = None, most: float | None = None) -> DataFrame:
    """Rows whose area, score, response, octave or distance lies in [least, most]; a missing end does not bind, a null
    measure never passes."""
    keep = measure.isNotNull()
    if least is not None:
        keep = keep & (measure >= least)
    if most is not None:
        keep = keep & (measure <= most)
    return df.where(keep)


def off_border(df: DataFrame, rows: int, cols: int, border: int, y: str = "y", x: str = "x") -> DataFrame:
    """Rows at least ``border`` pixels inside an image."""
    return df.where(F.col(y).between(border, rows - border - 1) & F.col(x).between(border, cols - border - 1))


def length(x1: str, y1: str, x2: str, y2: str) -> Column:
    return F.hypot(F.col(x2) - F.col(x1), F.col(y2) - F.col(y1))


def retain_best(df: DataFrame, keys: Sequence[str], score: str, count: int, ties: Sequence[str]) -> DataFrame:
    """The ``count`` rows of highest score a group; equal scores in the order of ``ties``, null scores last."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), *ties)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= count).drop("_place")

"""Distances between vectors held as arrays of DOUBLE, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def l1(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: F.abs(x - y))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def chebyshev(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: F.greatest(s, x))


def minkowski(a: Column, b: Column, p: float) -> Column:
    return F.pow(_sum(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p))), F.lit(1 / p))


def chi_square(a: Column, b: Column) -> Column:
    """Sum of (x - y)^2 / (x + y); terms without mass are 0."""
    return _sum(a, b, lambda x, y: F.when(x + y == 0, 0.0).otherwise((x - y) * (x - y) / F.nullif(x + y, F.lit(0.0))))


def hellinger(a: Column, b: Column) -> Column:
    """Negative coordinates count as 0."""
    root = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))
    return F.sqrt(_sum(a, b, lambda x, y: (root(x) - root(y)) * (root(x) - root(y)))) / 1.4142135623730951


def cosine(a: Column, b: Column) -> Column:
    """1 - similarity, within [0, 2]; 1 if either vector is zero."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b) / F.nullif(norm, F.lit(0.0)))))


def hamming(a: Column, b: Column) -> Column:
    """Of 64-bit codes."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_share(a: Column, b: Column) -> Column:
    """Of 64-bit codes, the share of bits that differ."""
    return hamming(a, b) / 64.0


def code_to_hex(code: Column) -> Column:
    """A 64-bit code as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(code)), 16, "0")


def hex_to_code(text: Column) -> Column:
    """The 64-bit code that up to 16 hexadecimal digits stand for; null for other text."""
    halves = [F.conv(F.substring(F.lpad(text, 16, "0"), at, 8), 16, 10).cast("bigint") for at in (1, 9)]
    return F.when(text.rlike("^[0-9A-Fa-f]{1,16}$"), F.shiftleft(halves[0], 32).bitwiseOR(halves[1]))

"""Check digits as column expressions over digit strings, and text codecs of linear symbologies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(s: Column) -> Column:
    return F.transform(F.split(s, ""), lambda c: c.cast("int"))


def weighted_sum(s: Column, even: int, odd: int) -> Column:
    """Digits from the right, the rightmost with weight ``odd``."""
    return F.aggregate(F.transform(F.reverse(digits(s)), lambda v, i: v * F.when(i % 2 == 0, odd).otherwise(even)), F.lit(0), lambda a, x: a + x)


def gs1_check_digit(s: Column) -> Column:
    """Weights 3 and 1 from the right: EAN-8, EAN-13, UPC-A, ITF-14, SSCC."""
    return ((10 - weighted_sum(s, 1, 3) % 10) % 10).cast("int")


def luhn_check_digit(s: Column) -> Column:
    doubled = F.transform(F.reverse(digits(s)), lambda v, i: F.when(i % 2 == 0, F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)).otherwise(v))
    return ((10 - F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("int")


def valid_gs1(s: Column) -> Column:
    """Whether the last digit is the check digit of those before it."""
    return gs1_check_digit(F.substring(s, F.lit(1), F.length(s) - 1)) == F.substring(s, -1, 1).cast("int")


def isbn10_check(s: Column) -> Column:
    """The check character of nine digits, X for ten."""
    total = F.aggregate(F.transform(digits(s), lambda v, i: v * (10 - i)), F.lit(0), lambda a, x: a + x)
    c = (11 - total % 11) % 11
    return F.when(c == 10, "X").otherwise(c.cast("string"))


def mod97(s: Column) -> Column:
    """Remainder of a digit string by 97."""
    return F.aggregate(digits(s), F.lit(0), lambda a, v: (a * 10 + v) % 97)

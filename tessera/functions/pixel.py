"""Point-wise pixel expressions on 8-bit values held as INT, and their lifting to packed images.

A packed image is an array column, row-major and channel-interleaved. ``each`` and ``both`` lift a scalar expression
to one or two packed images; no pixel leaves its row, so nothing is shuffled. Results are rounded half up after
clamping to [0, 255], as ``floor(v + 0.5)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | int | float


def _c(v: Num) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def saturate(v: Num) -> Column:
    """Truncate after clamping to [0, 255]."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), _c(v).cast("double")))).cast("int")


def u8(v: Num) -> Column:
    """Clamp to [0, 255] and round half up."""
    return saturate(_c(v) + 0.5)


def each(img: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(img, f)


def both(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, f)


def add(a: Num, b: Num) -> Column:
    return F.least(F.lit(255), _c(a) + _c(b))


def subtract(a: Num, b: Num) -> Column:
    return F.greatest(F.lit(0), _c(a) - _c(b))


def absdiff(a: Num, b: Num) -> Column:
    return F.abs(_c(a) - _c(b))


def add_weighted(a: Num, alpha: float, b: Num, beta: float, gamma: float) -> Column:
    return u8(_c(a) * alpha + _c(b) * beta + gamma)


def multiply(a: Num, b: Num, scale: float = 1.0) -> Column:
    return u8(_c(a).cast("double") * _c(b) * scale)


def divide(a: Num, b: Num, scale: float = 1.0) -> Column:
    """Division by 0 gives 0."""
    return F.when(_c(b) == 0, 0).otherwise(u8(_c(a).cast("double") * scale / F.nullif(_c(b), F.lit(0))))


def bit_and(a: Num, b: Num) -> Column:
    return _c(a).bitwiseAND(_c(b))


def bit_or(a: Num, b: Num) -> Column:
    return _c(a).bitwiseOR(_c(b))


def bit_xor(a: Num, b: Num) -> Column:
    return _c(a).bitwiseXOR(_c(b))


def bit_not(a: Num) -> Column:
    return 255 - _c(a)


def convert_scale_abs(a: Num, alpha: float, beta: float) -> Column:
    """The absolute value is taken before clamping."""
    return u8(F.abs(_c(a) * alpha + beta))


def gamma(a: Num, g: float) -> Column:
    return u8(F.pow(_c(a) / 255.0, F.lit(g)) * 255.0)


def log_scale(a: Num) -> Column:
    return u8(F.log(1.0 + _c(a)) * (255.0 / 5.545177444479562))  # 255 / ln 256


def bit_plane(a: Num, k: int) -> Column:
    return F.when(F.shiftright(_c(a), k).bitwiseAND(F.lit(1)) == 1, 255).otherwise(0)


def posterize(a: Num, levels: int) -> Column:
    step = 256 // levels
    return F.least(F.lit(255), F.floor(_c(a) / step).cast("int") * step + step // 2)


def threshold(a: Num, t: float, top: int, mode: str) -> Column:
    """Modes binary, binary_inv, trunc, tozero, tozero_inv; the test is strictly greater."""
    v, over = _c(a), _c(a) > t
    return {
        "binary": lambda: F.when(over, top).otherwise(0),
        "binary_inv": lambda: F.when(over, 0).otherwise(top),
        "trunc": lambda: F.when(over, saturate(F.lit(t))).otherwise(v),
        "tozero": lambda: F.when(over, v).otherwise(0),
        "tozero_inv": lambda: F.when(over, 0).otherwise(v),
    }[mode]()


def in_range(a: Num, low: float, high: float) -> Column:
    return F.when(_c(a).between(low, high), 255).otherwise(0)


def compare(a: Num, b: Num, op: str) -> Column:
    x, y = _c(a), _c(b)
    test = {"gt": x > y, "ge": x >= y, "lt": x < y, "le": x <= y, "eq": x == y, "ne": x != y}[op]
    return F.when(test, 255).otherwise(0)


def lut(a: Num, table: Column) -> Column:
    """``table`` is an array of 256 values."""
    return F.get(table, _c(a).cast("int"))


def normalize(img: Column, low: float, high: float) -> Column:
    """Stretch a packed image to [low, high]; a constant image becomes ``low``."""
    # the image and its ends go into a struct that a lambda binds once, so that no pixel works them out again
    bound = F.array(F.struct(img.alias("i"), F.array_min(img).alias("least"), F.array_max(img).alias("most")))

    def stretched(s: Column) -> Column:
        span = s["most"] - s["least"]
        return F.transform(s["i"], lambda v: F.when(span == 0, u8(F.lit(low))).otherwise(u8((v - s["least"]) * ((high - low) / F.nullif(span, F.lit(0))) + low)))

    return F.get(F.transform(bound, stretched), F.lit(0))


def safe_log(a: Num) -> Column:
    """Natural logarithm with -Infinity at 0 and NaN below."""
    v = _c(a).cast("double")
    return F.when(v > 0, F.log(v)).when(v == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


def power(a: Num, p: float) -> Column:
    """Fractional powers use the magnitude of the base."""
    v = _c(a).cast("double")
    return F.pow(v if float(p).is_integer() else F.abs(v), F.lit(float(p)))


def phase(x: Num, y: Num) -> Column:
    """Angle in [0, 2 pi)."""
    a = F.atan2(_c(y).cast("double"), _c(x).cast("double"))
    return F.when(a < 0, a + 6.283185307179586).otherwise(a)


def from_unit(img: Column, low: float, high: float) -> Column:
    """Quantise a packed array of numbers in [low, high] to 8 bits."""
    return F.transform(img, lambda e: u8((e.cast("double") - low) / (high - low) * 255))


def polar_to_cart(magnitude: Num, degrees: Num) -> tuple[Column, Column]:
    """(x, y) of a length and an angle, elementwise on numbers."""
    return _c(magnitude) * F.cos(F.radians(_c(degrees))), _c(magnitude) * F.sin(F.radians(_c(degrees)))


def extract_channel(img: Column, channels: int, k: int) -> Column:
    """Channel ``k`` of an interleaved packed image."""
    return F.filter(img, lambda _, i: i % channels == k)


def insert_channel(img: Column, channels: int, k: int, plane: Column) -> Column:
    """``img`` with channel ``k`` replaced by ``plane``, which should be a plain column: it is looked up per pixel."""
    return F.transform(img, lambda v, i: F.when(i % channels == k, F.get(plane, F.floor(i / channels).cast("int"))).otherwise(v))


def mix_channels(sources: list[tuple[Column, int]], routes: list[tuple[int, int]]) -> Column:
    """An interleaved image whose channels are those of ``routes``: (number of the source, its channel). Sources are
    plain columns with their number of channels and have as many pixels as the first."""
    first, channels = sources[0]
    pixel = lambda i: F.array(*(F.get(sources[s][0], (i * sources[s][1] + k).cast("int")) for s, k in routes))
    places = F.when(F.size(first) >= channels, F.sequence(F.lit(0), F.floor(F.size(first) / channels).cast("int") - 1)).when(first.isNotNull(), F.array().cast("array<int>"))
    return F.flatten(F.transform(places, pixel))


def lut_channels(img: Column, tables: list[Column]) -> Column:
    """Each channel of an interleaved image through a table of 256 values of its own."""
    n = len(tables)

    def value(v: Column, i: Column) -> Column:
        out = F.get(tables[0], v)
        for k in range(1, n):
            out = F.when(i % n == k, F.get(tables[k], v)).otherwise(out)
        return out

    return F.transform(img, value)

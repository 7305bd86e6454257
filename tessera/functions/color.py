"""Colour conversions as column expressions over 8-bit channels, and colour differences over CIE Lab triples.

Formulas and constants are those of the published colour spaces (BT.601, BT.709, sRGB to XYZ with D65, CIE).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.pixel import u8


def gray601(r: Column, g: Column, b: Column) -> Column:
    return u8(r * 0.299 + g * 0.587 + b * 0.114)


def gray709(r: Column, g: Column, b: Column) -> Column:
    return u8(r * 0.2126 + g * 0.7152 + b * 0.0722)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in half degrees, saturation and value in 0..255."""
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    d = v - low
    safe = F.nullif(d, F.lit(0)).cast("double")
    deg = F.when(d == 0, 0.0).when(v == r, 60.0 * (g - b) / safe).when(v == g, 120.0 + 60.0 * (b - r) / safe).otherwise(240.0 + 60.0 * (r - g) / safe)
    deg = F.when(deg < 0, deg + 360.0).otherwise(deg)
    return F.floor(deg / 2 + 0.5).cast("int"), F.when(v == 0, 0).otherwise(u8(d * 255.0 / F.nullif(v, F.lit(0)))), v


def hls(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in half degrees, lightness and saturation in 0..255."""
    hi, lo = F.greatest(r, g, b) / 255.0, F.least(r, g, b) / 255.0
    light, d = (hi + lo) / 2, hi - lo
    s = F.when(d == 0, 0.0).when(light < 0.5, d / F.nullif(hi + lo, F.lit(0.0))).otherwise(d / F.nullif(2 - hi - lo, F.lit(0.0)))
    return hsv(r, g, b)[0], u8(light * 255), u8(s * 255)


def ycrcb(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    y = r * 0.299 + g * 0.587 + b * 0.114
    return u8(y), u8((r - y) * 0.713 + 128), u8((b - y) * 0.564 + 128)


def yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    y = r * 0.299 + g * 0.587 + b * 0.114
    return u8(y), u8((b - y) * 0.492 + 128), u8((r - y) * 0.877 + 128)


def cmyk(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    k = 1 - F.greatest(r, g, b) / 255.0
    part = lambda c: F.when(k >= 1, 0).otherwise(u8((1 - c / 255.0 - k) / F.nullif(1 - k, F.lit(0.0)) * 255))
    return part(r), part(g), part(b), u8(k * 255)


# Linear sRGB to CIE XYZ, D65, and its white point.
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)


def xyz(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    """Linear combination in 0..255, rounded."""
    return tuple(u8(r * m[0] + g * m[1] + b * m[2]) for m in XYZ)


def srgb_linear(c: Column) -> Column:
    u = c / 255.0
    return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))


def lab(r: Column, g: Column, b: Column, linear: bool = False) -> tuple[Column, Column, Column]:
    """CIE L*, a*, b* as numbers; ``linear`` undoes the sRGB curve first."""
    rgb = [srgb_linear(c) if linear else c / 255.0 for c in (r, g, b)]

    def f(m, w):
        t = (rgb[0] * m[0] + rgb[1] * m[1] + rgb[2] * m[2]) / w
        return F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)

    fx, fy, fz = (f(m, w) for m, w in zip(XYZ, WHITE, strict=True))
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


# CIE XYZ, D65, to linear sRGB.
RGB_OF_XYZ = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875992, 0.041556), (0.055648, -0.204043, 1.057311))


def _wrap(x: Column, period: float) -> Column:
    return x - F.floor(x / period) * period


def rgb_of_hsv(h: Column, s: Column, v: Column) -> tuple[Column, ...]:
    """Channels as :func:`hsv` gives them. A channel falls short of the value by saturation times how far the hue is away."""
    value, chroma = v / 255.0, v / 255.0 * (s / 255.0)

    def channel(n: int) -> Column:
        k = _wrap(h / 30.0 + n, 6.0)
        return u8((value - chroma * F.greatest(F.lit(0.0), F.least(k, 4.0 - k, F.lit(1.0)))) * 255)

    return channel(5), channel(3), channel(1)


def rgb_of_hls(h: Column, l: Column, s: Column) -> tuple[Column, ...]:  # noqa: E741
    """Channels as :func:`hls` gives them."""
    light = l / 255.0
    swing = s / 255.0 * F.least(light, 1.0 - light)

    def channel(n: int) -> Column:
        k = _wrap(h / 15.0 + n, 12.0)
        return u8((light - swing * F.greatest(F.lit(-1.0), F.least(k - 3.0, 9.0 - k, F.lit(1.0)))) * 255)

    return channel(0), channel(8), channel(4)


def rgb_of_ycrcb(y: Column, cr: Column, cb: Column) -> tuple[Column, ...]:
    return u8(y + (cr - 128) * 1.403), u8(y - (cr - 128) * 0.714 - (cb - 128) * 0.344), u8(y + (cb - 128) * 1.773)


def rgb_of_yuv(y: Column, u: Column, v: Column) -> tuple[Column, ...]:
    return u8(y + (v - 128) * 1.13983), u8(y - (u - 128) * 0.39465 - (v - 128) * 0.58060), u8(y + (u - 128) * 2.03211)


def rgb_of_xyz(x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    return tuple(u8(x * m[0] + y * m[1] + z * m[2]) for m in RGB_OF_XYZ)


def rgb_of_lab(l: Column, a: Column, b: Column) -> tuple[Column, ...]:  # noqa: E741
    """From 8-bit channels: L* in 255ths of 100, a* and b* from -128."""
    fy = (l * 100.0 / 255 + 16) / 116

    def back(t: Column) -> Column:
        return F.when(t * t * t > 0.008856, t * t * t).otherwise((t - 16 / 116) / 7.787)

    xyz_ = [back(t) * w for t, w in zip((fy + (a - 128) / 500.0, fy, fy - (b - 128) / 200.0), WHITE, strict=True)]
    return tuple(u8((xyz_[0] * m[0] + xyz_[1] * m[1] + xyz_[2] * m[2]) * 255) for m in RGB_OF_XYZ)


def rgb_of_cmyk(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, ...]:
    return tuple(u8((1 - p / 255.0) * (1 - k / 255.0) * 255) for p in (c, m, y))


def sepia(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return u8(r * 0.393 + g * 0.769 + b * 0.189), u8(r * 0.349 + g * 0.686 + b * 0.168), u8(r * 0.272 + g * 0.534 + b * 0.131)


def transform(channels: list[Column], matrix: list[list[float]], bias: list[float] | None = None) -> list[Column]:
    """A matrix over the channels of a pixel, with an optional bias."""
    out = []
    for i, line in enumerate(matrix):
        total = F.lit(0.0 if bias is None else bias[i])
        for c, w in zip(channels, line, strict=True):
            total = total + c * w
        out.append(u8(total))
    return out


Lab = tuple[Column, Column, Column]


def delta_e76(p: Lab, q: Lab) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(p, q, strict=True)), F.lit(0.0)))


def delta_e94(p: Lab, q: Lab, k1: float = 0.045, k2: float = 0.015) -> Column:
    c1, c2 = (F.sqrt(x[1] * x[1] + x[2] * x[2]) for x in (p, q))
    dl, dc = p[0] - q[0], c1 - c2
    dh2 = F.greatest(F.lit(0.0), (p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2]) - dc * dc)
    sc, sh = 1 + k1 * c1, 1 + k2 * c1
    return F.sqrt(dl * dl + (dc / sc) * (dc / sc) + dh2 / (sh * sh))


def _let(values: dict[str, Column], body) -> Column:
    """``body`` over named values that are computed once each, however often it uses them."""
    bound = F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), lambda x: body({k: x[k] for k in values}))
    return F.get(bound, F.lit(0))


def delta_e2000(p: Lab, q: Lab) -> Column:
    """CIEDE2000 with all weights 1."""
    given = dict(zip(("l1", "a1", "b1", "l2", "a2", "b2"), (*p, *q), strict=True))

    def chroma(v):
        m7 = F.pow((F.sqrt(v["a1"] * v["a1"] + v["b1"] * v["b1"]) + F.sqrt(v["a2"] * v["a2"] + v["b2"] * v["b2"])) / 2, F.lit(7.0))
        return _let(v | {"g": 1.5 - 0.5 * F.sqrt(m7 / (m7 + 25.0**7))}, polar)

    def polar(v):
        x1, x2 = v["a1"] * v["g"], v["a2"] * v["g"]
        hue = lambda b, a: F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))
        names = {"l1": v["l1"], "l2": v["l2"], "c1": F.sqrt(x1 * x1 + v["b1"] * v["b1"]), "c2": F.sqrt(x2 * x2 + v["b2"] * v["b2"]), "h1": hue(v["b1"], x1), "h2": hue(v["b2"], x2)}
        return _let(names, means)

    def means(v):
        gray, turn, total = v["c1"] * v["c2"] == 0, v["h2"] - v["h1"], v["h1"] + v["h2"]
        dh = F.when(gray, 0.0).when(F.abs(turn) <= 180, turn).when(turn > 180, turn - 360).otherwise(turn + 360)
        mh = F.when(gray, total).when(F.abs(turn) <= 180, total / 2).when(total < 360, total / 2 + 180).otherwise(total / 2 - 180)
        return _let({"l1": v["l1"], "l2": v["l2"], "c1": v["c1"], "c2": v["c2"], "dh": dh, "mh": mh, "ml": (v["l1"] + v["l2"]) / 2, "mc": (v["c1"] + v["c2"]) / 2}, difference)

    def difference(v):
        cos = lambda k, off: F.cos(F.radians(k * v["mh"] + off))
        t = 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.20 * cos(4, -63)
        off, mc7, l2 = (v["mh"] - 275) / 25, F.pow(v["mc"], F.lit(7.0)), (v["ml"] - 50) * (v["ml"] - 50)
        names = {
            "x": (v["l2"] - v["l1"]) / (1 + 0.015 * l2 / F.sqrt(20 + l2)),
            "y": (v["c2"] - v["c1"]) / (1 + 0.045 * v["mc"]),
            "z": 2 * F.sqrt(v["c1"] * v["c2"]) * F.sin(F.radians(v["dh"] / 2)) / (1 + 0.015 * v["mc"] * t),
            "turn": F.sin(F.radians(60 * F.exp(-off * off))) * 2 * F.sqrt(mc7 / (mc7 + 25.0**7)),
        }
        return _let(names, lambda w: F.sqrt(w["x"] * w["x"] + w["y"] * w["y"] + w["z"] * w["z"] - w["turn"] * w["y"] * w["z"]))

    return _let(given, chroma)

"""Neighbourhood, morphological, geometric and cumulative operators on stacks of one-channel images.

An image is one row of a table: an array column, row-major, with columns ``rows`` and ``cols`` (or a fixed shape for
the whole table). :func:`map_images` runs a kernel over all images of an Arrow batch at once: images of like shape are
stacked into one (n, rows, cols) numpy array, so a kernel is a few vectorised passes and no Python loop over pixels.
Nothing is shuffled, and memory is bounded by the batch.

The kernels below take and return such stacks. Borders are resolved by index arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Kernel = Sequence[Sequence[float]]


def map_images(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], img: str = "img", keep: Sequence[str] = ("img_id",), shape: tuple[int, int] | None = None, kind: str = "int") -> DataFrame:
    """``keep`` columns, ``img``, ``rows`` and ``cols`` of the kernel's output for each image.

    Without ``shape`` the columns ``rows`` and ``cols`` give each image's own. Null images stay null. ``kind`` is the
    element type: int, bigint or double.
    """
    dtype, at = {"int": (np.int32, pa.int32()), "bigint": (np.int64, pa.int64()), "double": (np.float64, pa.float64())}[kind]
    src = df.select(*keep, F.col(img).alias("_img"), *((F.lit(shape[0]).alias("_r"), F.lit(shape[1]).alias("_c")) if shape else (F.col("rows").alias("_r"), F.col("cols").alias("_c"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, r, c = batch.column("_img"), batch.column("_r").to_pylist(), batch.column("_c").to_pylist()
            out: list = [None] * batch.num_rows
            rows, cols = [None] * batch.num_rows, [None] * batch.num_rows
            by_shape: dict[tuple[int, int], list[int]] = {}
            for i, ok in enumerate(col.is_valid().to_pylist()):
                if ok:
                    by_shape.setdefault((r[i], c[i]), []).append(i)
            for (h, w), ids in by_shape.items():
                flat = col.take(pa.array(ids)).flatten().to_numpy(zero_copy_only=False)
                done = np.ascontiguousarray(kernel(flat.reshape(len(ids), h, w)), dtype=dtype)
                for i, a in zip(ids, done.reshape(len(ids), -1), strict=True):
                    out[i] = a
                    rows[i], cols[i] = done.shape[1], done.shape[2] if done.ndim > 2 else 1
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(out, pa.list_(at)), pa.array(rows, pa.int32()), pa.array(cols, pa.int32())], [*keep, img, "rows", "cols"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return src.mapInArrow(run, f"{fields}, `{img}` array<{kind}>, rows int, cols int")


def to_pixels(df: DataFrame, img: str = "img", keep: Sequence[str] = ("img_id",)) -> DataFrame:
    """The pixel relation (keep..., y, x, v) of a packed image table with columns ``rows`` and ``cols``."""
    long = df.select(*keep, "cols", F.posexplode(img).alias("_i", "v"))
    return long.select(*keep, F.floor(F.col("_i") / F.col("cols")).cast("int").alias("y"), (F.col("_i") % F.col("cols")).alias("x"), "v")


def u8(v: np.ndarray) -> np.ndarray:
    """Clamp to [0, 255] and round half up."""
    return np.floor(np.clip(np.asarray(v, dtype=np.float64) + 0.5, 0, 255)).astype(np.int32)


def border_index(i: np.ndarray, n: int, mode: str) -> np.ndarray:
    """The index that stands for ``i`` outside [0, n); -1 for the constant border."""
    if mode == "replicate":
        return np.clip(i, 0, n - 1)
    if mode == "wrap":
        return i % n
    if mode == "reflect":
        m = i % (2 * n)
        return np.where(m < n, m, 2 * n - 1 - m)
    if mode == "reflect101":
        m = i % max(1, 2 * (n - 1))
        return np.where(m < n, m, 2 * (n - 1) - m)
    if mode == "constant":
        return np.where((i >= 0) & (i < n), i, -1)
    raise ValueError(f"unknown border mode {mode}")


def copy_border(a: np.ndarray, top: int, bottom: int, left: int, right: int, mode: str = "replicate", fill: float = 0) -> np.ndarray:
    y = border_index(np.arange(-top, a.shape[1] + bottom), a.shape[1], mode)
    x = border_index(np.arange(-left, a.shape[2] + right), a.shape[2], mode)
    out = a[:, y[:, None], x[None, :]]
    return np.where((y[:, None] < 0) | (x[None, :] < 0), fill, out) if mode == "constant" else out


def shifted(a: np.ndarray, offsets: Sequence[tuple[int, int]], mode: str = "replicate") -> Iterator[np.ndarray]:
    """The image as each (dy, dx) neighbour sees it."""
    ry, rx = max(abs(dy) for dy, _ in offsets), max(abs(dx) for _, dx in offsets)
    p = copy_border(a, ry, ry, rx, rx, mode)
    for dy, dx in offsets:
        yield p[:, ry + dy : ry + dy + a.shape[1], rx + dx : rx + dx + a.shape[2]]


def correlate(a: np.ndarray, kernel: Kernel, mode: str = "replicate") -> np.ndarray:
    """Sum of neighbours times weights; the kernel is not flipped."""
    k = np.asarray(kernel, dtype=np.float64)
    ry, rx = k.shape[0] // 2, k.shape[1] // 2
    taps = [(y - ry, x - rx) for y, x in np.argwhere(k)]
    total = np.zeros(a.shape)
    for (dy, dx), v in zip(taps, shifted(a, taps, mode), strict=True):
        total += v * k[dy + ry, dx + rx]
    return total


def filter2d(a: np.ndarray, kernel: Kernel, mode: str = "replicate") -> np.ndarray:
    return u8(correlate(a, kernel, mode))


def box_sum(a: np.ndarray, size: int) -> np.ndarray:
    """Sums over size x size neighbourhoods, edges repeated, from an integral image: the cost does not depend on size."""
    r = size // 2
    s = integral(copy_border(np.asarray(a, dtype=np.float64), r, r, r, r))
    return s[:, size:, size:] - s[:, :-size, size:] - s[:, size:, :-size] + s[:, :-size, :-size]


def box_blur(a: np.ndarray, size: int) -> np.ndarray:
    return u8(box_sum(a, size) / (size * size))


GAUSS3, GAUSS5 = (1, 2, 1), (1, 4, 6, 4, 1)


def separable(a: np.ndarray, line: Sequence[float], mode: str = "replicate") -> np.ndarray:
    return correlate(correlate(a, [line], mode), [[w] for w in line], mode)


def binomial_blur(a: np.ndarray, line: Sequence[int] = GAUSS5, mode: str = "replicate") -> np.ndarray:
    """Gaussian-like blur: integer sums, one division."""
    return u8(separable(a, line, mode) / sum(line) ** 2)


def gaussian_line(size: int, sigma: float) -> np.ndarray:
    if sigma <= 0:
        sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    w = np.exp(-(x * x) / (2 * sigma * sigma))
    return w / w.sum()


def gaussian_blur(a: np.ndarray, size: int, sigma: float) -> np.ndarray:
    return u8(separable(a, gaussian_line(size, sigma)))


SOBEL_X = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))
SCHARR_X = ((-3, 0, 3), (-10, 0, 10), (-3, 0, 3))
PREWITT_X = ((-1, 0, 1), (-1, 0, 1), (-1, 0, 1))
LAPLACE_4 = ((0, 1, 0), (1, -4, 1), (0, 1, 0))
SHARPEN = ((0, -1, 0), (-1, 5, -1), (0, -1, 0))


def transposed(kernel: Kernel) -> list[list[float]]:
    return [list(c) for c in zip(*kernel, strict=True)]


def gradients(a: np.ndarray, kernel: Kernel = SOBEL_X) -> tuple[np.ndarray, np.ndarray]:
    return correlate(a, kernel), correlate(a, transposed(kernel))


def gradient_magnitude(a: np.ndarray, kernel: Kernel = SOBEL_X) -> np.ndarray:
    gx, gy = gradients(a, kernel)
    return u8(np.sqrt(gx * gx + gy * gy))


def square(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def cross(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return sorted({(d, 0) for d in range(-r, r + 1)} | {(0, d) for d in range(-r, r + 1)})


def disk(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(dy, dx) for dy, dx in square(size) if dy * dy + dx * dx <= r * r]


def rank_filter(a: np.ndarray, offsets: Sequence[tuple[int, int]], rank: int) -> np.ndarray:
    return np.partition(np.stack(list(shifted(a, offsets))), rank, axis=0)[rank]


def median_blur(a: np.ndarray, size: int) -> np.ndarray:
    return rank_filter(a, square(size), size * size // 2)


def alpha_trimmed_mean(a: np.ndarray, size: int, trim: int) -> np.ndarray:
    s = np.sort(np.stack(list(shifted(a, square(size)))), axis=0)
    return u8(s[trim : len(s) - trim].mean(axis=0))


def erode(a: np.ndarray, offsets: Sequence[tuple[int, int]] | None = None) -> np.ndarray:
    out = None
    for v in shifted(a, offsets or square(3)):
        out = v.copy() if out is None else np.minimum(out, v, out=out)
    return out


def dilate(a: np.ndarray, offsets: Sequence[tuple[int, int]] | None = None) -> np.ndarray:
    out = None
    for v in shifted(a, offsets or square(3)):
        out = v.copy() if out is None else np.maximum(out, v, out=out)
    return out


def opening(a: np.ndarray, offsets=None) -> np.ndarray:
    return dilate(erode(a, offsets), offsets)


def closing(a: np.ndarray, offsets=None) -> np.ndarray:
    return erode(dilate(a, offsets), offsets)


def morph_gradient(a: np.ndarray, offsets=None) -> np.ndarray:
    return dilate(a, offsets) - erode(a, offsets)


def tophat(a: np.ndarray, offsets=None) -> np.ndarray:
    return a - opening(a, offsets)


def blackhat(a: np.ndarray, offsets=None) -> np.ndarray:
    return closing(a, offsets) - a


def reconstruct(marker: np.ndarray, mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Morphological reconstruction by dilation: grow ``marker`` under ``mask`` until nothing changes."""
    cur = np.minimum(marker, mask)
    while True:
        nxt = np.minimum(dilate(cur, square(3) if connectivity == 8 else cross(3)), mask)
        if (nxt == cur).all():
            return cur
        cur = nxt


def fill_holes(a: np.ndarray) -> np.ndarray:
    """Raise dark regions that the border does not reach."""
    top = a.max(initial=0)
    seed = np.full_like(a, top)
    seed[:, 0], seed[:, -1], seed[:, :, 0], seed[:, :, -1] = a[:, 0], a[:, -1], a[:, :, 0], a[:, :, -1]
    return top - reconstruct(top - seed, top - a, 4)


def hit_or_miss(a: np.ndarray, kernel: Kernel) -> np.ndarray:
    """255 where all 1s of the kernel lie on foreground and all -1s on background."""
    k = np.asarray(kernel)
    on = np.ones(a.shape, dtype=bool)
    for y, x in np.argwhere(k):
        d = (y - k.shape[0] // 2, x - k.shape[1] // 2)
        v = next(shifted(a, [d, (-d[0], -d[1])]))
        on &= (v > 0) if k[y, x] > 0 else (v == 0)
    return np.where(on, 255, 0)


def adaptive_threshold(a: np.ndarray, size: int, c: float, top: int = 255) -> np.ndarray:
    return np.where(a > box_sum(a, size) / (size * size) - c, top, 0)


def local_mean_std(a: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = float(size * size)
    v = np.asarray(a, dtype=np.float64)
    mean = box_sum(v, size) / n
    return mean, np.sqrt(np.maximum(0, box_sum(v * v, size) / n - mean * mean))


def sauvola(a: np.ndarray, size: int, k: float, r: float = 128.0) -> np.ndarray:
    mean, std = local_mean_std(a, size)
    return np.where(a > mean * (1 + k * (std / r - 1)), 255, 0)


def niblack(a: np.ndarray, size: int, k: float) -> np.ndarray:
    mean, std = local_mean_std(a, size)
    return np.where(a > mean + k * std, 255, 0)


def bernsen(a: np.ndarray, size: int, contrast: int, otherwise: int = 128) -> np.ndarray:
    """Against the middle of the local range; where the range is below ``contrast``, against ``otherwise``."""
    hi, lo = dilate(a, square(size)), erode(a, square(size))
    mid = (hi.astype(np.int64) + lo) / 2
    return np.where(hi - lo < contrast, np.where(mid >= otherwise, 255, 0), np.where(a >= mid, 255, 0))


def window_stats(a: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sum and sum of squares over the part of each size x size window that lies in the image."""
    r, v = size // 2, np.asarray(a, dtype=np.float64)

    def total(z: np.ndarray) -> np.ndarray:
        s = integral(copy_border(z, r, r, r, r, "constant"))
        return s[:, size:, size:] - s[:, :-size, size:] - s[:, size:, :-size] + s[:, :-size, :-size]

    return total(np.ones_like(v)), total(v), total(v * v)


def wolf(a: np.ndarray, size: int, k: float) -> np.ndarray:
    """Against mean - k (1 - std / greatest std) (mean - least value of the image)."""
    n, s, q = window_stats(a, size)
    mean = s / n
    std = np.sqrt(np.maximum(0, q / n - mean * mean))
    most = std.max(axis=(1, 2), keepdims=True)
    low = a.min(axis=(1, 2), keepdims=True)
    return np.where(a > mean - k * (1 - std / np.where(most == 0, 1, most)) * (mean - low), 255, 0)


def nick(a: np.ndarray, size: int, k: float) -> np.ndarray:
    """Against mean + k sqrt((sum of squares - mean^2) / count)."""
    n, s, q = window_stats(a, size)
    mean = s / n
    return np.where(a > mean + k * np.sqrt(np.maximum(0, (q - mean * mean) / n)), 255, 0)


def phansalkar(a: np.ndarray, size: int, k: float = 0.25, r: float = 0.5) -> np.ndarray:
    """Against mean (1 + 2 exp(-10 mean) + k (std / r - 1)), values taken from 0 to 1."""
    n, s, q = window_stats(a, size)
    mean = s / n / 255
    std = np.sqrt(np.maximum(0, q / n / 65025 - mean * mean))
    return np.where(a > 255 * mean * (1 + 2 * np.exp(-10 * mean) + k * (std / r - 1)), 255, 0)


def integral(a: np.ndarray) -> np.ndarray:
    """(rows + 1) x (cols + 1) sums of all pixels above and to the left."""
    out = np.zeros((a.shape[0], a.shape[1] + 1, a.shape[2] + 1), dtype=np.float64 if a.dtype.kind == "f" else np.int64)
    np.cumsum(np.cumsum(a, axis=1, dtype=out.dtype), axis=2, out=out[:, 1:, 1:])
    return out


def integral_tilted(a: np.ndarray) -> np.ndarray:
    """(rows + 1) x (cols + 1) sums over the upward triangles, turned by 45 degrees: the entry (y, x) adds the pixels
    (q, p) with q < y and |p - x + 1| < y - q."""
    n, h, w = a.shape
    wide = np.zeros((n, h, w + 2 * h + 1), dtype=np.float64 if a.dtype.kind == "f" else np.int64)
    wide[:, :, h + 1 : h + 1 + w] = a
    t = np.zeros((n, h + 1, w + 2 * h + 3), dtype=wide.dtype)
    for y in range(1, h + 1):
        t[:, y, 1:-1] = t[:, y - 1, :-2] + t[:, y - 1, 2:] + wide[:, y - 1]
        if y > 1:
            t[:, y, 1:-1] += wide[:, y - 2] - t[:, y - 2, 1:-1]
    return t[:, :, h + 1 : h + 2 + w]


def repeat(a: np.ndarray, down: int, across: int) -> np.ndarray:
    return np.tile(a, (1, down, across))


def region(a: np.ndarray, y: int, x: int, rows: int, cols: int) -> np.ndarray:
    """The part of a rectangle that lies in the image."""
    return a[:, max(0, y) : max(0, y + rows), max(0, x) : max(0, x + cols)]


def flip(a: np.ndarray, vertical: bool = False, horizontal: bool = False) -> np.ndarray:
    return a[:, :: -1 if vertical else 1, :: -1 if horizontal else 1]


def transpose(a: np.ndarray) -> np.ndarray:
    return a.transpose(0, 2, 1)


def rotate90(a: np.ndarray) -> np.ndarray:
    """A quarter turn clockwise."""
    return a[:, ::-1].transpose(0, 2, 1)


def grid(rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(rows)[:, None] + np.zeros((1, cols), dtype=np.int64), np.arange(cols)[None, :] + np.zeros((rows, 1), dtype=np.int64)


def sample_nearest(a: np.ndarray, fy: np.ndarray, fx: np.ndarray, mode: str = "replicate") -> np.ndarray:
    y = border_index(np.floor(fy).astype(np.int64), a.shape[1], mode)
    x = border_index(np.floor(fx).astype(np.int64), a.shape[2], mode)
    return np.where((y < 0) | (x < 0), 0, a[:, y, x])


def sample_bilinear(a: np.ndarray, fy: np.ndarray, fx: np.ndarray, mode: str = "replicate") -> np.ndarray:
    y0, x0 = np.floor(fy).astype(np.int64), np.floor(fx).astype(np.int64)
    wy, wx = fy - y0, fx - x0
    p = lambda dy, dx: sample_nearest(a, y0 + dy, x0 + dx, mode)
    return (p(0, 0) * (1 - wx) + p(0, 1) * wx) * (1 - wy) + (p(1, 0) * (1 - wx) + p(1, 1) * wx) * wy


def resize_nearest(a: np.ndarray, rows: int, cols: int) -> np.ndarray:
    y, x = grid(rows, cols)
    return sample_nearest(a, (y + 0.5) * (a.shape[1] / rows), (x + 0.5) * (a.shape[2] / cols))


def resize_bilinear(a: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Pixel centres at half coordinates, edges repeated."""
    y, x = grid(rows, cols)
    return u8(sample_bilinear(a, (y + 0.5) * (a.shape[1] / rows) - 0.5, (x + 0.5) * (a.shape[2] / cols) - 0.5))


def resample(a: np.ndarray, rows: int, cols: int, weight: Callable[[np.ndarray], np.ndarray], support: int) -> np.ndarray:
    """Separable resize with an interpolation kernel of the given support, weights normalised, edges repeated."""

    def one(v: np.ndarray, n: int, to: int) -> np.ndarray:
        f = (np.arange(to) + 0.5) * (n / to) - 0.5
        taps = np.floor(f).astype(np.int64)[:, None] + np.arange(1 - support, support + 1)[None, :]
        w = weight(f[:, None] - taps)
        w = w / w.sum(axis=1, keepdims=True)
        return np.einsum("ntkw,tk->ntw", v[:, np.clip(taps, 0, n - 1)], w)

    out = one(one(np.asarray(a, float), a.shape[1], rows).transpose(0, 2, 1), a.shape[2], cols).transpose(0, 2, 1)
    return u8(np.round(out, 9))  # a half is a half, whatever the order of the sum


def cubic_weight(t: np.ndarray, a: float = -0.5) -> np.ndarray:
    t = np.abs(t)
    return np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * (t**3 - 5 * t**2 + 8 * t - 4), 0.0))


def lanczos_weight(t: np.ndarray, lobes: int = 3) -> np.ndarray:
    return np.where(np.abs(t) < lobes, np.sinc(t) * np.sinc(t / lobes), 0.0)


def warp_affine(a: np.ndarray, inverse: Kernel, nearest: bool = True) -> np.ndarray:
    """Each output pixel takes the source at ``inverse`` (2x3) of its (x, y); outside is 0."""
    (p, q, c), (d, e, f) = inverse
    y, x = grid(*a.shape[1:])
    sx, sy = p * x + q * y + c, d * x + e * y + f
    return sample_nearest(a, sy + 0.5, sx + 0.5, "constant") if nearest else u8(sample_bilinear(a, sy, sx, "constant"))


def warp_perspective(a: np.ndarray, inverse: Kernel) -> np.ndarray:
    (p, q, c), (d, e, f), (g, h, i) = inverse
    y, x = grid(*a.shape[1:])
    w = g * x + h * y + i
    return sample_nearest(a, (d * x + e * y + f) / w + 0.5, (p * x + q * y + c) / w + 0.5, "constant")


def remap(a: np.ndarray, fy: np.ndarray, fx: np.ndarray) -> np.ndarray:
    return u8(sample_bilinear(a, fy, fx, "constant"))


def warp_polar(a: np.ndarray, rows: int, cols: int, cy: float, cx: float, radius: float, log: bool = False) -> np.ndarray:
    """Rows are angles, columns radii; with ``log`` radii grow geometrically."""
    ang, r = grid(rows, cols)
    rho = np.exp(r * np.log(radius) / cols) - 1 if log else r * radius / cols
    t = 2 * np.pi * ang / rows
    return u8(np.round(sample_bilinear(a, cy + rho * np.sin(t), cx + rho * np.cos(t), "constant"), 9))


def pyr_down(a: np.ndarray) -> np.ndarray:
    return binomial_blur(a)[:, ::2, ::2]


def pyr_up(a: np.ndarray) -> np.ndarray:
    big = np.zeros((a.shape[0], 2 * a.shape[1], 2 * a.shape[2]))
    big[:, ::2, ::2] = a
    return u8(separable(big, GAUSS5, "reflect101") / 64)


def laplacian_level(a: np.ndarray) -> np.ndarray:
    """What a pyramid step loses: the image less its shrunken and grown version."""
    return a - pyr_up(pyr_down(a))[:, : a.shape[1], : a.shape[2]]


def local_binary_pattern(a: np.ndarray) -> np.ndarray:
    """8 neighbours clockwise from the top left, a bit for each that is not below the centre, first bit highest."""
    ring = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
    return sum((v >= a).astype(np.int32) << (7 - k) for k, v in enumerate(shifted(a, ring)))


def census(a: np.ndarray, size: int = 3) -> np.ndarray:
    """A bit for each neighbour below the centre, raster order, centre left out."""
    ring = [o for o in square(size) if o != (0, 0)]
    out = np.zeros(a.shape, dtype=np.int64)
    for v in shifted(a, ring):
        out = (out << 1) | (v < a)
    return out


def unsharp(a: np.ndarray, amount: float) -> np.ndarray:
    return u8(a + (a - binomial_blur(a)) * amount)

"""Whole-image kernels on stacks of one-channel images, for ``raster.map_images``: edges, components, filters,
frequency, segmentation. Each takes (n, rows, cols) and returns a stack; loops run over steps or pixels of a wave,
vectorised over all images of the stack where the algorithm allows.
"""

from __future__ import annotations

import numpy as np

from tessera.operators import raster as R


def canny(a: np.ndarray, low: float, high: float, size: int = 5, sigma: float = 1.4) -> np.ndarray:
    """Blur, gradient, suppression along the gradient, hysteresis. Swapped thresholds are put in order; the outermost
    pixels are never edges."""
    low, high = min(low, high), max(low, high)
    blurred = R.separable(np.asarray(a, dtype=np.float64), R.gaussian_line(size, sigma))
    gx, gy = R.gradients(blurred)
    mag = np.hypot(gx, gy)
    angle = np.rad2deg(np.arctan2(gy, gx)) % 180
    sector = np.select([(angle < 22.5) | (angle >= 157.5), angle < 67.5, angle < 112.5], [0, 1, 2], 3)
    ring = [(0, 1), (0, -1), (1, 1), (-1, -1), (1, 0), (-1, 0), (1, -1), (-1, 1)]
    near = list(R.shifted(mag, ring))
    first = np.choose(sector, [near[0], near[2], near[4], near[6]])
    second = np.choose(sector, [near[1], near[3], near[5], near[7]])
    thin = np.where((mag >= first) & (mag >= second), mag, 0)
    thin[:, 0], thin[:, -1], thin[:, :, 0], thin[:, :, -1] = 0, 0, 0, 0
    return hysteresis(thin, low, high)


def hysteresis(v: np.ndarray, low: float, high: float) -> np.ndarray:
    """255 where a value of at least ``low`` is 8-connected to one of at least ``high``."""
    weak = (v >= low).astype(np.int32)
    return R.reconstruct((v >= high).astype(np.int32), weak) * 255


def label(a: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Connected components of non-zero pixels: 0 is background, labels run from 1 in raster order of first pixels.
    Minimum labels spread until nothing changes, all images in step."""
    n, h, w = a.shape
    big = h * w
    on = a > 0
    cur = np.where(on, np.arange(big).reshape(1, h, w), big)
    offsets = R.square(3) if connectivity == 8 else R.cross(3)
    while True:
        nxt = np.where(on, R.erode(cur, offsets), big)
        flat = np.concatenate([nxt.reshape(n, -1), np.full((n, 1), big)], axis=1)
        nxt = np.where(on, np.take_along_axis(flat, nxt.reshape(n, -1), axis=1).reshape(n, h, w), big)  # jump to the label's label
        if (nxt == cur).all():
            break
        cur = nxt
    out = np.zeros(a.shape, dtype=np.int32)
    for i in range(n):
        seeds = np.unique(cur[i][on[i]])
        out[i][on[i]] = np.searchsorted(seeds, cur[i][on[i]]) + 1
    return out


def flood_fill(a: np.ndarray, y: int, x: int, value: int, tolerance: int = 0) -> np.ndarray:
    """Replace the 4-connected region around a seed whose values are within ``tolerance`` of the seed's."""
    seed = a[:, y : y + 1, x : x + 1]
    like = (np.abs(a.astype(np.int64) - seed) <= tolerance).astype(np.int32)
    start = np.zeros_like(like)
    start[:, y, x] = 1
    return np.where(R.reconstruct(start, like, 4) > 0, value, a)


def distance_transform(a: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance to the nearest zero pixel, separably: squared distances by rows, then lower envelopes by
    columns. Without a zero pixel all distances are infinite."""
    n, h, w = a.shape
    far = float((h + w) ** 2 * 4)
    x = np.arange(w)
    row = np.where(a[:, :, None, :] == 0, (x[:, None] - x[None, :]) ** 2.0, far).min(axis=3)
    y = np.arange(h)
    d2 = (row[:, None, :, :] + ((y[:, None] - y[None, :]) ** 2.0)[None, :, :, None]).min(axis=2)
    return np.where(d2 >= far, np.inf, np.sqrt(d2))


def bilateral(a: np.ndarray, size: int, sigma_color: float, sigma_space: float) -> np.ndarray:
    total, weight = np.zeros(a.shape), np.zeros(a.shape)
    for (dy, dx), v in zip(R.square(size), R.shifted(a, R.square(size)), strict=True):
        d = v.astype(np.float64) - a
        k = np.exp(-(dy * dy + dx * dx) / (2 * sigma_space**2) - d * d / (2 * sigma_color**2))
        total += k * v
        weight += k
    return R.u8(total / weight)


def non_local_means(a: np.ndarray, search: int, patch: int, strength: float) -> np.ndarray:
    v = np.asarray(a, dtype=np.float64)
    total, weight = np.zeros(a.shape), np.zeros(a.shape)
    for u in R.shifted(v, R.square(search)):
        d = R.box_sum((v - u) ** 2, patch) / (patch * patch)
        k = np.exp(-np.maximum(d, 0) / strength**2)
        total += k * u
        weight += k
    return R.u8(total / weight)


def guided_filter(a: np.ndarray, guide: np.ndarray, size: int, eps: float) -> np.ndarray:
    n = size * size
    p, g = np.asarray(a, dtype=np.float64), np.asarray(guide, dtype=np.float64)
    mean = lambda z: R.box_sum(z, size) / n
    mg, mp = mean(g), mean(p)
    k = (mean(g * p) - mg * mp) / (mean(g * g) - mg * mg + eps)
    return R.u8(mean(k) * g + mean(mp - k * mg))


def anisotropic_diffusion(a: np.ndarray, steps: int, kappa: float, rate: float = 0.2) -> np.ndarray:
    v = np.asarray(a, dtype=np.float64)
    for _ in range(steps):
        v = v + rate * sum(np.exp(-(((u - v) / kappa) ** 2)) * (u - v) for u in R.shifted(v, [(-1, 0), (1, 0), (0, -1), (0, 1)]))
    return R.u8(v)


def corner_response(a: np.ndarray, size: int = 3, k: float = 0.04) -> np.ndarray:
    """Harris: det - k * trace^2 of the summed gradient products."""
    gx, gy = R.gradients(a)
    xx, yy, xy = (R.box_sum(z, size) for z in (gx * gx, gy * gy, gx * gy))
    return xx * yy - xy * xy - k * (xx + yy) ** 2


def min_eigenvalue(a: np.ndarray, size: int = 3) -> np.ndarray:
    gx, gy = R.gradients(a)
    xx, yy, xy = (R.box_sum(z, size) for z in (gx * gx, gy * gy, gx * gy))
    return (xx + yy) / 2 - np.sqrt(np.maximum(0, ((xx - yy) / 2) ** 2 + xy * xy))


def local_maxima(v: np.ndarray, size: int, least: float) -> np.ndarray:
    return np.where((v >= least) & (v == R.dilate(v, R.square(size))), 255, 0)


FAST_RING = ((-3, 0), (-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1))


def fast_corners(a: np.ndarray, threshold: int, arc: int = 9) -> np.ndarray:
    """255 where ``arc`` neighbouring pixels of the 16-pixel ring are all brighter or all darker by more than ``threshold``."""
    ring = np.stack(list(R.shifted(a, FAST_RING))).astype(np.int64)
    out = np.zeros(a.shape, dtype=bool)
    for test in (ring > a + threshold, ring < a - threshold):
        wrapped = np.concatenate([test, test[: arc - 1]])
        run = np.cumsum(np.concatenate([np.zeros((1, *a.shape), dtype=np.int64), wrapped]), axis=0)
        out |= (run[arc:] - run[:-arc] == arc).any(axis=0)
    out[:, :3], out[:, -3:], out[:, :, :3], out[:, :, -3:] = False, False, False, False
    return np.where(out, 255, 0)


def hough_lines(a: np.ndarray, thetas: int) -> np.ndarray:
    """Votes (thetas, 2 * reach + 1): each edge pixel adds one to every (theta, rho) it lies on."""
    n, h, w = a.shape
    reach = int(np.ceil(np.hypot(h, w)))
    t = np.arange(thetas) * np.pi / thetas
    out = np.zeros((n, thetas, 2 * reach + 1), dtype=np.int64)
    img, y, x = np.nonzero(a)
    for k in range(thetas):
        rho = np.floor(x * np.cos(t[k]) + y * np.sin(t[k]) + 0.5).astype(np.int64) + reach
        np.add.at(out, (img, k, rho), 1)
    return out


def hough_circles(a: np.ndarray, radius: int) -> np.ndarray:
    """Votes of edge pixels for centres at a radius."""
    t = np.arange(max(8, 8 * radius)) * 2 * np.pi / max(8, 8 * radius)
    ring = sorted({(int(round(radius * np.sin(s))), int(round(radius * np.cos(s)))) for s in t})
    return sum(v.astype(np.int64) for v in R.shifted((a > 0).astype(np.int32), ring, "constant"))


def dft_magnitude(a: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.fft2(a))


def dct_matrix(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def dct2(a: np.ndarray) -> np.ndarray:
    """Orthonormal 2-D DCT-II."""
    return dct_matrix(a.shape[1]) @ a @ dct_matrix(a.shape[2]).T


def idct2(a: np.ndarray) -> np.ndarray:
    return dct_matrix(a.shape[1]).T @ a @ dct_matrix(a.shape[2])


def band_filter(a: np.ndarray, low: float, high: float) -> np.ndarray:
    """Keep spatial frequencies (cycles per pixel) within [low, high]."""
    f = np.hypot(np.fft.fftfreq(a.shape[1])[:, None], np.fft.fftfreq(a.shape[2])[None, :])
    return np.fft.ifft2(np.fft.fft2(a) * ((f >= low) & (f <= high))).real


def butterworth_lowpass(a: np.ndarray, cutoff: float, order: int = 2) -> np.ndarray:
    f = np.hypot(np.fft.fftfreq(a.shape[1])[:, None], np.fft.fftfreq(a.shape[2])[None, :])
    return np.fft.ifft2(np.fft.fft2(a) / (1 + (f / cutoff) ** (2 * order))).real


def wiener(a: np.ndarray, kernel: R.Kernel, noise: float) -> np.ndarray:
    """Deconvolution by conj(H) / (|H|^2 + noise), the kernel centred at the origin."""
    k = np.asarray(kernel, dtype=np.float64)
    p = np.zeros(a.shape[1:])
    p[: k.shape[0], : k.shape[1]] = k
    h = np.fft.fft2(np.roll(p, (-(k.shape[0] // 2), -(k.shape[1] // 2)), (0, 1)))
    return np.fft.ifft2(np.fft.fft2(a) * np.conj(h) / (np.abs(h) ** 2 + noise)).real


def haar(a: np.ndarray) -> np.ndarray:
    """One level of the Haar wavelet: averages and details in the four quadrants; even sizes."""
    s, d = (a[:, ::2] + a[:, 1::2]) / 2, (a[:, ::2] - a[:, 1::2]) / 2
    v = np.concatenate([s, d], axis=1)
    return np.concatenate([(v[:, :, ::2] + v[:, :, 1::2]) / 2, (v[:, :, ::2] - v[:, :, 1::2]) / 2], axis=2)


def clahe(a: np.ndarray, tiles: int, clip: float) -> np.ndarray:
    """Equalise per tile with histograms clipped at ``clip`` times their mean, excess spread evenly; maps are blended
    bilinearly between tile centres."""
    n, h, w = a.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = R.copy_border(a, 0, th * tiles - h, 0, tw * tiles - w, "reflect101" if min(h, w) > 1 else "replicate")
    blocks = padded.reshape(n, tiles, th, tiles, tw).transpose(0, 1, 3, 2, 4).reshape(-1, th * tw)
    hist = np.stack([np.bincount(b, minlength=256) for b in blocks]).astype(np.float64)
    limit = max(1.0, clip * th * tw / 256)
    over = np.maximum(hist - limit, 0).sum(axis=1, keepdims=True)
    maps = (np.cumsum(np.minimum(hist, limit) + over / 256, axis=1) * (255 / (th * tw))).reshape(n, tiles, tiles, 256)
    fy, fx = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    wy, wx = (fy - y0)[None, :, None], (fx - x0)[None, None, :]
    img = np.arange(n)[:, None, None]
    p = lambda dy, dx: maps[img, np.clip(y0 + dy, 0, tiles - 1)[None, :, None], np.clip(x0 + dx, 0, tiles - 1)[None, None, :], a]
    return R.u8((p(0, 0) * (1 - wx) + p(0, 1) * wx) * (1 - wy) + (p(1, 0) * (1 - wx) + p(1, 1) * wx) * wy)


def match_template(a: np.ndarray, template: np.ndarray, mode: str) -> np.ndarray:
    """Scores at every placement inside the image: sqdiff, ccorr, ccoeff and ncc (0 where either has no energy)."""
    t = np.asarray(template, dtype=np.float64)
    win = np.lib.stride_tricks.sliding_window_view(np.asarray(a, dtype=np.float64), t.shape, axis=(1, 2))
    if mode == "sqdiff":
        return ((win - t) ** 2).sum(axis=(3, 4))
    if mode == "ccorr":
        return (win * t).sum(axis=(3, 4))
    tz, wz = t - t.mean(), win - win.mean(axis=(3, 4), keepdims=True)
    num = (wz * tz).sum(axis=(3, 4))
    if mode == "ccoeff":
        return num
    den = np.sqrt((wz * wz).sum(axis=(3, 4)) * (tz * tz).sum())
    return np.divide(num, den, out=np.zeros_like(num), where=den > 1e-12)


def watershed(a: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Flood from markers (positive labels) level by level; pixels two floods reach at once take the smaller label."""
    out = np.where(markers > 0, markers, 0).astype(np.int64)
    far = np.iinfo(np.int64).max
    for level in np.unique(a):
        while True:
            near = R.erode(np.where(out > 0, out, far), R.cross(3))
            grow = (out == 0) & (a <= level) & (near < far)
            if not grow.any():
                break
            out = np.where(grow, near, out)
    return out


def skeleton(a: np.ndarray) -> np.ndarray:
    """Union over erosions of what each loses to an opening by the cross."""
    cur, out = (a > 0).astype(np.int32), np.zeros(a.shape, dtype=np.int32)
    pad = lambda z: R.copy_border(z, 1, 1, 1, 1, "constant")
    while cur.any():
        er = R.erode(pad(cur), R.cross(3))[:, 1:-1, 1:-1]
        op = R.dilate(pad(er), R.cross(3))[:, 1:-1, 1:-1]
        out |= cur & ~op & 1
        cur = er
    return out * 255


def superpixels(a: np.ndarray, step: int, compactness: float, rounds: int = 5) -> np.ndarray:
    """SLIC on intensity: centres on a grid, pixels join the nearest in value and place, centres move to their means."""
    n, h, w = a.shape
    cy, cx = np.meshgrid(np.arange(step // 2, h, step), np.arange(step // 2, w, step), indexing="ij")
    cy, cx = (np.broadcast_to(c.ravel().astype(float), (n, c.size)).copy() for c in (cy, cx))
    cv = a[:, cy[0].astype(int), cx[0].astype(int)].astype(float)
    y, x = R.grid(h, w)
    lab = np.zeros(a.shape, dtype=np.int64)
    for _ in range(rounds):
        d = (a[:, None] - cv[:, :, None, None]) ** 2 + compactness**2 * ((y - cy[:, :, None, None]) ** 2 + (x - cx[:, :, None, None]) ** 2) / step**2
        lab = d.argmin(axis=1)
        for k in range(cv.shape[1]):
            m = lab == k
            c = m.sum(axis=(1, 2))
            for arr, src in ((cv, a), (cy, y), (cx, x)):
                arr[:, k] = np.where(c > 0, (src * m).sum(axis=(1, 2)) / np.maximum(c, 1), arr[:, k])
    return lab


def inpaint(a: np.ndarray, mask: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Fill masked pixels with the solution of Laplace's equation from their surround, by repeated averaging."""
    v = np.where(mask > 0, 0.0, a)
    known = (mask == 0).astype(np.float64)
    while (known == 0).any() and known.any():  # a first guess, ring by ring
        s = sum(R.shifted(v * known, R.square(3), "constant"))
        c = sum(R.shifted(known, R.square(3), "constant"))
        ring = (known == 0) & (c > 0)
        if not ring.any():
            break
        v, known = np.where(ring, s / np.maximum(c, 1), v), np.where(ring, 1.0, known)
    for _ in range(rounds):
        v = np.where(mask > 0, sum(R.shifted(v, [(-1, 0), (1, 0), (0, -1), (0, 1)])) / 4, v)
    return R.u8(v)


def horn_schunck(prev: np.ndarray, nxt: np.ndarray, alpha: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense optical flow (u, v) by the Horn-Schunck iteration."""
    p, q = np.asarray(prev, float), np.asarray(nxt, float)
    gx, gy, gt = R.correlate((p + q) / 2, [[-0.5, 0, 0.5]]), R.correlate((p + q) / 2, [[-0.5], [0], [0.5]]), q - p
    u, v = np.zeros(p.shape), np.zeros(p.shape)
    k = ((1 / 12, 1 / 6, 1 / 12), (1 / 6, 0, 1 / 6), (1 / 12, 1 / 6, 1 / 12))
    for _ in range(rounds):
        mu, mv = R.correlate(u, k), R.correlate(v, k)
        s = (gx * mu + gy * mv + gt) / (alpha**2 + gx * gx + gy * gy)
        u, v = mu - gx * s, mv - gy * s
    return u, v


def block_disparity(left: np.ndarray, right: np.ndarray, most: int, size: int) -> np.ndarray:
    """For each left pixel the shift d in [0, most) with the least sum of absolute differences over a block; the first
    wins."""
    cost = []
    for d in range(most):
        moved = R.copy_border(right, 0, 0, d, 0)[:, :, : right.shape[2]]
        cost.append(R.box_sum(np.abs(left.astype(np.float64) - moved), size))
    return np.argmin(np.stack(cost), axis=0)


def spectrum(a: np.ndarray) -> np.ndarray:
    """The 2-D transform of each image. Where a sum vanishes, what its terms leave in doubles is that of the definition,
    not of the fast transform's order: a logarithm of it tells them apart."""
    f = np.fft.fft2(a)
    _, h, w = a.shape
    y, x = np.mgrid[:h, :w]
    for n, u, v in np.argwhere(np.abs(f) < 1e-6):
        at = np.pi * ((u * y * w + v * x * h) / w) / (h / 2)
        f[n, u, v] = complex((a[n] * np.cos(at)).sum(), -(a[n] * np.sin(at)).sum())
    return f


def saliency(a: np.ndarray) -> np.ndarray:
    """Spectral residual, stretched to 0..255."""
    f = spectrum(a)
    log = np.log(np.abs(f) + 1e-9)
    residual = log - R.box_sum(log, 3) / 9
    s = np.abs(np.fft.ifft2(np.exp(residual + 1j * np.angle(f)))) ** 2
    s = R.separable(s, R.gaussian_line(5, 1.0))
    low, high = s.min(axis=(1, 2), keepdims=True), s.max(axis=(1, 2), keepdims=True)
    return R.u8((s - low) / np.maximum(high - low, 1e-12) * 255)


def contours(a: np.ndarray) -> np.ndarray:
    """255 on the foreground pixels that touch background or the border by a side: the outlines of all regions."""
    on = (a > 0).astype(np.int32)
    inside = R.erode(R.copy_border(on, 1, 1, 1, 1, "constant"), R.cross(3))[:, 1:-1, 1:-1]
    return (on - np.minimum(on, inside)) * 255


def _by_label(lab: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """255 where ``keep`` (images, labels) holds for a pixel's label."""
    return np.where(np.take_along_axis(keep, lab.reshape(len(lab), -1), axis=1).reshape(lab.shape), 255, 0)


def component_areas(lab: np.ndarray) -> np.ndarray:
    """(images, labels) pixel counts of labelled images; that of the background, label 0, counts as 0."""
    m = int(lab.max(initial=0)) + 1
    flat = lab.reshape(len(lab), -1) + np.arange(len(lab))[:, None] * m
    areas = np.bincount(flat.ravel(), minlength=len(lab) * m).reshape(len(lab), m)
    areas[:, 0] = 0
    return areas


def keep_largest(a: np.ndarray, count: int = 1, connectivity: int = 8) -> np.ndarray:
    """255 on the ``count`` components of most pixels; of equal ones the lower label stays."""
    lab = label(a, connectivity)
    areas = component_areas(lab)
    rank = np.argsort(np.argsort(-areas, axis=1, kind="stable"), axis=1)
    return _by_label(lab, (rank < count) & (areas > 0))


def filter_area(a: np.ndarray, least: int, most: int | None = None, connectivity: int = 8) -> np.ndarray:
    """255 on components of ``least`` to ``most`` pixels."""
    lab = label(a, connectivity)
    areas = component_areas(lab)
    return _by_label(lab, (areas >= max(1, least)) & (areas <= (areas.max(initial=0) if most is None else most)))


def gradient_similarity(a: np.ndarray, b: np.ndarray, steady: float = 170.0) -> np.ndarray:
    """Per pixel, how like the Prewitt gradient magnitudes of two images are: 1 where equal. The deviation of this map is
    a measure of distortion."""
    ma, mb = (np.hypot(*(g / 3 for g in R.gradients(v, R.PREWITT_X))) for v in (a, b))
    return (2 * ma * mb + steady) / (ma * ma + mb * mb + steady)


def universal_quality(a: np.ndarray, b: np.ndarray, window: int = 8) -> np.ndarray:
    """(images, 1, 1): the mean over all windows inside the image of 4 cov ma mb / ((va + vb) (ma^2 + mb^2)); 1 where two
    windows are flat and equal or the quotient has no meaning."""
    k = min(window, *a.shape[1:])
    p, q = np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64)

    def total(v: np.ndarray) -> np.ndarray:
        s = R.integral(v)
        return s[:, k:, k:] - s[:, :-k, k:] - s[:, k:, :-k] + s[:, :-k, :-k]

    n, free = k * k, max(1, k * k - 1)
    mp, mq = total(p) / n, total(q) / n
    vp, vq, cov = (total(p * p) - n * mp * mp) / free, (total(q * q) - n * mq * mq) / free, (total(p * q) - n * mp * mq) / free
    den = (vp + vq) * (mp * mp + mq * mq)
    return np.divide(4 * cov * mp * mq, den, out=np.ones_like(den), where=den > 0).mean(axis=(1, 2))[:, None, None]

"""Kernels against slow definitions on small random images, and known answers."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import kernels as K
from tessera.operators import raster as R

RNG = np.random.default_rng(5)
IMGS = RNG.integers(0, 256, (3, 9, 7))


def clamp(a, y, x):
    return a[min(max(y, 0), a.shape[0] - 1), min(max(x, 0), a.shape[1] - 1)]


def test_two_blobs_and_a_diagonal():
    a = np.zeros((1, 20, 30), dtype=int)
    a[0, 2:7, 2:7] = a[0, 10:15, 20:25] = 255
    assert K.label(a).max() == 2
    d = np.zeros((1, 5, 5), dtype=int)
    d[0, 1, 1] = d[0, 2, 2] = 255
    assert K.label(d, 8).max() == 1 and K.label(d, 4).max() == 2


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**30))
def test_labels_are_flood_fill_components(seed):
    a = (np.random.default_rng(seed).random((1, 8, 8)) > 0.5).astype(int)
    got, seen, k = K.label(a, 4)[0], {}, 0
    for y in range(8):
        for x in range(8):
            if a[0, y, x] and (y, x) not in seen:
                k += 1
                stack = [(y, x)]
                while stack:
                    p = stack.pop()
                    if p in seen or not (0 <= p[0] < 8 and 0 <= p[1] < 8) or not a[0][p]:
                        continue
                    seen[p] = k
                    stack += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
    assert all(got[y, x] == seen.get((y, x), 0) for y in range(8) for x in range(8))


def test_box_and_median_match_their_definition():
    box, med = R.box_blur(IMGS, 3), R.median_blur(IMGS, 3)
    for n, a in enumerate(IMGS):
        for y in range(9):
            for x in range(7):
                v = [clamp(a, y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
                assert box[n, y, x] == int(sum(v) / 9 + 0.5)
                assert med[n, y, x] == sorted(v)[4]


def test_distance_transform_is_exact():
    a = (RNG.random((2, 10, 12)) > 0.2).astype(int)
    got = K.distance_transform(a)
    for n in range(2):
        z = np.argwhere(a[n] == 0)
        for y in range(10):
            for x in range(12):
                assert got[n, y, x] == pytest.approx(np.sqrt(((z - [y, x]) ** 2).sum(1).min()))


def test_transforms_invert():
    v = IMGS[:, :8, :6].astype(float)
    assert np.allclose(K.idct2(K.dct2(v)), v)
    assert np.allclose(K.band_filter(v, 0, 9), v)
    assert (R.rotate90(R.rotate90(R.rotate90(R.rotate90(IMGS)))) == IMGS).all()
    assert (R.resize_nearest(IMGS, 9, 7) == IMGS).all() and (R.resize_bilinear(IMGS, 9, 7) == IMGS).all()


def test_borders():
    i = np.arange(-4, 8)
    assert R.border_index(i, 4, "reflect").tolist() == [3, 2, 1, 0, 0, 1, 2, 3, 3, 2, 1, 0]
    assert R.border_index(i, 4, "reflect101").tolist() == [2, 3, 2, 1, 0, 1, 2, 3, 2, 1, 0, 1]
    assert R.border_index(i, 4, "wrap").tolist() == [0, 1, 2, 3, 0, 1, 2, 3, 0, 1, 2, 3]
    assert R.border_index(i, 4, "constant").tolist() == [-1] * 4 + [0, 1, 2, 3] + [-1] * 4


def test_edges_of_a_square_close():
    a = np.zeros((1, 40, 40), dtype=int)
    a[0, 10:30, 10:30] = 255
    edges = K.canny(a, 50, 150)[0]
    assert edges[20, 8:13].any() and edges[20, 27:32].any() and not edges[20, 15:25].any()


def test_disparity_finds_the_shift():
    right = RNG.integers(0, 256, (1, 20, 40))
    left = np.roll(right, 5, axis=2)
    assert (K.block_disparity(left, right, 8, 5)[:, 4:-4, 12:-4] == 5).all()


def test_map_images_keeps_shapes_and_nulls(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4], 2, 2), (2, None, 1, 1), (3, [1, 2, 3, 4, 5, 6], 2, 3)], "img_id bigint, img array<int>, rows int, cols int")
    got = {r.img_id: (r.img, r.rows, r.cols) for r in R.map_images(df, R.transpose).collect()}
    assert got == {1: ([1, 3, 2, 4], 2, 2), 2: (None, None, None), 3: ([1, 4, 2, 5, 3, 6], 3, 2)}


def test_saliency_of_a_vanishing_frequency():
    """Images whose sum at (4, 4) is 0 but for rounding, against the SQL."""
    import duckdb
    import pandas as pd

    from tessera.plans.q_kernels import _RESIDUAL

    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (400, 8, 8))
    sign = np.where(np.indices((8, 8)).sum(0) % 2, -1, 1)
    for n in range(len(a)):  # make the alternating sum 0
        while gap := int((a[n] * sign).sum()):
            y, x = rng.integers(0, 8, 2)
            a[n, y, x] = np.clip(a[n, y, x] - gap * sign[y, x], 0, 255)
    con = duckdb.connect()
    con.register("t", pd.DataFrame({"vec_id": range(len(a)), "embedding": [((v.ravel() / 255) * 1.2 - 0.6).tolist() for v in a]}))
    con.execute("CREATE VIEW embeddings AS SELECT * FROM t")
    want = con.execute(f"WITH {_RESIDUAL} SELECT (v - low) / (high - low) * 255 FROM r ORDER BY img_id, y, x").fetchnumpy()
    want = next(iter(want.values())).reshape(a.shape)
    assert np.abs(np.abs(np.fft.fft2(a))[:, 4, 4]).max() < 1e-6
    assert (K.saliency(a) == np.floor(want + 0.5)).all()

import numpy as np
import pytest

from tessera.operators import network as N
from tessera.operators import points as G

RNG = np.random.default_rng(7)


def test_hull_rect_and_circle_enclose():
    for _ in range(30):
        p = RNG.integers(0, 12, (RNG.integers(3, 30), 2)).astype(float)
        h = G.convex_hull(p)
        if len(h) > 2:
            e = np.roll(h, -1, axis=0) - h
            assert all(((e[:, 0] * (q[1] - h[:, 1]) - e[:, 1] * (q[0] - h[:, 0])) >= -1e-9).all() for q in p)
            assert G.min_area_rect(p)[2] * G.min_area_rect(p)[3] >= G.area(h) - 1e-9
        x, y, r = G.enclosing_circle(p)
        far = np.hypot(p[:, 0] - x, p[:, 1] - y)
        assert far.max() <= r + 1e-6 and (far > r - 1e-6).sum() >= min(2, len(set(map(tuple, p.tolist()))))


def test_fits_recover_their_model():
    t = np.linspace(0, 5, 40)
    assert np.allclose(G.fit_circle(np.stack([3 + 2 * np.cos(t), 1 + 2 * np.sin(t)], 1)), [3, 1, 2])
    assert np.allclose(G.fit_line(np.stack([t, 2 * t + 1], 1))[2:], np.array([1, 2]) / np.sqrt(5))
    src, m = RNG.uniform(0, 100, (60, 2)), np.array([[1.1, 0.1, 5], [-0.2, 0.9, 3], [1e-3, 2e-3, 1]])
    dst = G.apply_homography(m, src)
    dst[:20] += RNG.uniform(20, 50, (20, 2))
    got, inliers = G.ransac(src, dst, G.homography, G.apply_homography, 4, 0.5)
    assert np.allclose(got, m, atol=1e-4) and inliers.sum() == 40
    cloud = RNG.normal(size=(80, 3))
    a = 0.1
    rot = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    r, t3, rms = G.icp(cloud, cloud @ rot.T + [0.05, 0.02, 0.0], 60)
    assert rms < 1e-6 and np.allclose(r, rot, atol=1e-5)
    flat = np.concatenate([RNG.uniform(0, 1, (50, 2)), np.zeros((50, 1))], 1)
    assert np.allclose(G.normals(flat, 6), [0, 0, 1])
    assert len(G.simplify(np.array([[0, 0], [1, 0.01], [2, 0], [3, 5.0], [4, 0]]), 0.1)) == 4


def test_layers_match_their_definition():
    x, w, b = RNG.normal(size=(2, 3, 6, 6)), RNG.normal(size=(4, 3, 3, 3)), RNG.normal(size=4)
    got, pad = N.conv2d(w, b, stride=2, pad=1)(x), np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    assert got.shape == (2, 4, 3, 3)
    assert got[1, 2, 1, 2] == pytest.approx((pad[1, :, 2:5, 4:7] * w[2]).sum() + b[2])
    assert N.max_pool(2)(x)[0, 0, 1, 1] == x[0, 0, 2:4, 2:4].max()
    assert np.allclose(N.softmax()(RNG.normal(size=(3, 5))).sum(1), 1)
    assert np.allclose(N.batch_norm(x.mean((0, 2, 3)), x.var((0, 2, 3)), np.ones(3), np.zeros(3), 0)(x).mean((0, 2, 3)), 0)


def test_predict(spark):
    df = spark.createDataFrame([(i, [i] * 16) for i in range(5)], "img_id bigint, img array<int>")
    layers = [N.conv2d(np.ones((1, 1, 3, 3)), np.zeros(1)), N.relu(), N.flatten(), N.dense(np.ones((2, 4)), np.array([0.0, 1.0]))]
    got = {r.img_id: r.output for r in N.predict(df, layers, (1, 4, 4), 1.0).collect()}
    assert got == {i: [36.0 * i, 36.0 * i + 1] for i in range(5)}

"""Contours: known shapes, and every region of random images against flood fill."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import contours as C
from tessera.operators import kernels as K


def image(text):
    return np.array([[int(c == "#") for c in line] for line in text.split()])[None]


def test_square_goes_round_once_and_has_four_corners():
    (found,) = C.trace(image("..... ..... .###. .###. .###. ....."))
    assert len(found) == 1 and not found[0].hole and found[0].parent == -1
    assert sorted(found[0].points) == [(y, x) for y in (2, 3, 4) for x in (1, 2, 3) if (y, x) != (3, 2)]
    assert sorted(C.corners(found[0].points)) == [(2, 1), (2, 3), (4, 1), (4, 3)]


def test_ring_around_a_dot_nests_three_deep():
    (found,) = C.trace(image("####### #.....# #.....# #..#..# #.....# #.....# #######"))
    assert [(c.hole, c.y, c.x, c.parent) for c in found] == [(False, 0, 0, -1), (True, 1, 0, 0), (False, 3, 3, 1)]
    assert [len(C.retrieve(found, m)) for m in C.MODES] == [3, 1, 3, 3]
    assert [c.parent for c in C.retrieve(found, "list")] == [-1, -1, -1]
    assert [c.parent for c in C.retrieve(found, "two_level")] == [-1, 0, -1]
    with pytest.raises(ValueError):
        C.retrieve(found, "other")


def test_a_line_is_walked_there_and_back_and_a_dot_once():
    (line,) = C.trace(image("####"))
    assert line[0].points == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 2), (0, 1)]
    (dot,) = C.trace(image("... .#. ..."))
    assert dot[0].points == [(1, 1)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**30), st.integers(1, 9), st.integers(1, 9), st.floats(0.2, 0.8))
def test_borders_are_the_pixels_where_regions_touch(seed, h, w, share):
    a = (np.random.default_rng(seed).random((1, h, w)) < share).astype(int)
    (found,) = C.trace(a)
    fore = K.label(a, 8)[0]
    back = K.label(np.pad(1 - a, ((0, 0), (1, 1), (1, 1)), constant_values=1), 4)[0]
    touching = {}
    for y in range(h):
        for x in range(w):
            for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                b = back[y + 1 + dy, x + 1 + dx]
                if a[0, y, x] and b:
                    touching.setdefault((int(fore[y, x]), int(b)), set()).add((y, x))
    assert sorted(map(sorted, touching.values())) == sorted(sorted(set(c.points)) for c in found)
    assert sum(not c.hole for c in found) == fore.max() and sum(c.hole for c in found) == back.max() - 1
    for c in found:
        ring = [*c.points, c.points[0]]
        assert all(max(abs(p[0] - q[0]), abs(p[1] - q[1])) <= 1 for p, q in zip(ring, ring[1:], strict=False))
        assert c.parent < 0 or found[c.parent].hole != c.hole


def test_table_of_contours(spark):
    rows = [(1, [0, 0, 0, 0, 5, 0, 0, 0, 0], 3, 3), (2, None, 3, 3), (3, [0, 0], 1, 2), (4, [1, 1, 0, 1], 2, 2), (5, [], 0, 0)]
    df = spark.createDataFrame(rows, "img_id long, img array<int>, rows int, cols int")
    got = {r.img_id: r for r in C.find_contours(df, simple=True).collect()}
    assert sorted(got) == [1, 4] and (got[1].ys, got[1].xs) == ([1], [1]) and got[4].parent == -1
    assert C.find_contours(df.where("img_id > 9")).collect() == []


def test_components_by_size():
    a = image("##..# ##..# ....# #....")
    assert (K.keep_largest(a) > 0).sum() == 4 and (K.keep_largest(a, 2) > 0).sum() == 7 and not K.keep_largest(a, 0).any()
    assert (K.filter_area(a, 2, 3) > 0).sum() == 3 and (K.filter_area(a, 3) > 0).sum() == 7
    assert not K.keep_largest(np.zeros((2, 3, 3), int), 3).any()

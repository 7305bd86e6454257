"""Hash pairs and groups against brute force."""

import numpy as np

from tessera.operators import search as S


def test_copies_of_a_code_have_pairs_and_groups(spark):
    rows = [(i, 5) for i in (3, 4, 9)] + [(i, 7) for i in (1, 8)] + [(2, -1), (6, -1)]
    codes = spark.createDataFrame(rows, "id bigint, code bigint")
    assert sorted(map(tuple, S.near_codes(codes, 2).collect())) == [(1, 3, 1), (1, 8, 0), (2, 6, 0), (3, 4, 0), (3, 9, 0)]
    assert sorted(map(tuple, S.near_groups(codes, 2).collect())) == [(1, 1), (2, 2), (3, 1), (4, 1), (6, 2), (8, 1), (9, 1)]


def test_pairs_that_differ_in_every_nibble_are_found(spark):
    for distance, code in ((16, 0x1111111111111111), (18, 0x1111111111111133), (18, 0x7111111111111111), (0, 1), (63, (1 << 63) - 1), (64, -1)):
        codes = spark.createDataFrame([(1, 0), (2, code)], "id bigint, code bigint")
        bits = (code % (1 << 64)).bit_count()
        want = [(1, 2, bits)] if bits <= distance else []
        assert [tuple(r) for r in S.near_codes(codes, distance).collect()] == want


def test_bands_are_disjoint_and_cover_the_code(spark):
    codes = spark.createDataFrame([(i, (1 << i) - (1 << 64) * (i == 63)) for i in range(64)], "id bigint, code bigint")
    for bands in (1, 13, 19, 64, 65):
        assert S.band_keys(codes, bands, 64).where("key <> 0").count() == 64


def test_recall_of_bucket_search(spark):
    """At least 0.9 of the three nearest codes, by distance, of every twentieth image among all."""
    from tessera.plans import q_search

    codes = q_search._AH(spark, "/root/testdata/sf0.01")
    queries = codes.where("id % 20 = 0")
    # halves: a double has no room for 64 bits
    bits = lambda df: df.selectExpr("id", "array(shiftrightunsigned(code, 32), code & 4294967295L) AS vec")
    exact = S.knn(bits(queries), bits(codes), 3, "hamming", skip_self=True).where("rank = 3").collect()
    third = {r.query_id: r.dist for r in exact}
    found = S.lsh_knn(queries, codes, 3, 8, 8, 1).collect()
    assert sum(r.dist <= third[r.query_id] for r in found) >= 0.9 * 3 * len(third)


def test_a_task_sends_k_rows_a_query(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(900)], "id bigint, vec array<double>").repartition(3)
    sent = S._scan(base, base, "l2", True, 5)
    assert sent.count() <= 3 * 5 * 900
    got = {(r.query_id, r["rank"]): r.nbr_id for r in S.knn(base, base, 5, skip_self=True).collect()}
    rows = {r.id: np.array(r.vec) for r in base.collect()}
    m = np.stack([rows[i] for i in range(900)])
    d = np.round(np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1)), 9)
    np.fill_diagonal(d, np.inf)
    assert all(got[i, k + 1] == j for i in range(0, 900, 37) for k, j in enumerate(np.argsort(d[i], kind="stable")[:5]))


def test_narrow_bands_make_no_join_of_keys(spark):
    """At distance 18 a band has 3 or 4 bits: nearly all pairs met in each of 19 bands."""
    rng = np.random.default_rng(3)
    code = rng.integers(-(1 << 63), 1 << 63, 400)
    code[200:] = code[:200] ^ (1 << rng.integers(0, 63, 200))
    codes = spark.createDataFrame([(i, int(c)) for i, c in enumerate(code)], "id bigint, code bigint")
    d = np.bitwise_count((code[:, None] ^ code[None]).view(np.uint64))
    want = {(int(i), int(j), int(d[i, j])) for i, j in np.argwhere(d <= 18) if i < j}
    pairs = S._near_distinct(codes, 18, 64)
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    for tile in (S.TILE, 64):
        S.TILE, before = tile, S.TILE
        try:
            got = list(map(tuple, S.near_codes(codes, 18).collect()))
        finally:
            S.TILE = before
        assert len(got) == len(want) and set(got) == want


def test_cross_check_searches_forward_once(spark):
    """The first search is read three times; before, its plan was part of each."""
    from tessera.plans import q_search

    plan = q_search._cross(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1

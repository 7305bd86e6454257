import random

import numpy as np
import pytest
from llm.fixtures import awkward_docs, brute_components, no_docs, pairs, shingles

from tessera.llm import graph
from tessera.llm import ngram_join as J


def got(spark, rows, rule):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted((tuple(r) for r in J.near_duplicates(docs, rule).collect()), key=str)


@pytest.mark.parametrize("rule", [J.Rule(3, 90, 100), J.Rule(5, 80, 100), J.Rule(1, 60, 100)])
def test_matches_brute_force(spark, rule):
    rng = random.Random(rule.size)
    vocab = [f"w{i}" for i in range(60)]
    seeds = [[rng.choice(vocab) for _ in range(rng.randint(1, 90))] for _ in range(25)]
    rows = []
    for i in range(150):
        w = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, (" " if i % 2 else "\n").join(w).upper() if i % 5 == 0 else " ".join(w)))
    assert got(spark, rows, rule) == sorted(brute_components(rows, rule.size, rule.num, rule.den), key=str)


def test_a_large_group_of_near_copies_and_a_shared_passage(spark, monkeypatch):
    monkeypatch.setattr(J, "TILE", 16)  # several blocks to a token
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, passage = [word() for _ in range(150)], " ".join(word() for _ in range(60))
    rows = []
    for i in range(80):
        w = list(base)
        w[rng.randrange(150)] = word()
        w[rng.randrange(150)] = word()
        rows.append((i, " ".join(w)))
    rows += [(100 + i, passage + " " + " ".join(word() for _ in range(rng.choice([1, 2, 3, 40])))) for i in range(60)]
    rule = J.Rule()
    assert got(spark, rows, rule) == sorted(brute_components(rows, 3, 90, 100), key=str)


def test_chains_are_followed_to_their_end(spark):
    words = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(60)]
    assert got(spark, rows, J.Rule(3, 85, 100)) == sorted(brute_components(rows, 3, 85, 100), key=str)


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    want = sorted(brute_components(pairs(docs), 3, 90, 100), key=str)
    assert sorted((tuple(r) for r in J.near_duplicates(docs).collect()), key=str) == want
    assert J.near_duplicates(no_docs(spark)).count() == 0
    kept = J.drop_near_duplicates(docs, J.Rule())
    assert kept.columns == docs.columns
    blank = [(d, t) for d, t in pairs(docs) if not shingles(t, 3)]
    classes = {c for _, n, c in want if n}
    assert sorted(map(str, (d for d, t in pairs(kept) if shingles(t, 3)))) == sorted(map(str, classes))
    assert sum(not shingles(t, 3) for _, t in pairs(kept)) == len(blank)
    assert J.drop_near_duplicates(no_docs(spark), J.Rule()).count() == 0


def test_bit_counts_bound_the_overlap_from_above():
    rng = np.random.default_rng(3)
    rule = J.Rule()
    for _ in range(300):
        pool = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
        a = np.sort(rng.choice(pool, rng.integers(1, 300), replace=False))
        keep = rng.random(len(a)) < rng.choice([0.5, 0.95, 1.0])
        b = np.unique(np.concatenate([a[keep], rng.choice(pool, rng.integers(1, 20), replace=False)]))
        p, q = (np.frombuffer(J.signature(x), dtype=np.uint8)[None] for x in (a, b))
        size = min(p.shape[1], q.shape[1])
        differ = np.bitwise_count(J._fold(p, size) ^ J._fold(q, size)).sum()
        both = len(np.intersect1d(a, b))
        assert differ <= len(a) + len(b) - 2 * both
        if rule.den * both >= rule.num * (len(a) + len(b) - both):
            assert J.may_link(np.array([len(a)]), np.array([len(b)]), np.array([differ]), rule)[0]


def test_linked_sizes_are_in_neighbouring_bands():
    for rule in (J.Rule(3, 90, 100), J.Rule(5, 80, 100)):
        e = rule.edges(5000)
        band = lambda n: np.searchsorted(e, n, side="right") - 1  # noqa: B023, E731
        for n in range(1, 2000):
            assert band(rule.den * n // rule.num) - band(n) <= 1
            b = band(n)
            large = rule.den * n // rule.num
            differ = max(n + m - 2 * -(-rule.num * (n + m) // (rule.den + rule.num)) for m in range(n, large + 1))
            assert differ <= rule.most_different(e[b], e[b + 1])


def test_components_of_random_graphs(spark):
    rng = random.Random(6)
    for n, m in ((40, 20), (60, 90), (50, 49)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m != 49 else [(i, i + 1) for i in range(49)]
        parent = list(range(n))

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in edges:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
        want = {i: root(i) for e in edges for i in e if e[0] != e[1]}
        found = graph.components(spark.createDataFrame(edges, "a bigint, b bigint"))
        assert {r.node: r.comp for r in found.collect()} == want


def test_linked_sets_share_a_token():
    rng = np.random.default_rng(5)
    for rule in (J.Rule(3, 90, 100), J.Rule(5, 80, 100)):
        for n in (4, 5, 9, 10, 19, 20, 40, 75, 200, 900):
            for _ in range(40):
                a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
                gone, new = (rng.integers(0, max(1, n // 8) + 1) for _ in range(2))
                b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 64, new, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if not np.array_equal(a, b) and rule.den * both >= rule.num * (len(a) + len(b) - both):
                    assert len(np.intersect1d(J.set_tokens(a, rule), J.set_tokens(b, rule)))


def test_tokens_of_few_and_of_many_classes_meet():
    rng = np.random.default_rng(2)
    shift = 58
    tokens = rng.integers(0, 1 << 64, 50, dtype=np.uint64)
    held = {int(t): {int(k) for k in rng.integers(0, 1 << 48, rng.choice([1, 2, 3, 15, 16, 40]))} for t in tokens}
    rows = [(t, k) for t, ks in held.items() for k in ks]
    rng.shuffle(rows)
    blobs, tiles = {}, {}
    for part in (rows[::3] + rows[:20], rows[1::3], rows[2::3]):  # three tasks, rows sent twice
        t, k = (np.array(c, dtype=np.uint64) for c in zip(*part, strict=True))
        for bucket, raw, past in J.pack_tokens(t, k, shift):
            if past:
                for tile, k1 in np.frombuffer(raw, dtype=np.uint64).reshape(-1, 2).tolist():
                    tiles.setdefault(tile, set()).add(k1)
            else:
                blobs.setdefault(bucket, []).append(raw)
    for bucket, raw in blobs.items():
        for tile, k1 in zip(*(x.tolist() for x in J.shared_tokens(bucket, raw)), strict=True):
            tiles.setdefault(tile, set()).add(k1)
    assert sorted(map(sorted, tiles.values())) == sorted(sorted(ks) for ks in held.values() if len(ks) > 1)


def test_columns_of_any_name_come_back_unchanged(spark):
    rows = [(1, "a b c d", 7, 8, "h"), (2, "a b c d", 9, 8, "i"), (3, "e f g h", 7, 8, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _xx bigint, _n bigint, hash string")
    assert sorted(map(tuple, J.drop_near_duplicates(docs, J.Rule()).collect())) == [rows[0], rows[2]]

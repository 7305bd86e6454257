import math
import random
import zlib

import numpy as np
import pytest
from llm.fixtures import awkward_docs, no_docs, pairs
from pyspark.sql import functions as F

from tessera.llm import quality_cnn as N
from tessera.llm import quality_rules as Q


def base(text):
    text = text or ""
    w = [x.decode() for x in text.encode().split()]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in (i, i + 1, i + 2)} if len(w) < 2000 else set()
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "b", "c#", "d\n", "|", "é<", "\x0b"]) for _ in range(rng.randint(0, 90))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate([*texts, None, "", "same line\nsame line\n\n\nsame line "])), "doc_id bigint, text string")
    got = {r.doc_id: r for r in Q.quality_rules(docs, docs.where("doc_id < 10").select("doc_id")).collect()}
    for d, t in pairs(docs):
        r, want = got[d], base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_ratio_matches_brute_force(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(60))) for i in range(40)], "doc_id bigint, text string")
    target = docs.where("doc_id % 3 = 0").select("doc_id")
    rows = pairs(docs)
    grams = {d: [(w,) for w in t.split()] + list(zip(t.split(), t.split()[1:], strict=False)) for d, t in rows}
    hashes = spark.createDataFrame([(" ".join(g), len(g)) for g in {g for v in grams.values() for g in v}], "g string, n int")
    parts = F.split("g", " ")
    bucket = F.when(F.col("n") == 1, F.xxhash64(parts[0])).otherwise(F.xxhash64(parts[0], F.get(parts, F.lit(1))))
    of = {tuple(r.g.split(" ")): r.b for r in hashes.select("g", F.pmod(bucket, F.lit(Q.BUCKETS)).alias("b")).collect()}
    raw, hit = np.zeros(Q.BUCKETS), np.zeros(Q.BUCKETS)
    for d, v in grams.items():
        for g in v:
            raw[of[g]] += 1
            hit[of[g]] += d % 3 == 0
    weight = np.log((hit + Q.SMOOTHING) / (raw * hit.sum() / raw.sum() + Q.SMOOTHING))
    for r in Q.quality_rules(docs, target).collect():
        assert r.llr == pytest.approx(np.mean([weight[of[g]] for g in grams[r.doc_id]]), abs=1e-9)
    middle = float(np.median([np.mean([weight[of[g]] for g in v]) for v in grams.values()])) + 1e-12
    judged = Q.quality_rules(docs, target, threshold=middle).collect()
    assert {r.kept for r in judged} == {True, False} and all(r.kept == (not r.base_failed and r.llr >= middle) for r in judged)


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward_docs(spark)
    ids = docs.where("doc_id in (0, 3)").select("doc_id")
    assert Q.quality_rules(docs, ids).count() == docs.count()
    assert Q.quality_rules(no_docs(spark), ids).count() == 0
    none = Q.quality_rules(docs, ids.limit(0)).collect()
    assert all(r.llr == 0 for r in none)
    kept = Q.keep_passing(docs, ids)
    assert kept.columns == docs.columns
    assert sorted(map(str, pairs(kept))) == sorted(str((r.doc_id, t)) for r, (_, t) in zip(sorted(Q.quality_rules(docs, ids).collect(), key=lambda r: str(r.doc_id)), sorted(pairs(docs), key=lambda p: str(p[0])), strict=True) if r.kept)


def test_long_texts_are_counted_in_full_by_pieces(spark, monkeypatch):
    rng = random.Random(6)
    atoms = ["a", "b", "c#", "d\n", "|", "é<", "\x0b", "\n\n", "   ", "😀x", "long" * 9]
    texts = [rng.choice(["", " ", "\n"]) + " ".join(rng.choice(atoms[: rng.randint(2, 11)]) for _ in range(rng.randint(40, 200))) for _ in range(60)]
    texts += [" " * 400, "word" * 100, "x y\n" * 90, "\n".join(f"w{i}" for i in range(120)), None, "", "short text"]
    docs = spark.createDataFrame([(i % 60 if i != 5 else None, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, `_id` string")
    ids = docs.where("doc_id % 3 = 0").select("doc_id")
    want = sorted(Q.quality_rules(docs, ids).collect(), key=str)
    kept = sorted(map(str, Q.keep_passing(docs, ids).collect()))
    for length, piece in ((150, 7), (0, 1), (150, 1 << 15)):
        monkeypatch.setattr(Q, "LONG_BYTES", length)
        monkeypatch.setattr(Q, "PIECE", piece)
        judged = Q.quality_rules(docs, ids)
        # the arrays of a row are made of the short texts alone
        assert f"<= {length}" in judged._jdf.queryExecution().analyzed().toString()
        for r, x in zip(want, sorted(judged.collect(), key=str), strict=True):
            assert r[:8] == x[:8] and r.llr == pytest.approx(x.llr, abs=1e-12)
        assert sorted(map(str, Q.keep_passing(docs, ids).collect())) == kept
    counts = sorted(tuple(r[1:6]) for r in judged.collect())
    assert counts == sorted(base(t) for t in texts)


def test_no_python_on_the_rules_path(spark):
    docs = awkward_docs(spark)
    plan = Q.quality_rules(docs, docs.select("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_chunks_cover_every_window():
    for n in (0, 1, 5, 6, 511, 512, 513, 1019, 1020, 5000):
        data = bytes(i % 251 for i in range(n))
        chunks = N.chunks_of(data)
        seen = {bytes((c[i : i + N.WIDTH] - 1).astype(np.uint8)) for c in chunks for i in range(N.CHUNK - N.WIDTH + 1) if (c[i : i + N.WIDTH] > 0).all()}
        assert {data[i : i + N.WIDTH] for i in range(n - N.WIDTH + 1)} <= seen


def test_score_in_parts_is_score_of_the_whole():
    net = N.ByteCnn.fresh(np.random.default_rng(1))
    text = "".join(chr(97 + i * i % 26) for i in range(70_000))
    tops = net.tops(N.chunks_of(text.encode()))
    assert net.score(text) == pytest.approx(net.probability(net.pooled(tops)), abs=1e-6)
    assert 0 <= net.score("") <= 1


def test_network_learns_and_leaves_held_out_rows_alone(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "and", "of", "river", "stone"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["THE!!", "AND!!", "###", "|"]) for _ in range(60))
    rows = [(i, good() if i % 3 else bad()) for i in range(240)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in N.quality_scores(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [r for r in got.values() if r.held_out and r.doc_id < 240]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in N.quality_scores(docs, flipped).collect()} == {d: r.score for d, r in got.items()}


def test_classifier_takes_awkward_rows(spark):
    docs = awkward_docs(spark)
    labels = spark.createDataFrame([(0, 1), (9, 0), (None, 1), (3, None)], "doc_id bigint, quality int")
    assert N.quality_scores(docs, labels).count() == docs.count()
    assert N.quality_scores(docs, labels.limit(0)).where("score between 0 and 1").count() == docs.count()
    assert N.quality_scores(no_docs(spark), labels).count() == 0
    assert N.keep_good(docs, labels).columns == docs.columns
    assert not math.isnan(N.fit([], []).score("x"))


def test_sample_is_taken_from_labels_whose_document_is_there(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(0, 400, 4)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 8 > 0)) for i in range(400)], "doc_id bigint, quality int")
    rows = N.training_rows(docs, labels, "doc_id", "text", "quality", max_rows=40)
    assert sorted(y for _, y, _ in rows) == [0] * 20 + [1] * 20
    assert {w for _, _, w in rows} == {50 / 20}


def test_repeated_ids_do_not_crowd_out_a_class(spark):
    rows = [(1, f"hot {i:03}") for i in range(300)] + [(i, f"text {i}") for i in range(2, 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    labels = spark.createDataFrame([(i, int(i < 5)) for i in range(1, 10)], "doc_id bigint, quality int")
    got = N.training_rows(docs, labels, "doc_id", "text", "quality", max_rows=20)
    assert [(t, y) for t, y, _ in got] == [("hot 000", 1), *((f"text {i}", int(i < 5)) for i in range(2, 10))]


def test_score_is_that_of_a_plain_convolution():
    rng = np.random.default_rng(9)
    net = N.ByteCnn(*(rng.normal(0, 0.4, s).astype(np.float32) for s in ((N.WIDTH, 257, N.FILTERS), N.FILTERS, 3 * N.FILTERS)), 0.1)
    net.taps[:, 0] = 0
    for size in (0, 1, 5, 6, 511, 512, 513, 1100):
        data = rng.integers(32, 127, size, dtype=np.uint8).tobytes()
        step, responses, at = N.CHUNK - N.WIDTH + 1, [], 0
        while True:
            chunk = data[at : at + N.CHUNK].ljust(N.CHUNK, b"\0")
            used = len(data[at : at + N.CHUNK])
            windows = [sum(net.taps[j, chunk[i + j] + 1 if i + j < used else 0] for j in range(N.WIDTH)) for i in range(step)]
            responses.append(np.tanh(np.max(windows, axis=0) + net.bias))
            at += step
            if at >= max(1, len(data) - N.WIDTH + 1):
                break
        pooled = np.concatenate([np.mean(responses, axis=0), np.max(responses, axis=0), np.min(responses, axis=0)])
        assert abs(net.score(data.decode()) - 1 / (1 + np.exp(-(pooled @ net.head + net.offset)))) < 1e-5


def test_training_sees_both_classes_whatever_their_lengths(spark):
    good, bad = "quiet words in a row " * 1100, "BUY!! now $$$ " * 1000
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) + str(i), 7.0, "z") for i in range(24)], "doc_id bigint, text string, score double, _text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id bigint, quality int")
    rows = N.training_rows(docs, labels, "doc_id", "text", "quality")
    assert sorted(y for _, y, _ in rows) == [0] * 12 + [1] * 12
    assert all(len(t) == N.SPREAD * N.CHUNK and t.endswith(("5", "7", "9", "1", "3")) for t, y, _ in rows if y)
    kept = N.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(1, 24, 2)) and {r.score for r in kept.collect()} == {7.0}

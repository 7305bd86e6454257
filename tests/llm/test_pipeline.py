"""The pipeline's stages against brute force on a small corpus, each judged on its own input."""

import random
import zlib

import pytest
from llm.fixtures import awkward_docs, brute_components, no_docs, pairs, shingles

import corpus_pipeline as CP
from tessera.llm import quality_cnn


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    vocab = [f"{a}{b}" for a in ("ri", "sto", "wa", "the", "and") for b in ("ver", "ne", "ter", "re", "")]
    good = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(i, good(rng.randint(60, 150))) for i in range(80)]
    rows += [(100 + i, " ".join(w.upper() + "!!" for w in good(80).split())) for i in range(20)]  # shouting
    rows += [(200, rows[0][1]), (201, rows[1][1].upper().lower()), (202, rows[2][1] + " tail"), (203, "too short"), (204, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2)] + [(100 + i, 0, 0) for i in range(0, 20, 2)], "doc_id bigint, quality int, toxic int")
    d = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in CP.STAGES:
        rows, out = pairs(docs), stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns
            assert set(map(str, pairs(out))) <= set(map(str, rows))
        if name == "quality_rules":
            assert all(len((t or "").split()) >= 50 for _, t in pairs(out))
            assert {d for d, _ in pairs(out)} >= set(range(80)) and not {d for d, _ in pairs(out)} & set(range(100, 120))
        elif name == "quality_classifier":
            assert {d for d, _ in pairs(out)} >= set(range(3, 80))
            learned = [(t or "", int(d < 100), d) for d, t in sorted(pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))) if d < 120 and d % 2 == 0 and zlib.crc32(str(d).encode()) % 5]
            net = quality_cnn.fit([t for t, _, _ in learned], [y for _, y, _ in learned], [1.0] * len(learned))
            assert sorted(d for d, _ in pairs(out)) == sorted(d for d, t in rows if net.score(t or "") >= 0.3)
        elif name == "exact_dedup":
            best = {}
            for d, t in rows:
                best[t.lower()] = max(d, best.get(t.lower(), d))
            assert sorted(d for d, _ in pairs(out)) == sorted(best.values())
        elif name == "ngram_join":
            found = brute_components(rows, 5, 80, 100)
            assert sorted(d for d, _ in pairs(out)) == sorted({c for _, _, c in found})
            assert all(shingles(t, 5) for _, t in rows)
        else:
            got = out.groupBy("doc_id", "doc_tokens").sum("length").collect()
            assert {r["doc_id"] for r in got} == {d for d, _ in rows} and all(r["doc_tokens"] == r["sum(length)"] for r in got)
        path = f"{sf_dir}/out-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)


def test_awkward_rows_and_empty_tables(spark, tmp_path):
    for name, docs in (("some", awkward_docs(spark)), ("none", no_docs(spark))):
        d = str(tmp_path / name)
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(0, 1, 0), (3, 1, 0), (7, 0, 0), (None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        ids = {r.doc_id for r in CP.run(spark, d).collect()}
        assert ids <= {r.doc_id for r in docs.collect()} and bool(ids) == (name == "some")


def test_run(spark, sf_dir):
    assert CP.run(spark, sf_dir).select("doc_id").distinct().count() == spark.read.parquet(f"{sf_dir}/out-packing").select("doc_id").distinct().count()


def test_classifier_learns_from_what_the_rules_reject(spark, tmp_path):
    rng = random.Random(3)
    vocab = [f"{a}{b}" for a in ("ri", "sto", "wa", "the", "and") for b in ("ver", "ne", "ter", "re", "")]
    good = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = [(i, " ".join(good(100))) for i in range(80)]
    rows += [(100 + i, " ".join(w.upper() + "!!" for w in good(80))) for i in range(40)]  # labelled bad, rejected by the rules
    rows.append((300, " ".join(f"{w.upper()}{i}!!" for i, w in enumerate(good(80)))))  # bad, of rare words: the rules keep it
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 100), 0) for d, _ in rows if d < 200], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    first = CP.rules_stage(spark, docs, str(tmp_path))
    assert {d for d, _ in pairs(first)} == {*range(80), 300}
    assert {d for d, _ in pairs(CP.classifier_stage(spark, first, str(tmp_path)))} == set(range(80))

import hashlib
from collections import defaultdict

from llm.fixtures import awkward_docs, no_docs, pairs

from tessera.llm import exact_dedup as E


def normal(text):
    return (text or "").encode().lower()


def expected(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[normal(t)].append(d)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept_left = 1
        for d in ids:
            kept = d == keep and kept_left > 0
            kept_left -= kept
            out.append((d, keep, len(ids), kept, hashlib.sha256(t).hexdigest()))
    return sorted(out, key=str)


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    for size in (3, 64, 1024):  # deep recursion, and none
        got = sorted((tuple(r) for r in E.exact_duplicates(docs, block_bytes=size).collect()), key=str)
        assert got == expected(pairs(docs))


def test_empty_table(spark):
    assert E.exact_duplicates(no_docs(spark)).count() == 0


def test_blocks_do_not_blur_lengths(spark):
    texts = ["ab" * 8, "ab" * 16, "ab" * 15 + "a", "ab" * 8 + "\0", "ba" * 8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert all(r.group_size == 1 for r in E.exact_duplicates(docs, block_bytes=4).collect())


def test_rows_kept(spark):
    docs = awkward_docs(spark)
    kept = E.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    want = sorted((d, h) for d, _, _, k, h in expected(pairs(docs)) if k and d is not None)
    got = sorted((d, hashlib.sha256(normal(t)).hexdigest()) for d, t in pairs(kept) if d is not None)
    assert got == want


def test_names_are_dense_and_ordered(spark):
    df = spark.createDataFrame([(i, (i * 7) % 13) for i in range(500)], "doc_id bigint, k bigint")
    rows = E.dense_names(df, ["k"], ["doc_id"], ["doc_id", "k"], "test").collect()
    assert all(r.name == r.k for r in rows) and len(rows) == 500


def test_columns_of_any_name_come_back_unchanged(spark):
    rows = [(1, "a b", 78, "x", "r"), (2, "A B", 79, "y", "r"), (3, "c", 80, None, "r"), (3, "c", 80, None, "r")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _n bigint, _sha0 string, row string")
    assert sorted(map(tuple, E.drop_exact_duplicates(docs).collect())) == rows[1:3]


def test_runs_of_equal_blocks_that_cross_partitions(spark):
    texts = ["same" * 40, "other" * 30, "same" * 39 + "Same", "x"]
    rows = [(i, texts[i % 4]) for i in range(400)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = sorted((tuple(r) for r in E.exact_duplicates(docs, block_bytes=16).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == expected(rows)

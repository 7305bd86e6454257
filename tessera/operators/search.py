"""Exact nearest neighbours, radius search, cross checks, hash-bucket search and near-duplicate groups.

Queries are read in blocks of at most ``BLOCK`` vectors, a fixed size, and broadcast; each partition of the base
computes a block of distances with numpy and keeps its k best per query, so what is shuffled is k rows a query and
partition, and no pair of rows is ever joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 14
#: Codes of a block whose pairs with another block are one task's work.
TILE = 4096
#: Share of all pairs from which on to compare them all costs less than to join them by keys.
SELECTIVE = 1 / 256
#: Entries of a matrix of distances that is held at a time.
CELLS = 1 << 20


def _l2(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, ((q[:, None, :] - b[None]) ** 2).sum(-1)))


def _hellinger(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((np.sqrt(np.maximum(q, 0))[:, None] - np.sqrt(np.maximum(b, 0))[None]) ** 2).sum(-1)) / np.sqrt(2.0)


def _chi(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = q[:, None] + b[None]
    d = (q[:, None] - b[None]) ** 2
    return np.divide(d, s, out=np.zeros_like(d), where=s != 0).sum(-1)


def _cosine(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None]
    return np.where(n == 0, 1.0, np.clip(1 - np.divide(q @ b.T, n, out=np.zeros_like(n), where=n != 0), 0, 2))


METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "l2": _l2,
    "l1": lambda q, b: np.abs(q[:, None] - b[None]).sum(-1),
    "chebyshev": lambda q, b: np.abs(q[:, None] - b[None]).max(-1),
    "chi_square": _chi,
    "hellinger": _hellinger,
    "cosine": _cosine,
    "hamming": lambda q, b: np.bitwise_count(q.astype(np.int64)[:, None, :] ^ b.astype(np.int64)[None]).sum(-1).astype(float),
}


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries (id, vec) in blocks of at most BLOCK, read from the driver one block at a time."""
    ids: list[int] = []
    vecs: list[list[float]] = []
    for r in queries.orderBy("id").toLocalIterator():
        ids.append(r["id"])
        vecs.append(r["vec"])
        if len(ids) == BLOCK:
            yield np.array(ids), np.array(vecs, dtype=np.float64)
            ids, vecs = [], []
    if ids:
        yield np.array(ids), np.array(vecs, dtype=np.float64)


def _scan(queries: DataFrame, base: DataFrame, metric: str, skip_self: bool, k: int | None = None, pick: Callable[[np.ndarray], tuple] | None = None) -> DataFrame:
    """Of each query and task the ``k`` nearest rows, or those that ``pick`` chooses of each matrix of distances."""
    rows = lambda q, b, d: pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(d)], ["query_id", "nbr_id", "dist"])
    out = None
    for ids, vecs in _blocks(queries):
        block = base.sparkSession.sparkContext.broadcast((ids, vecs))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            q_ids, q = block.value
            step = max(1, (1 << 22) // max(1, len(q_ids) * q.shape[1]))
            best_d, best_id = np.empty((len(q_ids), 0)), np.empty((len(q_ids), 0), dtype=np.int64)
            for batch in batches:
                b_ids = batch.column(0).to_numpy()
                b = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b_ids), -1)
                for i in range(0, len(b_ids), step):
                    d = np.round(METRICS[metric](q, b[i : i + step]), 9)
                    if skip_self:
                        d[q_ids[:, None] == b_ids[None, i : i + step]] = np.inf
                    if k is None:
                        at = pick(d)
                        yield rows(q_ids[at[0]], b_ids[i : i + step][at[1]], d[at])
                    else:  # the task's k best so far, and these
                        best_d = np.concatenate([best_d, d], axis=1)
                        best_id = np.concatenate([best_id, np.broadcast_to(b_ids[i : i + step], d.shape)], axis=1)
                        order = np.lexsort((best_id, best_d), axis=1)[:, :k]
                        best_d, best_id = np.take_along_axis(best_d, order, 1), np.take_along_axis(best_id, order, 1)
            if k is not None:
                ok = np.isfinite(best_d)
                yield rows(np.broadcast_to(q_ids[:, None], best_d.shape)[ok], best_id[ok], best_d[ok])

        part = base.select("id", "vec").mapInArrow(run, "query_id bigint, nbr_id bigint, dist double")
        out = part if out is None else out.unionByName(part)
    return base.sparkSession.createDataFrame([], "query_id bigint, nbr_id bigint, dist double") if out is None else out


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", skip_self: bool = False) -> DataFrame:
    """(query_id, rank, nbr_id, dist): the k nearest rows of ``base(id, vec)`` of each row of ``queries(id, vec)``;
    ties go to the smaller id. Distances are rounded to 9 digits."""
    w = Window.partitionBy("query_id").orderBy("dist", "nbr_id")
    found = _scan(queries, base, metric, skip_self, k).withColumn("rank", F.row_number().over(w))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "nbr_id", "dist")


def radius(queries: DataFrame, base: DataFrame, r: float, metric: str = "l2", skip_self: bool = False) -> DataFrame:
    """(query_id, nbr_id, dist) of all rows within ``r``, inclusive."""
    return _scan(queries, base, metric, skip_self, pick=lambda d: np.nonzero(d <= r))


def ratio_test(matches: DataFrame, ratio: float) -> DataFrame:
    """Best matches whose distance is below ``ratio`` times that of the second best; ``matches`` as knn with k = 2."""
    w = Window.partitionBy("query_id").orderBy("rank")
    both = matches.withColumn("next", F.lead("dist").over(w)).where("rank = 1")
    return both.where(F.col("dist") < ratio * F.col("next")).select("query_id", "nbr_id", "dist")


def cross_check(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Best matches of ``forward`` that are each other's best in ``backward``."""
    best = backward.where("rank = 1").select(F.col("nbr_id").alias("query_id"), F.col("query_id").alias("nbr_id"))
    return forward.where("rank = 1").join(best, ["query_id", "nbr_id"], "left_semi").select("query_id", "nbr_id", "dist")


def hash_buckets(codes: DataFrame, bands: int, bits: int) -> DataFrame:
    """``codes(id, code)`` in one row per band: (band, key, id, code); key is the band's bits."""
    band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")
    rows = codes.select("id", "code", band)
    mask = (1 << bits) - 1
    return rows.withColumn("key", F.expr(f"shiftright(code, band * {bits}) & {mask}L"))


def band_keys(codes: DataFrame, bands: int, code_bits: int) -> DataFrame:
    """``codes(id, code)`` in one row per band: (id, code, band, key). The bands are disjoint and cover all bits; widths
    differ by one at most, and a band without bits (more bands than bits) has key 0."""
    cuts = [code_bits * i // bands for i in range(bands + 1)]
    keys = [F.shiftrightunsigned(F.shiftleft("code", 64 - hi), 64 - hi + lo) if hi > lo else F.lit(0).cast("bigint") for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return codes.select("id", "code", F.posexplode(F.array(*keys)).alias("band", "key"))


def _near_distinct(distinct: DataFrame, distance: int, code_bits: int) -> DataFrame:
    """``near_codes`` of distinct codes: by bands where a band's bits tell codes apart, else by tiles of all pairs."""
    if distance + 1 > SELECTIVE * 2 ** min(64, code_bits // (distance + 1)):
        return _near_tiles(distinct, distance)
    h = band_keys(distinct, distance + 1, code_bits)
    p, q = h.select("band", "key", F.col("id").alias("a"), F.col("code").alias("ca")), h.select("band", "key", F.col("id").alias("b"), F.col("code").alias("cb"))
    dist = F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")))
    return p.join(q, ["band", "key"]).where("a < b").withColumn("dist", dist).where(F.col("dist") <= distance).select("a", "b", "dist").distinct()


def _near_tiles(distinct: DataFrame, distance: int) -> DataFrame:
    """All pairs, in tasks that hold two blocks of some TILE codes each."""
    blocks = max(1, -(-distinct.count() // TILE))
    rows = distinct.select("id", "code", F.pmod(F.xxhash64("code"), F.lit(blocks)).alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other"))
    tiles = rows.select("id", "code", "_own", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"))

    def near(t: pa.Table) -> pa.Table:
        ids, code, own = (t.column(c).to_numpy() for c in ("id", "code", "_own"))
        code = code.view(np.uint64)  # bits of a negative number are counted of its absolute value
        lo, hi = t.column("_lo")[0].as_py(), t.column("_hi")[0].as_py()
        (p, cp), (q, cq) = ((ids[own == k], code[own == k]) for k in (lo, hi))
        out = []
        xor, bits = np.empty((16, len(q)), np.uint64), np.empty((16, len(q)), np.uint8)
        for i in range(0, len(p), 16):
            part = p[i : i + 16]
            d = np.bitwise_count(np.bitwise_xor(cp[i : i + 16, None], cq[None], out=xor[: len(part)]), out=bits[: len(part)])
            r, c = np.divmod(np.flatnonzero(d <= distance), len(q))
            left, right = part[r], q[c]
            ok = left < right if lo == hi else np.ones(len(r), dtype=bool)
            out.append((np.minimum(left, right)[ok], np.maximum(left, right)[ok], d[r, c][ok].astype(np.int32)))
        a, b, d = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (ids[:0], ids[:0], np.empty(0, np.int32))
        return pa.table({"a": a, "b": b, "dist": d})

    kind = distinct.schema["id"].dataType.simpleString()
    tasks = max(distinct.sparkSession.sparkContext.defaultParallelism * 4, min(2000, blocks * (blocks + 1) // 2))
    return tiles.repartition(tasks, "_lo", "_hi").groupBy("_lo", "_hi").applyInArrow(near, f"a {kind}, b {kind}, dist int")


def near_codes(codes: DataFrame, distance: int, code_bits: int = 64) -> DataFrame:
    """(a, b, dist) of pairs a < b of 64-bit codes within a Hamming distance: exact, as codes that differ in at most
    ``distance`` bits agree in one of ``distance + 1`` bands, and where bands are too narrow all pairs are compared, tile
    by tile. Of the rows of one code the first, by id, stands for all
    in the pairs with other codes; each other row has a pair with it, at distance 0."""
    distinct = codes.groupBy("code").agg(F.min("id").alias("id"))
    distinct = cut(distinct)
    copies = codes.join(distinct.withColumnRenamed("id", "a"), "code").where("id > a").select("a", F.col("id").alias("b"), F.lit(0).alias("dist")).distinct()
    return _near_distinct(distinct, distance, code_bits).unionByName(copies)


def near_groups(codes: DataFrame, distance: int, code_bits: int = 64) -> DataFrame:
    """(id, group_id) of every row of ``codes(id, code)``: the smallest id that is reachable over codes within a Hamming
    distance of each other. Groups are found of distinct codes and joined back, so copies make no edges."""
    distinct = codes.groupBy("code").agg(F.min("id").alias("id"))
    distinct = cut(distinct)
    groups = groups_of(_near_distinct(distinct, distance, code_bits), distinct)
    of = distinct.join(groups, "id").select("code", "group_id")
    return codes.join(of, "code").select("id", "group_id").distinct()


def lsh_knn(queries: DataFrame, base: DataFrame, k: int, bands: int, bits: int, flips: int = 0) -> DataFrame:
    """(query_id, rank, nbr_id, dist): the k nearest codes among those that share a band's bits but for at most
    ``flips`` of them; approximate. Queries look into all buckets whose key is so near theirs; the base is not copied."""
    masks = [sum(1 << b for b in some) for n in range(flips + 1) for some in combinations(range(bits), n)]
    q = hash_buckets(queries, bands, bits).withColumn("mask", F.explode(F.array(*(F.lit(m).cast("bigint") for m in masks))))
    q = q.select("band", F.col("key").bitwiseXOR(F.col("mask")).alias("key"), F.col("id").alias("query_id"), F.col("code").alias("cq"))
    b = hash_buckets(base, bands, bits).select("band", "key", F.col("id").alias("nbr_id"), F.col("code").alias("cb"))
    cand = q.join(b, ["band", "key"]).where("query_id <> nbr_id").select("query_id", "nbr_id", F.bit_count(F.col("cq").bitwiseXOR(F.col("cb"))).alias("dist")).distinct()
    w = Window.partitionBy("query_id").orderBy("dist", "nbr_id")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "nbr_id", "dist")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed, in the checkpoint folder; where there is none, with the executors."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def groups_of(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, group_id): the smallest id that is reachable over ``pairs(a, b)``, for all ``nodes(id)``. Rounds of minimum
    over neighbours with pointer jumping; each round is computed once and cut off."""
    labels = nodes.select("id", F.col("id").alias("group_id"))
    edges = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges, labels = cut(edges), cut(labels)
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("group_id").alias("m"))
        step = labels.join(near, "id", "left").select("id", F.least("group_id", F.coalesce("m", "group_id")).alias("group_id"), F.col("group_id").alias("old"))
        jump = step.select(F.col("id").alias("group_id"), F.col("group_id").alias("g2"))
        step = cut(step.join(jump, "group_id").select("id", F.col("g2").alias("group_id"), "old"))
        if step.where("group_id <> old").isEmpty():
            return step.select("id", "group_id")
        labels = step.select("id", "group_id")


def vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, predicted): the label most frequent among the neighbours; ties go to the smaller label."""
    v = neighbours.join(labels.select(F.col("id").alias("nbr_id"), "label"), "nbr_id").groupBy("query_id", "label").agg(F.count("*").alias("n"))
    return v.groupBy("query_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "label"))["label"].alias("predicted"))


def bits_of(img: Column, test: Callable[[Column, Column], Column], n: int = 64) -> Column:
    """A 64-bit code, first element highest: bit i is ``test(v, i)`` of the i-th element."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0).cast("bigint"), lambda a, i: F.shiftleft(a, 1).bitwiseOR(F.when(test(F.get(img, i), i), 1).otherwise(0).cast("bigint")))

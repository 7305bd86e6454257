"""Vector search and perceptual-hash queries on ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vector as V
from tessera.operators import search as S
from tessera.plans.common import IMG, images, table
from tessera.plans.registry import register


def _vecs(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda e: e.cast("double")).alias("vec"))


def _queries(s, d):
    return _vecs(s, d).where("id % 20 = 0")


_E = "e AS (SELECT vec_id, CAST(i AS INT) AS i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT range AS i FROM range(1, 65)) r)"
_DIST = {
    "l2": "sqrt(sum((q.v - b.v) * (q.v - b.v)))",
    "l1": "sum(abs(q.v - b.v))",
    "chebyshev": "max(abs(q.v - b.v))",
    "chi_square": "sum(CASE WHEN q.v + b.v = 0 THEN 0 ELSE (q.v - b.v) * (q.v - b.v) / (q.v + b.v) END)",
    "hellinger": "sqrt(sum(pow(sqrt(greatest(q.v, 0)) - sqrt(greatest(b.v, 0)), 2))) / sqrt(2::DOUBLE)",
    "cosine": "greatest(0, least(2, 1 - sum(q.v * b.v) / sqrt(sum(q.v * q.v) * sum(b.v * b.v))))",
}


def _pairs_sql(metric: str, which: str = "q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id") -> str:
    return f"{_E}, p AS (SELECT q.vec_id AS query_id, b.vec_id AS nbr_id, round({_DIST[metric]}, 9) AS dist FROM e q JOIN e b ON q.i = b.i WHERE {which} GROUP BY 1, 2)"


_TOP = "SELECT query_id, CAST(rank AS INT) AS rank, nbr_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, nbr_id) AS rank FROM p) t WHERE rank <= "


def _knn(metric: str):
    return lambda s, d: S.knn(_queries(s, d), _vecs(s, d), 5, metric, skip_self=True).withColumn("dist", F.round("dist", 6))


for _m in _DIST:
    if _m != "chi_square":  # of signed values it can cancel, and then the last digit decides ranks
        register(f"knn_{_m}", _knn(_m), f"WITH {_pairs_sql(_m)} {_TOP} 5")

register("knn_chi_square", lambda s, d: S.knn(_shift(_queries(s, d)), _shift(_vecs(s, d)), 5, "chi_square", skip_self=True).withColumn("dist", F.round("dist", 6)), f"WITH {_pairs_sql('chi_square').replace('CAST(embedding[i] AS DOUBLE) AS v', 'CAST(embedding[i] AS DOUBLE) + 1 AS v')} {_TOP} 5")


def _shift(df):
    return df.select("id", F.transform("vec", lambda v: v + 1).alias("vec"))


register("radius_l2", lambda s, d: S.radius(_queries(s, d), _vecs(s, d), 1.2, "l2", skip_self=True).withColumn("dist", F.round("dist", 6)), f"WITH {_pairs_sql('l2')} SELECT query_id, nbr_id, round(dist, 6) AS dist FROM p WHERE dist <= 1.2")
register("ratio_test", lambda s, d: S.ratio_test(S.knn(_queries(s, d), _vecs(s, d), 2, "l2", skip_self=True), 0.97).withColumn("dist", F.round("dist", 6)), f"WITH {_pairs_sql('l2')}, r AS (SELECT *, row_number() OVER w AS rank, lead(dist) OVER w AS nxt FROM p WINDOW w AS (PARTITION BY query_id ORDER BY dist, nbr_id)) SELECT query_id, nbr_id, round(dist, 6) AS dist FROM r WHERE rank = 1 AND dist < 0.97 * nxt")


def _cross(s, d):
    base = _vecs(s, d)
    there = S.cut(S.knn(_queries(s, d), base, 1, skip_self=True))  # read three times
    back = S.knn(base.join(there.select(F.col("nbr_id").alias("id")).distinct(), "id", "left_semi"), base, 1, skip_self=True)
    return S.cross_check(there, back).withColumn("dist", F.round("dist", 6))


def _best(pairs: str) -> str:
    return f"(SELECT query_id, nbr_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, nbr_id) AS r FROM {pairs}) t WHERE r = 1)"


register(
    "cross_check",
    _cross,
    f"WITH {_pairs_sql('l2')}, f AS {_best('p')}, p2 AS (SELECT q.vec_id AS query_id, b.vec_id AS nbr_id, round({_DIST['l2']}, 9) AS dist FROM e q JOIN e b ON q.i = b.i "
    f"WHERE q.vec_id IN (SELECT nbr_id FROM f) AND q.vec_id <> b.vec_id GROUP BY 1, 2), g AS {_best('p2')} SELECT f.query_id, f.nbr_id, round(f.dist, 6) AS dist FROM f JOIN g ON g.query_id = f.nbr_id AND g.nbr_id = f.query_id",
)
register("vector_distances", lambda s, d: _dists(s, d), f"WITH {_E} SELECT q.vec_id AS id, {', '.join(f'round({e}, 6) AS {n}' for n, e in _DIST.items() if n != 'chi_square')}, round(pow(sum(pow(abs(q.v - b.v), 3)), 1 / 3.0::DOUBLE), 6) AS minkowski FROM e q JOIN e b ON q.i = b.i AND b.vec_id = q.vec_id + 1 GROUP BY 1")


def _dists(s, d):
    a = _vecs(s, d)
    j = a.join(a.select((F.col("id") - 1).alias("id"), F.col("vec").alias("w")), "id")
    fs = {"l2": V.l2, "l1": V.l1, "chebyshev": V.chebyshev, "hellinger": V.hellinger, "cosine": V.cosine, "minkowski": lambda x, y: V.minkowski(x, y, 3.0)}
    return j.select("id", *(F.round(f(F.col("vec"), F.col("w")), 6).alias(n) for n, f in fs.items()))


def _knn_class(s, d):
    lab = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return S.vote(S.knn(_queries(s, d), _vecs(s, d), 7, "l2", skip_self=True), lab)


register("knn_classify", _knn_class, f"WITH {_pairs_sql('l2')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, nbr_id) AS rank FROM p), v AS (SELECT query_id, label, count(*) AS n FROM r JOIN embeddings ON vec_id = nbr_id WHERE rank <= 7 GROUP BY 1, 2) SELECT query_id, arg_min(label, (-n, label)) AS predicted FROM v GROUP BY 1")

# hashes: bit i is whether pixel i exceeds the mean (ahash), its right neighbour (dhash) or the median (mhash)
_AH = lambda s, d: images(s, d).withColumn("total", F.aggregate("img", F.lit(0), lambda a, v: a + v)).select(F.col("img_id").alias("id"), S.bits_of(F.col("img"), lambda v, i: v * 64 > F.col("total")).alias("code"))
_AHS = f"{IMG}, h AS (SELECT img_id AS id, string_agg(CASE WHEN 64 * v > t THEN '1' ELSE '0' END, '' ORDER BY y, x) AS bits FROM (SELECT *, sum(v) OVER (PARTITION BY img_id) AS t FROM img) z GROUP BY img_id)"
register("ahash", lambda s, d: _AH(s, d).select("id", F.lpad(F.bin("code"), 64, "0").alias("bits")), f"WITH {_AHS} SELECT id, bits FROM h")
register("ahash_pairs", lambda s, d: S.near_codes(_AH(s, d), 18), f"WITH {_AHS}, u AS (SELECT bits, min(id) AS id FROM h GROUP BY bits) SELECT a.id AS a, b.id AS b, CAST(hamming(a.bits, b.bits) AS INT) AS dist FROM u a JOIN u b ON a.id < b.id WHERE hamming(a.bits, b.bits) <= 18 UNION ALL SELECT u.id, h.id, 0 FROM u JOIN h ON h.bits = u.bits AND h.id > u.id")
register("dup_groups", lambda s, d: S.near_groups(_AH(s, d), 18), f"WITH RECURSIVE {_AHS}, u AS (SELECT bits, min(id) AS id FROM h GROUP BY bits), e AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND hamming(a.bits, b.bits) <= 18), r AS (SELECT id, id AS g FROM u UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id), l AS (SELECT id, min(g) AS group_id FROM r GROUP BY id) SELECT h.id, l.group_id FROM h JOIN u ON u.bits = h.bits JOIN l ON l.id = u.id")
register("lsh_knn", lambda s, d: S.lsh_knn(_AH(s, d).where("id % 20 = 0"), _AH(s, d), 3, 8, 8, 1), f"WITH {_AHS}, k AS (SELECT id, bits, CAST(b.range AS INT) AS band, substr(bits, CAST(1 + 8 * b.range AS BIGINT), 8) AS key FROM h, range(8) b), c AS (SELECT DISTINCT q.id AS query_id, b.id AS nbr_id, CAST(hamming(q.bits, b.bits) AS INT) AS dist FROM k q JOIN k b ON q.band = b.band AND hamming(q.key, b.key) <= 1 WHERE q.id % 20 = 0 AND q.id <> b.id) SELECT query_id, CAST(rank AS INT) AS rank, nbr_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, nbr_id) AS rank FROM c) t WHERE rank <= 3")
register("dhash", lambda s, d: images(s, d).select(F.col("img_id").alias("id"), F.lpad(F.bin(S.bits_of(F.col("img"), lambda v, i: F.coalesce(v < F.get("img", i + 1), F.lit(False)) & (i % 8 < 7))), 64, "0").alias("bits")), f"WITH {IMG} SELECT img_id AS id, string_agg(CASE WHEN x < 7 AND v < nxt THEN '1' ELSE '0' END, '' ORDER BY y, x) AS bits FROM (SELECT *, lead(v) OVER (PARTITION BY img_id ORDER BY y, x) AS nxt FROM img) z GROUP BY img_id")
register("mhash", lambda s, d: images(s, d).withColumn("mid", F.get(F.array_sort("img"), 32)).select(F.col("img_id").alias("id"), F.lpad(F.bin(S.bits_of(F.col("img"), lambda v, i: v > F.col("mid"))), 64, "0").alias("bits")), f"WITH {IMG}, m AS (SELECT img_id, list_sort(list(v))[33] AS mid FROM img GROUP BY 1) SELECT img_id AS id, string_agg(CASE WHEN v > mid THEN '1' ELSE '0' END, '' ORDER BY y, x) AS bits FROM img JOIN m USING (img_id) GROUP BY img_id")

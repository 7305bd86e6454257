"""Moments, texture, classification metrics, image quality and clustering steps as grouped aggregates.

All work on relations: pixels (img_id, y, x, v), labels, or packed vectors. Each is one aggregate that combines before
the shuffle, or a fixed number of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def raw_moments(px: DataFrame, keys: Sequence[str], order: int = 3) -> DataFrame:
    """m_pq for p + q <= order."""
    x, y, v = F.col("x").cast("double"), F.col("y").cast("double"), F.col("v")

    def term(p: int, q: int) -> Column:
        out = v.cast("double")
        for _ in range(p):
            out = out * x
        for _ in range(q):
            out = out * y
        return F.sum(out).alias(f"m{p}{q}")

    return px.groupBy(*keys).agg(*(term(p, q) for p in range(order + 1) for q in range(order + 1 - p)))


def central_moments(m: DataFrame) -> DataFrame:
    """mu_pq up to order 3 and the normalised nu_pq beside raw moments; null where the mass is 0."""
    m00 = F.nullif(F.col("m00"), F.lit(0.0))
    out = m.withColumns({"cx": F.col("m10") / m00, "cy": F.col("m01") / m00})
    c = lambda s: F.expr(s)
    out = out.withColumns({
        "mu20": c("m20 - cx * m10"), "mu11": c("m11 - cx * m01"), "mu02": c("m02 - cy * m01"),
        "mu30": c("m30 - 3 * cx * m20 + 2 * cx * cx * m10"), "mu21": c("m21 - 2 * cx * m11 - cy * m20 + 2 * cx * cx * m01"),
        "mu12": c("m12 - 2 * cy * m11 - cx * m02 + 2 * cy * cy * m10"), "mu03": c("m03 - 3 * cy * m02 + 2 * cy * cy * m01"),
    })
    two, three = m00 * m00, m00 * m00 * F.sqrt(m00)
    return out.withColumns({f"nu{p}{q}": F.col(f"mu{p}{q}") / (two if p + q == 2 else three) for p in range(4) for q in range(4) if p + q in (2, 3)})


def hu_moments(c: DataFrame) -> DataFrame:
    """h1..h7, the invariants of central moments."""
    n = lambda s: F.expr(s)
    p, q = "(nu30 + nu12)", "(nu21 + nu03)"
    return c.withColumns({
        "h1": n("nu20 + nu02"),
        "h2": n("(nu20 - nu02) * (nu20 - nu02) + 4 * nu11 * nu11"),
        "h3": n("(nu30 - 3 * nu12) * (nu30 - 3 * nu12) + (3 * nu21 - nu03) * (3 * nu21 - nu03)"),
        "h4": n(f"{p} * {p} + {q} * {q}"),
        "h5": n(f"(nu30 - 3 * nu12) * {p} * ({p} * {p} - 3 * {q} * {q}) + (3 * nu21 - nu03) * {q} * (3 * {p} * {p} - {q} * {q})"),
        "h6": n(f"(nu20 - nu02) * ({p} * {p} - {q} * {q}) + 4 * nu11 * {p} * {q}"),
        "h7": n(f"(3 * nu21 - nu03) * {p} * ({p} * {p} - 3 * {q} * {q}) - (nu30 - 3 * nu12) * {q} * (3 * {p} * {p} - {q} * {q})"),
    })


def glcm(img: DataFrame, keys: Sequence[str], cols: int, rows: int, dy: int, dx: int, symmetric: bool = True) -> DataFrame:
    """(keys..., i, j, p): co-occurrence of the levels of a packed image ``img`` at an offset, as shares."""
    at = F.posexplode("img").alias("_k", "i")
    y, x = F.floor(F.col("_k") / cols).cast("int"), F.col("_k") % cols
    long = img.select(*keys, "img", at)
    inside = (y + dy).between(0, rows - 1) & (x + dx).between(0, cols - 1)
    pairs = long.where(inside).select(*keys, "i", F.get("img", F.col("_k") + dy * cols + dx).alias("j"))
    if symmetric:
        pairs = pairs.unionByName(pairs.select(*keys, F.col("j").alias("i"), F.col("i").alias("j")))
    n = pairs.groupBy(*keys, "i", "j").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).drop("n")


def haralick(g: DataFrame, keys: Sequence[str]) -> DataFrame:
    """contrast, dissimilarity, homogeneity, asm, entropy (natural log) and correlation (0 without variance)."""
    p, i, j = F.col("p"), F.col("i").cast("double"), F.col("j").cast("double")
    d = i - j
    s = g.groupBy(*keys).agg(
        F.sum(p * d * d).alias("contrast"), F.sum(p * F.abs(d)).alias("dissimilarity"), F.sum(p / (1 + d * d)).alias("homogeneity"), F.sum(p * p).alias("asm"),
        (-F.sum(p * F.log(p))).alias("entropy"), F.sum(p * i).alias("_mi"), F.sum(p * j).alias("_mj"), F.sum(p * i * j).alias("_ij"), F.sum(p * i * i).alias("_ii"), F.sum(p * j * j).alias("_jj"),
    )
    var = F.sqrt(F.greatest(F.lit(0.0), F.col("_ii") - F.col("_mi") * F.col("_mi")) * F.greatest(F.lit(0.0), F.col("_jj") - F.col("_mj") * F.col("_mj")))
    corr = F.when(var < 1e-12, 0.0).otherwise((F.col("_ij") - F.col("_mi") * F.col("_mj")) / F.nullif(var, F.lit(0.0)))
    return s.withColumn("correlation", corr).drop("_mi", "_mj", "_ij", "_ii", "_jj")


def run_lengths(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., level, length, n): horizontal runs of equal v in a pixel relation."""
    w = Window.partitionBy(*keys, "y").orderBy("x")
    new = F.coalesce((F.col("v") != F.lag("v").over(w)).cast("int"), F.lit(1))
    runs = px.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = runs.groupBy(*keys, "y", "_run").agg(F.first("v").alias("level"), F.count("*").alias("length"))
    return one.groupBy(*keys, "level", "length").agg(F.count("*").alias("n"))


def run_features(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Emphases and non-uniformities of :func:`run_lengths`, and the share of runs in pixels; levels count from 0."""
    n, level, length = F.col("n").cast("double"), F.col("level") + 1, F.col("length")
    r = runs.withColumns({"_level": F.sum("n").over(Window.partitionBy(*keys, "level")), "_length": F.sum("n").over(Window.partitionBy(*keys, "length"))})
    total = F.sum(n)
    parts = {"short_run": n / (length * length), "long_run": n * length * length, "level_nonuniformity": n * F.col("_level"), "length_nonuniformity": n * F.col("_length"), "low_level": n / (level * level), "high_level": n * level * level}
    return r.groupBy(*keys).agg(*((F.sum(e) / total).alias(name) for name, e in parts.items()), (total / F.sum(n * length)).alias("run_percentage"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_scores(conf: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) for every label on either side; 0/0 is 0."""
    t = conf.select(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.when(F.col("truth") != F.col("predicted"), F.col("n")).otherwise(0).alias("fn"))
    p = conf.select(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.when(F.col("truth") != F.col("predicted"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("bigint").alias("fn"))
    s = t.unionByName(p).groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))
    s = s.withColumns({"precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn"))})
    total = F.col("precision") + F.col("recall")
    return s.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.nullif(total, F.lit(0.0))))


def roc_curve(df: DataFrame, score: str, truth: str) -> DataFrame:
    """(threshold, tpr, fpr), a point for each distinct score, highest first: running counts over distinct scores."""
    g = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(truth)).alias("p"), F.sum(1 - F.col(truth)).alias("q"))
    down = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(1))
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))
    return g.select("threshold", safe(F.sum("p").over(down), F.sum("p").over(every)).alias("tpr"), safe(F.sum("q").over(down), F.sum("q").over(every)).alias("fpr"))


def auc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """One row: the share of (positive, negative) pairs in order, ties a half."""
    g = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(truth)).alias("p"), F.sum(1 - F.col(truth)).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = g.withColumn("below", below).agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return r.select(F.when(F.col("p") * F.col("q") == 0, 0.0).otherwise(F.col("u") / F.nullif(F.col("p") * F.col("q"), F.lit(0))).alias("auc"))


def regression_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    e = F.col(truth).cast("double") - F.col(predicted)
    r = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(truth).alias("_v"))
    return r.select("mse", F.sqrt("mse").alias("rmse"), "mae", F.when(F.col("_v") == 0, 0.0).otherwise(1 - F.col("mse") / F.nullif(F.col("_v"), F.lit(0.0))).alias("r2"))


def image_quality(pairs: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """mse, mae, psnr (infinite for equal images) and global ssim of packed images; no shuffle."""
    n = F.size(a).cast("double")
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    prod = lambda p, q: total(F.zip_with(p, q, lambda x, y: (x * y).cast("double")))
    s = pairs.select(
        *keys, n.alias("n"), total(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("double"))).alias("se"), total(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))).alias("ae"),
        total(a).alias("sa"), total(b).alias("sb"), prod(F.col(a), F.col(a)).alias("aa"), prod(F.col(b), F.col(b)).alias("bb"), prod(F.col(a), F.col(b)).alias("ab"),
    )
    s = s.select(*keys, (F.col("se") / F.col("n")).alias("mse"), (F.col("ae") / F.col("n")).alias("mae"), *((F.col(c) / F.col("n")).alias(c) for c in ("sa", "sb", "aa", "bb", "ab")))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    va, vb, cov = F.col("aa") - F.col("sa") * F.col("sa"), F.col("bb") - F.col("sb") * F.col("sb"), F.col("ab") - F.col("sa") * F.col("sb")
    ssim = (2 * F.col("sa") * F.col("sb") + c1) * (2 * cov + c2) / ((F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb") + c1) * (va + vb + c2))
    psnr = F.when(F.col("mse") == 0, float("inf")).otherwise(10 * F.log10(65025.0 / F.nullif(F.col("mse"), F.lit(0.0))))
    return s.select(*keys, "mse", "mae", psnr.alias("psnr"), ssim.alias("ssim"))


def covariance(df: DataFrame, vec: str) -> DataFrame:
    """(i, j, cov) of a vector column, population covariance, i <= j: sums of products per pair of coordinates."""
    long = df.select(F.posexplode(vec).alias("i", "x"), F.col(vec).alias("_v"))
    pair = long.select("i", "x", F.posexplode("_v").alias("j", "y")).where("i <= j")
    return pair.groupBy("i", "j").agg((F.avg(F.col("x") * F.col("y")) - F.avg("x") * F.avg("y")).alias("cov"))


def kmeans_steps(df: DataFrame, centres: list[list[float]], steps: int, digits: int = 9) -> list[list[float]]:
    """Lloyd's iterations from given centres: each step is one aggregate; a centre without points stays. Ties go to the
    first centre."""
    dim = len(centres[0])
    for _ in range(steps):
        near = nearest_centre(df, centres)
        sums = near.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.get("vec", F.lit(i))).alias(f"s{i}") for i in range(dim)))
        for r in sums.collect():  # a row for each centre
            centres[r["cluster"]] = [round(r[f"s{i}"] / r["n"], digits) for i in range(dim)]
    return centres


def nearest_centre(df: DataFrame, centres: list[list[float]]) -> DataFrame:
    """``df`` with ``cluster``, the index of the nearest of a fixed list of centres."""
    lists = F.array(*(F.array(*(F.lit(float(v)) for v in c)) for c in centres))
    dist = F.transform(lists, lambda c: F.round(F.aggregate(F.zip_with(F.col("vec"), c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v), 9))
    return df.withColumn("_d", dist).withColumn("cluster", F.array_position("_d", F.array_min("_d")).cast("int") - 1).drop("_d")

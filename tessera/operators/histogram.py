"""Histograms, cumulative maps, automatic thresholds and histogram distances.

A histogram is the relation (group..., bin, n) with every bin present. Counting is one grouped aggregate that combines
before the shuffle; everything after works on at most ``bins`` rows a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(v: Column, bins: int, low: float, high: float) -> Column:
    """Equal-width bin; what lies outside goes to the first or last."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((v - low) * (bins / (high - low))))).cast("int")


def histogram(df: DataFrame, keys: Sequence[str], bin_col: Column, bins: int) -> DataFrame:
    counted = df.groupBy(*keys, bin_col.alias("bin")).agg(F.count("*").alias("n"))
    if not keys:
        every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
        return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    # one row a group with its bins as a map of bounded size, then every bin
    packed = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m"))
    full = packed.select(*keys, "_m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return full.select(*keys, "bin", F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0)).alias("n"))


def cumulative(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``hist`` with ``cdf`` (running count), ``total`` and ``first``, the first non-zero running count."""
    w = Window.partitionBy(*keys)
    out = hist.withColumn("cdf", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumns({"total": F.sum("n").over(w), "first": F.min(F.when(F.col("cdf") > 0, F.col("cdf"))).over(w)})


def equalize_map(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., bin, v): the equalised value of each of 256 bins; with one value only, the map is the identity."""
    spread = F.col("total") - F.col("first")
    v = F.when(spread == 0, F.col("bin")).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("cdf") - F.col("first")) * 255.0 / F.nullif(spread, F.lit(0)) + 0.5))).cast("int"))
    return cumulative(hist, keys).select(*keys, "bin", v.alias("v"))


def _moments(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    w = Window.partitionBy(*keys)
    s = F.col("bin") * F.col("n")
    return hist.withColumns({"w0": F.sum("n").over(up), "s0": F.sum(s).over(up), "w": F.sum("n").over(w), "s": F.sum(s).over(w)})


def otsu(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., t): the first bin that maximises the variance between the classes bin <= t and bin > t."""
    m = _moments(hist, keys).where("w0 > 0 and w0 < w")
    diff = F.col("s0").cast("double") / F.col("w0") - (F.col("s") - F.col("s0")).cast("double") / (F.col("w") - F.col("w0"))
    score = F.col("w0").cast("double") * (F.col("w") - F.col("w0")) * diff * diff
    return _best(m, keys, F.round(score, 6))


def _best(m: DataFrame, keys: Sequence[str], score: Column) -> DataFrame:
    out = m.groupBy(*keys) if keys else m.groupBy()
    return out.agg(F.max(F.struct(score.alias("a"), (-F.col("bin")).alias("b"))).alias("_x")).select(*keys, (-F.col("_x.b")).alias("t"))


def kapur(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., t): the first bin that maximises the sum of both classes' entropies."""
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    w = Window.partitionBy(*keys)
    p = F.col("n").cast("double") / F.sum("n").over(w)
    plogp = F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0)
    m = hist.withColumn("p", p).withColumn("e", plogp)
    m = m.withColumns({"p0": F.sum("p").over(up), "e0": F.sum("e").over(up), "e1": F.sum("e").over(w), "w0": F.sum("n").over(up), "w": F.sum("n").over(w)}).where("w0 > 0 and w0 < w")
    q0 = 1 - F.col("p0")
    score = F.log("p0") - F.col("e0") / F.col("p0") + F.log(q0) - (F.col("e1") - F.col("e0")) / q0
    return _best(m, keys, F.round(score, 9))


def yen(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., t): the first bin that maximises the correlation of both classes."""
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    w = Window.partitionBy(*keys)
    n = F.col("n").cast("double")
    m = hist.withColumns({"w0": F.sum(n).over(up), "q0": F.sum(n * n).over(up), "w": F.sum(n).over(w), "q": F.sum(n * n).over(w)}).where("w0 > 0 and w0 < w and q0 > 0 and q0 < q")
    rest = F.col("w") - F.col("w0")
    return _best(m, keys, F.round(2 * F.log(F.col("w0") * rest) - F.log(F.col("q0") * (F.col("q") - F.col("q0"))), 9))


def cross_entropy(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., t): the first bin that minimises the cross entropy of the histogram and its two class means; levels
    count from 1, so that black has a logarithm."""
    m = _moments(hist.withColumn("bin", F.col("bin") + 1), keys).where("w0 > 0 and w0 < w")
    s0, s1 = F.col("s0").cast("double"), (F.col("s") - F.col("s0")).cast("double")
    m = m.withColumns({"gain": s0 * F.log(s0 / F.col("w0")) + s1 * F.log(s1 / (F.col("w") - F.col("w0"))), "bin": F.col("bin") - 1})
    return _best(m, keys, F.round("gain", 6))


def minimum_error(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., t): the first bin at which two normal distributions explain the histogram best; both classes vary."""
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    w = Window.partitionBy(*keys)
    square = F.col("bin") * F.col("bin") * F.col("n")
    m = _moments(hist, keys).withColumns({"q0": F.sum(square).over(up), "q": F.sum(square).over(w)}).where("w0 > 0 and w0 < w")
    # n times the sum of squared differences from the mean: whole numbers
    d0 = F.col("w0") * F.col("q0") - F.col("s0") * F.col("s0")
    w1, s1 = F.col("w") - F.col("w0"), F.col("s") - F.col("s0")
    d1 = w1 * (F.col("q") - F.col("q0")) - s1 * s1
    m = m.withColumns({"d0": d0, "d1": d1, "w1": w1}).where("d0 > 0 and d1 > 0")
    cost = sum((F.col(a) * (F.log(F.sqrt(F.col(d).cast("double")) / F.col(a)) - F.log(F.col(a) / F.col("w"))) for a, d in (("w0", "d0"), ("w1", "d1"))), F.lit(0.0))
    return _best(m, keys, F.round(-cost / F.col("w"), 9))


def percentile_bin(hist: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """(keys..., t): the first bin at which the running count reaches ``share`` of all."""
    c = cumulative(hist, keys).where(F.col("cdf") >= share * F.col("total"))
    return (c.groupBy(*keys) if keys else c.groupBy()).agg(F.min("bin").alias("t"))


def isodata(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., t): the smallest bin t that is the rounded-down middle of the means below and above it, or failing
    that the one nearest to it."""
    m = _moments(hist, keys).where("w0 > 0 and w0 < w")
    mid = (F.col("s0").cast("double") / F.col("w0") + (F.col("s") - F.col("s0")).cast("double") / (F.col("w") - F.col("w0"))) / 2
    return _best(m, keys, -F.abs(F.floor(mid) - F.col("bin")).cast("double"))


def triangle(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., t): the bin farthest below the line from the peak to the farther end of the filled range."""
    w = Window.partitionBy(*keys)
    filled = F.when(F.col("n") > 0, F.col("bin"))
    m = hist.withColumns({"lo": F.min(filled).over(w), "hi": F.max(filled).over(w), "peak": -F.max(F.struct(F.col("n"), (-F.col("bin")).alias("b"))).over(w)["b"], "top": F.max("n").over(w)})
    left = F.col("peak") - F.col("lo") > F.col("hi") - F.col("peak")
    end = F.when(left, F.col("lo")).otherwise(F.col("hi"))
    m = m.withColumn("end", end).where("bin between least(peak, end) and greatest(peak, end)")
    # twice the area of the triangle peak, end, (bin, n), with n of the end taken as 0
    area = F.abs((F.col("end") - F.col("peak")) * (F.col("n") - F.col("top")) + F.col("top") * (F.col("bin") - F.col("peak")))
    return _best(m, keys, area.cast("double"))


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distances of two histograms (keys..., bin, n) bin by bin: correlation, chi_square, intersection, bhattacharyya,
    kl and emd. Bins that one side lacks count 0; without variance the correlation is 1."""
    j = a.withColumnRenamed("n", "p").join(b.withColumnRenamed("n", "q"), [*keys, "bin"], "full").select(*keys, "bin", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "pq"))
    w = Window.partitionBy(*keys)
    j = j.withColumns({"sp": F.sum("p").over(w), "sq": F.sum("q").over(w), "k": F.count("*").over(w)})
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumns({"up": F.sum(F.col("p") / F.col("sp") - F.col("q") / F.col("sq")).over(run), "dp": F.col("p") - F.col("sp") / F.col("k"), "dq": F.col("q") - F.col("sq") / F.col("k")})
    sp, sq = F.max("sp"), F.max("sq")
    var = F.sqrt(F.sum(F.col("dp") * F.col("dp")) * F.sum(F.col("dq") * F.col("dq")))
    x, y = F.col("p") / F.col("sp"), F.col("q") / F.col("sq")
    g = j.groupBy(*keys) if keys else j.groupBy()
    return g.agg(
        F.when(var == 0, 1.0).otherwise(F.sum(F.col("dp") * F.col("dq")) / F.nullif(var, F.lit(0.0))).alias("correlation"),
        F.sum(F.when(F.col("p") > 0, (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")) / F.nullif(F.col("p"), F.lit(0.0))).otherwise(0.0)).alias("chi_square"),
        F.sum(F.least("p", "q")).alias("intersection"),
        F.sqrt(F.greatest(F.lit(0.0), 1 - F.sum(F.sqrt(F.col("p") * F.col("q"))) / F.sqrt(sp * sq))).alias("bhattacharyya"),
        F.sum(F.when((F.col("p") > 0) & (F.col("q") > 0), x * F.log(x / F.nullif(y, F.lit(0.0)))).when(F.col("p") > 0, float("inf")).otherwise(0.0)).alias("kl"),
        F.sum(F.abs("up")).alias("emd"),
    )


def summary(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., mean, variance, peak): moments of the bins and the first fullest bin; null for an empty histogram."""
    n, b = F.col("n").cast("double"), F.col("bin")
    mean = F.sum(b * n) / F.nullif(F.sum(n), F.lit(0.0))
    var = F.sum(b * b * n) / F.nullif(F.sum(n), F.lit(0.0)) - mean * mean
    peak = F.when(F.max("n") > 0, -F.max(F.struct(F.col("n"), (-b).alias("b")))["b"])
    return (hist.groupBy(*keys) if keys else hist.groupBy()).agg(mean.alias("mean"), var.alias("variance"), peak.alias("peak"))


def back_project_map(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., bin, v): each bin's count, the fullest bin's being 255; all 0 for an empty histogram."""
    top = F.max("n").over(Window.partitionBy(*keys))
    v = F.coalesce(F.floor(F.col("n").cast("double") / F.nullif(top, F.lit(0)) * 255 + 0.5), F.lit(0)).cast("int")
    return hist.select(*keys, "bin", v.alias("v"))


def match_map(hist: DataFrame, target: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """(keys..., bin, v): the first bin of ``target`` at which its share of counts reaches that of ``hist`` at bin.
    Shares are compared as whole numbers. Groups without a target keep their bins."""
    run = cumulative(target, keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "cdf"))), lambda r: r["cdf"]).alias("_cdf"), F.max("total").alias("_total"))
    below = F.size(F.filter("_cdf", lambda c: c * F.col("total") < F.col("cdf") * F.col("_total")))
    v = F.when(F.col("_cdf").isNull(), F.col("bin")).otherwise(F.least(below, F.lit(bins - 1)))
    return cumulative(hist, keys).join(run, list(keys), "left").select(*keys, "bin", v.alias("v"))


def multi_otsu(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., t1, t2): the first pair of bins t1 < t2 that maximises the variance between three classes. Pairs are
    bounded by the square of the bins of a group."""
    m = _moments(hist, keys)
    a, b = m.select(*keys, F.col("bin").alias("t1"), F.col("w0").alias("wa"), F.col("s0").alias("sa")), m.withColumnRenamed("bin", "t2")
    j = a.join(b, list(keys)).where("t1 < t2 and wa > 0 and wa < w0 and w0 < w")
    part = lambda s, n: s.cast("double") * s / n
    c = F.col
    score = F.round((part(c("sa"), c("wa")) + part(c("s0") - c("sa"), c("w0") - c("wa")) + part(c("s") - c("s0"), c("w") - c("w0"))) / c("w"), 6)
    best = j.groupBy(*keys).agg(F.max(F.struct(score.alias("a"), (-c("t1")).alias("b"), (-c("t2")).alias("c"))).alias("_x"))
    return best.select(*keys, (-c("_x.b")).alias("t1"), (-c("_x.c")).alias("t2"))


def divergence(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., chi_square_alt, jensen_shannon) of two histograms bin by bin: symmetric distances, the second of shares
    in nats. Bins that one side lacks count 0."""
    j = a.withColumnRenamed("n", "p").join(b.withColumnRenamed("n", "q"), [*keys, "bin"], "full").select(*keys, "bin", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "pq"))
    w = Window.partitionBy(*keys)
    j = j.withColumns({"x": F.col("p") / F.nullif(F.sum("p").over(w), F.lit(0.0)), "y": F.col("q") / F.nullif(F.sum("q").over(w), F.lit(0.0))})
    mid = (F.col("x") + F.col("y")) / 2
    half = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / mid)).otherwise(0.0)
    alt = 2 * (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")) / F.nullif(F.col("p") + F.col("q"), F.lit(0.0))
    return (j.groupBy(*keys) if keys else j.groupBy()).agg(F.sum(F.coalesce(alt, F.lit(0.0))).alias("chi_square_alt"), (F.sum(half("x") + half("y")) / 2).alias("jensen_shannon"))

"""Is a subgraph like the whole? Two-sample statistics over complete distributions.

Samples come as one table (side 'a' or 'b', x double). Every statistic works on the histogram of
distinct values, summed up range by range, so no task sees all of them; of an empty sample they are null. P-values are two-sided and asymptotic: Kolmogorov's distribution,
the normal with correction for continuity and ties, and Fisher's F; they are worked out on the one row of the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import effect_label, relative_difference, verdict
from ..store import ship, with_row
from .metrics import cumulated, quantiles


def two_samples(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    pick = lambda d, s: d.select(F.lit(s).alias("side"), F.col(column).cast("double").alias("x")).where("x is not null")
    return pick(a, "a").union(pick(b, "b"))


#: Below this a difference counts as significant.
ALPHA = 0.05


def _table(both: DataFrame) -> DataFrame:
    """(x, na, nb, ca, cb) by distinct value, with sums up to and including it."""
    h = both.groupBy("x").agg(F.sum((F.col("side") == "a").cast("long")).alias("na"), F.sum((F.col("side") == "b").cast("long")).alias("nb"))
    return cumulated(h, "x", "na", "nb").select("x", "na", "nb", (F.col("na_before") + F.col("na")).alias("ca"), (F.col("nb_before") + F.col("nb")).alias("cb"))


def kolmogorov_sf(x: float) -> float:
    """P(K > x) of Kolmogorov's distribution."""
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * math.fsum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def f_sf(f: float, a: float, b: float) -> float:
    """P(F > f) with a and b degrees of freedom, by the continued fraction of the incomplete beta function."""
    if not f > 0:
        return 1.0
    x, p, q = b / (b + a * f), b / 2, a / 2
    if x > (p + 1) / (p + q + 2):
        return 1.0 - _beta(1 - x, q, p)
    return _beta(x, p, q)


def _beta(x: float, p: float, q: float) -> float:
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(x) + q * math.log1p(-x)) / p if x < 1 else 0.0
    tiny, c = 1e-300, 1.0
    d = 1 / ((1 - (p + q) * x / (p + 1)) or tiny)
    out = d
    for m in range(1, 500):
        for t in (m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / ((1 + t * d) or tiny), (1 + t / c) or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def _judged(row: DataFrame, p: Column, yes: str, no: str) -> DataFrame:
    return row.withColumn("p_value", p).withColumn("significant", F.col("p_value") < ALPHA).withColumn("interpretation", F.when(F.col("significant"), yes).otherwise(no))


def _of_row(spark, f) -> Callable[..., Column]:
    """A function of doubles for a row of results."""
    import pandas as pd

    ship(spark)

    @F.pandas_udf("double")
    def apply(rows):
        return pd.Series([None if any(x is None or x != x for x in row) else f(*row) for row in rows], dtype="float64")

    return lambda *columns: apply(F.array(*columns))


def ks_statistic(both: DataFrame) -> DataFrame:
    """Kolmogorov-Smirnov: ks, p_value, significant, interpretation."""
    t = _table(both)
    n = both.agg(F.sum((F.col("side") == "a").cast("long")).alias("ta"), F.sum((F.col("side") == "b").cast("long")).alias("tb"))
    row = with_row(t, n).agg(F.max(F.abs(F.try_divide("ca", "ta") - F.try_divide("cb", "tb"))).alias("ks"), F.first("ta").alias("ta"), F.first("tb").alias("tb"))
    size = F.sqrt(F.try_divide(F.col("ta") * F.col("tb"), F.col("ta") + F.col("tb")))
    return _judged(row, _of_row(both.sparkSession, kolmogorov_sf)(size * F.col("ks")), "Distributions differ", "Distributions similar").drop("ta", "tb")


def mann_whitney(both: DataFrame) -> DataFrame:
    """U of side a, with the mean rank for ties, its normal approximation z, p_value, significant, interpretation."""
    t = _table(both)
    n = F.col("na") + F.col("nb")
    before = F.col("ca") + F.col("cb") - n
    row = t.agg(F.sum(F.col("na") * (before + (n + 1) / 2)).alias("r"), F.sum("na").cast("double").alias("a"), F.sum("nb").cast("double").alias("b"), F.sum(F.pow(n.cast("double"), F.lit(3.0)) - n).alias("ties"))
    u = F.col("r") - F.col("a") * (F.col("a") + 1) / 2
    total = F.col("a") + F.col("b")
    var = F.col("a") * F.col("b") / 12 * (total + 1 - F.try_divide("ties", total * (total - 1)))
    off = u - F.col("a") * F.col("b") / 2
    row = row.select(u.alias("u"), F.when(var > 0, off / F.sqrt(var)).otherwise(0.0).alias("z"), F.when(var > 0, F.greatest(F.abs(off) - 0.5, F.lit(0.0)) / F.sqrt(var)).otherwise(0.0).alias("zc"))
    return _judged(row, _of_row(both.sparkSession, normal_two_sided)("zc"), "Central tendencies differ", "Central tendencies similar").drop("zc")


def levene(both: DataFrame) -> DataFrame:
    """Levene's W with medians as centres, p_value, significant, interpretation."""
    h = both.groupBy("side", "x").agg(F.count("*").alias("n"))
    centre = [h.where(F.col("side") == s).select("x", "n").transform(quantiles, "x", "n", {"m": 0.5}).select(F.lit(s).alias("side"), "m") for s in "ab"]
    z = h.join(F.broadcast(centre[0].union(centre[1])), "side").select("side", "n", F.abs(F.col("x") - F.col("m")).alias("z"))
    g = z.groupBy("side").agg(F.sum("n").cast("double").alias("n"), (F.sum(F.col("n") * F.col("z")) / F.sum("n")).alias("mean"), (F.sum(F.col("n") * F.col("z") * F.col("z")) / F.sum("n")).alias("square"))
    row = g.agg(F.sum("n").alias("total"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * (F.col("square") - F.col("mean") * F.col("mean"))).alias("within"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("sq"))
    between = F.col("sq") - F.col("total") * F.col("grand") * F.col("grand")
    row = row.select(F.when(F.col("within") > 0, F.try_divide((F.col("total") - F.col("k")) * between, (F.col("k") - 1) * F.col("within"))).alias("w"), (F.col("k") - 1.0).alias("a"), (F.col("total") - F.col("k")).cast("double").alias("b"))
    return _judged(row, _of_row(both.sparkSession, f_sf)("w", "a", "b"), "Variances differ", "Variances similar").drop("a", "b")


def cohens_d(both: DataFrame) -> DataFrame:
    """Difference of means over the pooled population deviation, and its size in words."""
    row = both.agg(*(f(F.when(F.col("side") == s, F.col("x"))).alias(f"{n}{s}") for s in "ab" for f, n in ((F.avg, "mean_"), (F.var_pop, "var_"))))
    pooled = F.sqrt((F.col("var_a") + F.col("var_b")) / 2)
    d = F.when(pooled > 0, (F.col("mean_a") - F.col("mean_b")) / pooled).otherwise(0.0)
    return row.select(d.alias("d"), effect_label(d).alias("effect"))


def metric_differences(full: DataFrame, sub: DataFrame) -> DataFrame:
    """(metric, full, sub, difference %) of two tables (metric, value)."""
    both = full.select("metric", F.col("value").alias("full")).join(sub.select("metric", F.col("value").alias("sub")), "metric")
    return both.withColumn("difference", relative_difference(F.col("full"), F.col("sub")))


def representativeness(differences: DataFrame) -> DataFrame:
    return differences.agg(F.avg("difference").alias("mean_difference")).withColumn("verdict", verdict(F.col("mean_difference")))


def size_ratios(full: DataFrame, sub: DataFrame) -> DataFrame:
    """Nodes and edges of the part over those of the whole; both are one-row graph_counts."""
    f, s = full.select(F.col("nodes").alias("fn"), F.col("edges").alias("fe")), sub.select(F.col("nodes").alias("sn"), F.col("edges").alias("se"))
    return with_row(f, s).select(F.try_divide("sn", "fn").alias("node_ratio"), F.try_divide("se", "fe").alias("edge_ratio"))


def benchmark_rollup(runs: DataFrame) -> DataFrame:
    """Of runs (cache_state, algorithm, ms, nodes): the fastest of each state and how much slower the others are."""
    best = runs.groupBy("cache_state").agg(F.min_by("algorithm", F.struct("ms", "algorithm")).alias("fastest"), F.min("ms").alias("best_ms"), F.min_by("nodes", F.struct("ms", "algorithm")).alias("best_nodes"))
    joined = runs.join(F.broadcast(best), "cache_state")  # a row for each cache state
    return joined.select("cache_state", "algorithm", "fastest", (F.col("ms") / F.col("best_ms")).alias("slowdown"), (F.col("nodes") / F.col("best_nodes")).alias("node_ratio"))

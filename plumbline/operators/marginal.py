"""Marginal and tail statistics of flat panels, and of pooled paths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import energy, ks, mean, order_statistics, quantiles, rows, with_overall
from ..sources.panels import REAL, SYNTHETIC, Flat, Paths, on


def marginal_ks(panel: Flat) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per feature; under 10 values on a side it is 1. Overall: the mean."""
    short = (F.col("n_real") < 10) | (F.col("n_syn") < 10)
    return with_overall(ks(panel.long()).select(F.col("feature").alias("key"), F.when(short, 1.0).otherwise(F.col("ks")).alias("value")))


def kolmogorov(x: Column, terms: int = 100) -> Column:
    """P(K > x) by the series 2 sum (-1)^(j-1) exp(-2 j^2 x^2); 1 for x under 0.2, where it is 1 to nine digits."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda acc, j: acc + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def marginal_ks_p_values(panel: Flat) -> DataFrame:
    """The asymptotic p-value of each feature's Kolmogorov-Smirnov statistic, 0 under 10 values on a side. Overall: the least."""
    n, m = F.col("n_syn").cast("double"), F.col("n_real").cast("double")
    short = (F.col("n_real") < 10) | (F.col("n_syn") < 10)
    p = F.when(short, 0.0).otherwise(kolmogorov(F.sqrt(n * m / (n + m)) * F.col("ks")))
    return with_overall(ks(panel.long()).select(F.col("feature").alias("key"), p.alias("value")), F.min("value"))


def energy_distance(panel: Flat, cap: int = 5000) -> DataFrame:
    """Energy distance of the first rows of each side over the real side's mean deviation."""
    first = panel.head(panel.df, cap).dropna(subset=list(panel.features)).withColumn("_id", F.struct(*panel.order))
    e = energy(first, panel.features).withColumn("value", F.when((F.col("n_syn") >= 50) & (F.col("n_real") >= 50), F.col("energy") / (F.col("scale") + 1e-10)))
    return rows(e, {"raw_energy": F.col("energy"), "scale": F.col("scale")}, F.col("value"))


def _tail_gap(panel: Flat, df: DataFrame, probs: tuple[float, ...], floor: bool, least: int) -> DataFrame:
    long = panel.long(df)
    q = quantiles(long, ["feature", "side"], probs)
    q = q.groupBy("feature").agg(F.max(on(REAL, F.col("q"))).alias("qr"), F.max(on(SYNTHETIC, F.col("q"))).alias("qs"), F.min("n").alias("n"))
    sd = long.where(F.col("side") == REAL).groupBy("feature").agg(F.stddev_pop("v").alias("sd"))
    scale = F.greatest(F.col("sd"), F.lit(1e-10)) if floor else F.col("sd") + 1e-12
    gap = sum((F.abs(F.col("qs")[i] - F.col("qr")[i]) for i in range(len(probs))), F.lit(0.0)) / len(probs) / scale
    return q.join(F.broadcast(sd), "feature").select(F.col("feature").alias("key"), F.when(F.col("n") < least, 1.0 if floor else None).otherwise(gap).alias("value"))


def tail_quantiles(panel: Flat, probs: tuple[float, ...] = (0.01, 0.05, 0.95, 0.99)) -> DataFrame:
    """Mean gap of tail quantiles over the real deviation; under 50 values it is 1."""
    return with_overall(_tail_gap(panel, panel.df, probs, True, 50))


def far_tail_quantiles(panel: Flat, probs: tuple[float, ...] = (0.005, 0.995)) -> DataFrame:
    """As tail_quantiles, farther out, over complete rows; NULL under 500 rows a side."""
    return with_overall(_tail_gap(panel, panel.complete(), probs, False, 500))


def tail_heaviness(panel: Flat) -> DataFrame:
    """Gap of excess kurtosis per feature; under 30 values, or undefined, it is 10."""
    a = panel.df.agg(*[g(on(s, F.col(f))).alias(f"{n}_{s}_{f}") for f in panel.features for s in (REAL, SYNTHETIC) for n, g in (("k", F.kurtosis), ("n", F.count))])
    item = lambda f: F.when((F.col(f"n_{REAL}_{f}") < 30) | (F.col(f"n_{SYNTHETIC}_{f}") < 30), 10.0).otherwise(F.coalesce(F.abs(F.col(f"k_{SYNTHETIC}_{f}") - F.col(f"k_{REAL}_{f}")), F.lit(10.0)))
    return rows(a, {f: item(f) for f in panel.features})


def marginal_skew(panel: Flat) -> DataFrame:
    """Gap of skewness per feature over complete rows; NULL under 30 rows."""
    a = panel.complete().agg(*[F.skewness(on(s, F.col(f))).alias(f"{s}_{f}") for f in panel.features for s in (REAL, SYNTHETIC)], *[F.count(on(s, F.lit(1))).alias(f"n_{s}") for s in (REAL, SYNTHETIC)])
    enough = F.least(f"n_{REAL}", f"n_{SYNTHETIC}") >= 30
    return rows(a, {f: F.when(enough, F.abs(F.coalesce(f"{SYNTHETIC}_{f}", F.lit(0.0)) - F.coalesce(f"{REAL}_{f}", F.lit(0.0)))) for f in panel.features})


def hill_tail_index(panel: Flat, tail: float = 0.05, least: int = 500) -> DataFrame:
    """Gap of the mean log excess over the (k+1)-th largest value, k = max(10, tail * n), averaged over both tails."""
    df = panel.finite()

    def places(n: int) -> list[int]:
        k = max(10, math.floor(n * tail))
        return [max(n - k - 1, 0), min(k, n - 1)]

    found = order_statistics(panel.long(df), ["side", "feature"], places)
    tails = [(f, t, sign) for f in panel.features for t, sign in (("upper", 1.0), ("lower", -1.0))]
    limits = []
    for s in (REAL, SYNTHETIC):
        n = {f: found.get((s, f), (0, [None, None])) for f in panel.features}
        limits.append((s, [n[f][0] for f, _, _ in tails], [None if (u := n[f][1][t == "lower"]) is None else sign * u for f, t, sign in tails]))
    limits = df.sparkSession.createDataFrame(limits, "side string, n array<bigint>, u array<double>")
    aggs, cells = [], []
    for i, (f, t, sign) in enumerate(tails):
        u, v = F.get("u", F.lit(i)), F.col(f) * sign
        above = (v > u) & (u > 1e-12)
        aggs += [F.count_if(above).alias(f"m{i}"), F.sum(F.when(above, F.log(v / u))).alias(f"h{i}")]
        cells.append(F.struct(F.lit(f"{f}|{t}").alias("g"), u.alias("u"), F.get("n", F.lit(i)).alias("n"), F.col(f"m{i}").alias("m"), (F.col(f"h{i}") / F.nullif(f"m{i}", F.lit(0))).alias("h")))
    sums = df.join(F.broadcast(limits), "side").groupBy("side").agg(*aggs)
    hill = sums.join(F.broadcast(limits), "side").select("side", F.explode(F.array(*cells)).alias("c")).select("side", "c.*")
    hill = hill.where(f"u > 1e-12 and m >= 5 and n >= {least}")
    two = hill.groupBy("g").agg(F.max(on(REAL, F.col("h"))).alias("r"), F.max(on(SYNTHETIC, F.col("h"))).alias("s")).where("r is not null and s is not null")
    return with_overall(two.groupBy(F.substring_index("g", "|", 1).alias("key")).agg(F.avg(F.abs(F.col("s") - F.col("r"))).alias("value")))


def _excess(c: Column) -> Column:
    return F.when(F.count(c) >= 4, F.coalesce(F.kurtosis(c), F.lit(-3.0))).otherwise(0.0)


def aggregational_gaussianity(paths: Paths, taus: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Gap of excess kurtosis of non-overlapping sums over tau steps."""
    h = paths.horizon()
    taus = tuple(t for t in taus if t <= h.get(REAL, 0))
    if not taus:
        raise ValueError("the real paths are shorter than any sum")
    whole = F.when(F.col("side") == REAL, h.get(REAL, 0)).otherwise(h.get(SYNTHETIC, 0))
    out = None
    for tau in taus:
        x = paths.df if tau == 1 else paths.df.where(F.col("t") < F.floor(whole / tau) * tau).groupBy("side", "path", F.floor(F.col("t") / tau).alias("b")).agg(*[F.sum(f).alias(f) for f in paths.features])
        a = x.agg(*[_excess(on(s, F.col(f))).alias(f"{s}_{f}") for f in paths.features for s in (REAL, SYNTHETIC)])
        cells = F.array(*[F.struct(F.lit(f"{f}@{tau}").alias("key"), F.abs(F.col(f"{SYNTHETIC}_{f}") - F.col(f"{REAL}_{f}")).alias("value")) for f in paths.features])
        one = a.select(F.explode(cells).alias("c")).select("c.key", "c.value")
        out = one if out is None else out.unionByName(one)
    return with_overall(out)


def conditional_heavy_tails(paths: Paths, window: int = 5) -> DataFrame:
    """Gap of excess kurtosis of returns over the deviation of the steps before."""
    if paths.horizon().get(SYNTHETIC, 0) < window + 3:
        raise ValueError("the synthetic paths are too short")
    w = paths.window().rowsBetween(-window, -1)
    x = paths.df.withColumns({f"_{f}": F.stddev_pop(f).over(w) for f in paths.features}).where(F.col("t") >= window)
    z = {f: F.when(F.col(f"_{f}") > 1e-12, F.col(f) / F.col(f"_{f}")) for f in paths.features}
    a = x.agg(*[_excess(on(s, z[f])).alias(f"{s}_{f}") for f in paths.features for s in (REAL, SYNTHETIC)])
    return rows(a, {f: F.abs(F.col(f"{SYNTHETIC}_{f}") - F.col(f"{REAL}_{f}")) for f in paths.features})


__all__ = ["aggregational_gaussianity", "conditional_heavy_tails", "energy_distance", "far_tail_quantiles", "hill_tail_index", "marginal_ks", "marginal_skew", "mean", "tail_heaviness", "tail_quantiles"]

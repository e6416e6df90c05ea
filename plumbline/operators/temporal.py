"""Dynamics of path panels: every plan is one sort by (side, path, t) and aggregates over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ks, local, mean, quantiles, rows, safe_corr
from ..sources.panels import REAL, SYNTHETIC, Flat, Paths, on
from .dependence import cross_correlation as _flat_cross


def _gap(one: DataFrame, keys: list[tuple[str, object]], by_feature: bool = True) -> DataFrame:
    """|synthetic - real| of columns `side|feature|lag`, averaged over lags to a row a feature, or a row each."""
    diff = lambda f, k: F.abs(F.col(f"{SYNTHETIC}|{f}|{k}") - F.col(f"{REAL}|{f}|{k}"))
    if not by_feature:
        return rows(one, {f"{f}@{k}": diff(f, k) for f, k in keys})
    return rows(one, {f: mean([diff(f, k) for g, k in keys if g == f]) for f in dict.fromkeys(f for f, _ in keys)})


def _acf(paths: Paths, lags: tuple[int, ...], power: int, horizon: int) -> DataFrame:
    if paths.horizon().get(SYNTHETIC, 0) < horizon:
        raise ValueError("the synthetic paths are too short")
    w = paths.window()
    whole = Window.partitionBy("side", "path")
    x = paths.df.withColumns({f: F.pow(f, power) for f in paths.features}) if power > 1 else paths.df
    x = x.withColumns({f: F.col(f) - F.avg(f).over(whole) for f in paths.features})
    x = x.withColumns({f"_{f}_{k}": F.col(f) * F.lead(f, k).over(w) for f in paths.features for k in lags})
    den = {f: F.sum(F.col(f) * F.col(f)) for f in paths.features}
    per = x.groupBy("side", "path").agg(*[F.when(den[f] < 1e-12, 0.0).otherwise(F.coalesce(F.sum(f"_{f}_{k}"), F.lit(0.0)) / F.when(den[f] >= 1e-12, den[f])).alias(f"{f}|{k}") for f in paths.features for k in lags])
    one = per.agg(*[F.avg(on(s, F.col(f"{f}|{k}"))).alias(f"{s}|{f}|{k}") for s in (REAL, SYNTHETIC) for f in paths.features for k in lags])
    return _gap(one, [(f, k) for f in paths.features for k in lags])


def _at_least(paths: Paths, steps: int) -> None:
    if paths.horizon().get(SYNTHETIC, 0) < steps:
        raise ValueError("the synthetic paths are too short")


def acf_returns(paths: Paths, lags: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Gap of mean autocorrelations of returns."""
    return _acf(paths, lags, 1, max(lags) + 5)


def volatility_clustering(paths: Paths, lags: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Gap of mean autocorrelations of squared returns."""
    return _acf(paths, lags, 2, max(lags) + 5)


def leverage_effect(paths: Paths, lags: tuple[int, ...] = (1, 2, 5, 10)) -> DataFrame:
    """Gap of the mean path correlation of a return with the later absolute return; paths with a constant side are left out."""
    _at_least(paths, max(lags) + 10)
    w = paths.window()
    x = paths.df.withColumns({f"_{f}_{k}": F.abs(F.lead(f, k).over(w)) for f in paths.features for k in lags})
    aggs = []
    for f in paths.features:
        for k in lags:
            a, b = F.when(F.col(f"_{f}_{k}").isNotNull(), F.col(f)), F.col(f"_{f}_{k}")
            sa, sb = F.stddev_pop(a), F.stddev_pop(b)
            aggs.append(F.when((sa >= 1e-10) & (sb >= 1e-10), F.covar_pop(a, b) / F.nullif(sa * sb, F.lit(0.0))).alias(f"{f}|{k}"))
    one = x.groupBy("side", "path").agg(*aggs).agg(*[F.coalesce(F.avg(on(s, F.col(f"{f}|{k}"))), F.lit(0.0)).alias(f"{s}|{f}|{k}") for s in (REAL, SYNTHETIC) for f in paths.features for k in lags])
    return _gap(one, [(f, k) for f in paths.features for k in lags])


def cross_correlation(paths: Paths) -> DataFrame:
    """Correlation gap of the pooled steps."""
    return _flat_cross(paths.flatten())


def variance_term_structure(paths: Paths) -> DataFrame:
    """Mean absolute log ratio over steps of the variance across paths of cumulative returns; both sides must have as many steps."""
    if len(set(paths.horizon().values())) > 1:
        raise ValueError("the sides' horizons differ")
    w = paths.window().rowsBetween(Window.unboundedPreceding, 0)
    cum = paths.df.withColumns({f: F.sum(f).over(w) for f in paths.features})
    per = cum.groupBy("t").agg(*[F.var_pop(on(s, F.col(f))).alias(f"{s}|{f}") for s in (REAL, SYNTHETIC) for f in paths.features])
    one = per.agg(*[F.avg(F.abs(F.log((F.col(f"{SYNTHETIC}|{f}") + 1e-12) / (F.col(f"{REAL}|{f}") + 1e-12)))).alias(f) for f in paths.features])
    return rows(one, {f: F.col(f) for f in paths.features})


def _thresholds(paths: Paths, q: float) -> DataFrame:
    """One row per side with the q-quantile of absolute returns of each feature as `_q_<feature>`."""
    flat = paths.flatten()
    long = Flat(paths.df.withColumns({f: F.abs(f) for f in paths.features}), flat.features, flat.order).long()
    return quantiles(long, ["side", "feature"], [q]).groupBy("side").agg(*[F.max(F.when(F.col("feature") == f, F.col("q")[0])).alias(f"_q_{f}") for f in paths.features])


def extreme_clustering(paths: Paths, q: float = 0.95) -> DataFrame:
    """Gap of the pooled lag-1 correlation of exceeding the side's own threshold."""
    with paths.held() as paths:
        w = paths.window()
        x = paths.df.join(F.broadcast(_thresholds(paths, q)), "side").withColumns({f: (F.abs(f) > F.col(f"_q_{f}")).cast("double") for f in paths.features})
        x = x.withColumns({f"_{f}": F.lead(f).over(w) for f in paths.features})
        one = local(x.agg(*[F.coalesce(safe_corr(on(s, F.col(f)), on(s, F.col(f"_{f}"))), F.lit(0.0)).alias(f"{s}|{f}|1") for s in (REAL, SYNTHETIC) for f in paths.features]))
    return _gap(one, [(f, 1) for f in paths.features])


def long_memory(paths: Paths, lags: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """Gap of the pooled correlation of absolute returns at long lags."""
    h = paths.horizon().get(REAL, 0)
    lags = tuple(k for k in lags if k < h - 2)
    if not lags:
        raise ValueError("no lag fits the horizon")
    w = paths.window()
    x = paths.df.withColumns({f: F.abs(f) for f in paths.features}).withColumns({f"_{f}_{k}": F.lead(F.abs(f), k).over(w) for f in paths.features for k in lags})
    one = x.agg(*[F.coalesce(safe_corr(on(s, F.col(f)), on(s, F.col(f"_{f}_{k}"))), F.lit(0.0)).alias(f"{s}|{f}|{k}") for s in (REAL, SYNTHETIC) for f in paths.features for k in lags])
    return _gap(one, [(f, k) for f in paths.features for k in lags], by_feature=False)


def time_reversal_asymmetry(paths: Paths, lags: tuple[int, ...] = (1, 2, 5)) -> DataFrame:
    """Gap of corr(r_t, |r_t+k|) - corr(r_t+k, |r_t|), pooled."""
    _at_least(paths, max(lags) + 2)
    w = paths.window()
    x = paths.df.withColumns({f"_{f}_{k}": F.lead(f, k).over(w) for f in paths.features for k in lags})

    def asym(s: str, f: str, k: int) -> Column:
        now, then = on(s, F.col(f)), on(s, F.col(f"_{f}_{k}"))
        return F.coalesce(safe_corr(now, F.abs(then)), F.lit(0.0)) - F.coalesce(safe_corr(then, F.abs(now)), F.lit(0.0))

    one = x.agg(*[asym(s, f, k).alias(f"{s}|{f}|{k}") for s in (REAL, SYNTHETIC) for f in paths.features for k in lags])
    return _gap(one, [(f, k) for f in paths.features for k in lags])


def regime_persistence(paths: Paths, q: float = 0.8) -> DataFrame:
    """Relative gap of the mean length of runs above the side's own threshold of absolute returns."""
    with paths.held() as paths:
        _at_least(paths, 5)
        w = paths.window()
        x = paths.df.join(F.broadcast(_thresholds(paths, q)), "side")
        x = x.withColumns({f: (F.abs(f) > F.col(f"_q_{f}")).cast("int") for f in paths.features})
        # a run begins where the step before is below; mean length = steps above / runs
        x = x.withColumns({f"_{f}": F.when((F.col(f) == 1) & (F.coalesce(F.lag(f).over(w), F.lit(0)) == 0), 1) for f in paths.features})
        one = local(x.agg(*[(F.coalesce(F.sum(on(s, F.col(f))), F.lit(0)) / F.nullif(F.count(on(s, F.col(f"_{f}"))), F.lit(0))).alias(f"{s}|{f}") for s in (REAL, SYNTHETIC) for f in paths.features]))
    value = lambda s, f: F.coalesce(F.col(f"{s}|{f}"), F.lit(0.0))
    return rows(one, {f: F.abs(value(SYNTHETIC, f) - value(REAL, f)) / (value(REAL, f) + 1e-9) for f in paths.features})


def drawdown_distribution(paths: Paths, least: int = 10) -> DataFrame:
    """Kolmogorov-Smirnov statistic of the paths' largest relative drawdowns; a feature with under 10 paths is 1 and not in the mean."""
    w = paths.window().rowsBetween(Window.unboundedPreceding, 0)
    x = paths.df.withColumns({f"_{f}": F.max(f).over(w) for f in paths.features})
    per = x.groupBy("side", "path").agg(*[F.max((F.col(f"_{f}") - F.col(f)) / F.greatest(F.col(f"_{f}"), F.lit(1e-10))).alias(f) for f in paths.features])
    flat = Flat(per, paths.features, ("path",))
    k = ks(flat.long().where(F.abs("v") != float("inf")))
    short = (F.col("n_real") < least) | (F.col("n_syn") < least)
    k = k.select(F.col("feature").alias("key"), F.when(short, 1.0).otherwise(F.col("ks")).alias("value"), short.alias("short"))
    return k.select("key", "value").unionByName(k.agg(F.avg(F.when(~F.col("short"), F.col("value"))).alias("value")).select(F.lit("overall").alias("key"), "value"))


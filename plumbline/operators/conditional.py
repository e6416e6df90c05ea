"""Regime-conditional statistics of paths and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import POINT_BYTES, distance, energy, first_rows, held, local, pair_sums, quantiles, rows
from ..sources.panels import REAL, Forecast, Paths
from . import calibration as cal


def regime_conditional(paths: Paths, n_regimes: int = 3, cap: int = 5000, weights: tuple[float, ...] = (0.25, 0.30, 0.45)) -> DataFrame:
    """Energy distance of the steps within regimes of realised volatility (edges from the real side), weighted, plus half the gap of the regimes' shares; a regime of under 50 rows on a side counts 1. Under 5 real paths a regime, or without a synthetic one, there is no overall value."""
    sq = sum((F.coalesce(F.col(f) * F.col(f), F.lit(0.0)) for f in paths.features), F.lit(0.0))
    n = sum((F.col(f).isNotNull().cast("int") for f in paths.features), F.lit(0))
    vol = paths.df.groupBy("side", "path").agg(F.sqrt(F.sum(sq) / F.nullif(F.sum(n), F.lit(0))).alias("v"))
    edges = quantiles(vol.where((F.col("side") == REAL) & F.col("v").isNotNull()).select(F.lit(1).alias("one"), "v"), ["one"], [i / n_regimes for i in range(1, n_regimes)]).select("q")
    binned = vol.join(F.broadcast(edges)).select("side", "path", F.when(F.col("v").isNull(), n_regimes - 1).otherwise(F.size(F.filter("q", lambda e: e <= F.col("v")))).alias("regime"))
    share = binned.groupBy("regime").agg(F.count_if(F.col("side") == REAL).alias("r"), F.count_if(F.col("side") != REAL).alias("s"))
    total = vol.agg(F.count_if(F.col("side") == REAL).alias("nr"), F.count_if(F.col("side") != REAL).alias("ns"), ((F.count(F.when(F.col("side") == REAL, F.col("v"))) >= 5 * n_regimes) & (F.count(F.when(F.col("side") != REAL, F.col("v"))) > 0)).alias("enough"))
    mass = share.join(F.broadcast(total)).agg((F.sum(F.abs(F.col("s") / F.col("ns") - F.col("r") / F.col("nr"))) / 2).alias("mass"), F.max("enough").alias("enough"))
    steps = paths.df.join(binned, ["side", "path"])
    first = first_rows(steps, ["side", "regime"], ["path", "t"], cap, "_id").dropna(subset=list(paths.features))
    e = energy(first, paths.features, ["regime"])
    e = e.select("regime", F.when((F.col("n_syn") < 50) | (F.col("n_real") < 50), 1.0).otherwise(F.col("energy") / (F.col("scale") + 1e-10)).alias("value"))
    one = e.agg(*[F.coalesce(F.max(F.when(F.col("regime") == i, F.col("value"))), F.lit(1.0)).alias(f"regime_{i}") for i in range(n_regimes)]).crossJoin(mass)
    w = [x / sum(weights) for x in weights]
    within = sum((F.col(f"regime_{i}") * w[i] for i in range(n_regimes)), F.lit(0.0))
    return rows(one, {**{f"regime_{i}": F.col(f"regime_{i}") for i in range(n_regimes)}, "mass_error": F.col("mass")}, F.when(F.col("enough"), within + 0.5 * F.col("mass")))


def _pools(fc: Forecast, axis: str, least: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """The actuals and the samples of each regime of at least `least` observations, capped in order; (label, _id, features). Where all caps together are within `POINT_BYTES`, they are computed once."""
    labels = fc.labels.where(F.col("axis") == axis).select("obs", "label")
    big = labels.join(fc.actuals.select("obs"), "obs").groupBy("label").count().where(F.col("count") >= least).select("label")
    labels = labels.join(F.broadcast(big), "label")

    def pool(df: DataFrame, order: list[str]) -> DataFrame:
        x = df.dropna(subset=list(fc.features)).join(labels, "obs")
        x = first_rows(x, ["label"], order, cap, "_id").select("label", "_id", *fc.features)
        return local(x) if fits else x

    fits = big.count() * cap * 8 * len(fc.features) <= POINT_BYTES

    return pool(fc.actuals, ["obs"]), pool(fc.samples, ["obs", "sample"])


def _between(pool: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """One row `d`: the mean raw energy distance over pairs of labels.

    Blocks of pairs of labels are dealt to the executors (`pair_sums`); a pool of more than
    `POINT_BYTES` is paired by a join instead, which Spark plans by the pool's size."""
    n = pool.groupBy("label").agg(F.count("*").alias("n"))
    if pool.count() * 8 * len(features) <= POINT_BYTES:
        sums = pair_sums(pool, "label", features)
        cross = sums.where("a <> b").select(F.col("a").alias("la"), F.col("b").alias("lb"), F.col("total").alias("xy"))
        inner = sums.where("a = b").select(F.col("a").alias("label"), F.col("total").alias("xx"))
    else:
        def joined(on, name: str) -> DataFrame:
            return pool.alias("a").join(pool.alias("b"), on).groupBy(F.col("a.label").alias("la"), F.col("b.label").alias("lb")).agg(F.sum(distance(features, "a", "b")).alias(name))

        cross = joined(F.col("a.label") < F.col("b.label"), "xy")
        inner = joined((F.col("a.label") == F.col("b.label")) & (F.col("a._id") < F.col("b._id")), "xx").select(F.col("la").alias("label"), "xx")
    n = n.join(inner, "label", "left").select("label", "n", (2 * F.coalesce("xx", F.lit(0.0)) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))).alias("self"))
    a, b = n.select(F.col("label").alias("la"), F.col("n").alias("na"), F.col("self").alias("sa")), n.select(F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("self").alias("sb"))
    e = cross.join(a, "la").join(b, "lb")
    return e.agg(F.avg(F.greatest(2 * F.col("xy") / (F.col("na") * F.col("nb")) - F.col("sa") - F.col("sb"), F.lit(0.0))).alias("d"))


def conditional_sensitivity(fc: Forecast, axis: str = "vol", least: int = 15, cap: int = 2000) -> DataFrame:
    """|log ratio| of how far apart the regimes' forecasts are to how far apart their actuals are; NULL where the actuals do not differ."""
    with fc.held():
        real, model = _pools(fc, axis, least, cap)
        both = local(_between(real, fc.features).withColumnRenamed("d", "d_real").crossJoin(_between(model, fc.features).withColumnRenamed("d", "d_model")))
    eps = F.lit(1e-9) + 1e-3 * F.col("d_real")
    value = F.when(F.col("d_real") >= 1e-9, F.abs(F.log((F.col("d_model") + eps) / (F.col("d_real") + eps))))
    return rows(both, {"d_real": F.col("d_real"), "d_model": F.col("d_model")}, value)


def multi_axis_sensitivity(fc: Forecast, axes: tuple[str, ...] | None = None) -> DataFrame:
    """conditional_sensitivity of each axis (all that the labels have unless given); overall: the worst."""
    axes = axes or tuple(r[0] for r in fc.labels.select("axis").distinct().orderBy("axis").collect())
    if not axes:
        raise ValueError("the labels have no axis")
    out = None
    with fc.held():
        for axis in axes:
            one = conditional_sensitivity(fc, axis).where("key = 'overall'").select(F.lit(f"conditional_sensitivity@{axis}").alias("key"), "value")
            out = one if out is None else out.unionByName(one)
    return out.unionByName(out.agg(F.max("value").alias("value")).select(F.lit("overall").alias("key"), "value"))


def stratified_calibration(fc: Forecast, axis: str = "vol", least: int = 15) -> DataFrame:
    """crps, pit_uniformity and coverage_90 of each regime with enough observations, and `gap`: how much worse the worst regime's crps is than the pooled one."""
    labels = fc.labels.where(F.col("axis") == axis).select("obs", "label")
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("y")) for f in fc.features])).alias("c")
    alpha = (1 - 0.9) / 2
    inside = ((F.col("y") >= cal.quantile_of("xs", alpha)) & (F.col("y") <= cal.quantile_of("xs", 1 - alpha))).cast("double")
    with fc.held(), held(cal._pit(cal.crps_cells(cal.cells(fc))).select("obs", "feature", "crps", "v", inside.alias("inside"))) as c:
        big = labels.join(fc.actuals.select("obs"), "obs").groupBy("label").count().where(F.col("count") >= least).select("label")
        labels = labels.join(F.broadcast(local(big)), "label")
        sd = fc.actuals.join(labels, "obs").select("label", long).groupBy("label", "c.feature").agg(F.stddev_pop("c.y").alias("sd"))
        with held(c.join(labels, "obs")) as by:
            per = by.groupBy("label", "feature").agg(F.avg("crps").alias("m"), F.abs(F.avg("inside") - 0.9).alias("g")).join(sd, ["label", "feature"])
            per = local(per.groupBy("label").agg(F.avg(F.col("m") / (F.col("sd") + 1e-10)).alias("crps"), F.avg("g").alias("coverage_90")))
            pit = local(cal._uniform_ks(by, ["label"]).select("label", F.col("ks").alias("value")))
        pooled = local(cal._over_deviation(fc, c).where("key = 'overall'").select(F.lit("pooled_crps").alias("key"), "value"))
    crps, cov = per.select("label", F.col("crps").alias("value")), per.select("label", F.col("coverage_90").alias("value"))
    gap = crps.agg(F.max("value").alias("worst")).crossJoin(pooled.select(F.col("value").alias("pooled"))).select(F.lit("gap").alias("key"), F.greatest(F.col("worst") - F.col("pooled"), F.lit(0.0)).alias("value"))
    out = pooled.unionByName(gap)
    for name, df in (("crps", crps), ("pit_uniformity", pit), ("coverage_90", cov)):
        out = out.unionByName(df.select(F.concat(F.lit(f"{name}@"), F.col("label")).alias("key"), "value"))
    return out


def within_regime_calibration_gap(fc: Forecast, axis: str = "vol") -> DataFrame:
    return stratified_calibration(fc, axis).where("key in ('gap', 'pooled_crps')").withColumn("key", F.when(F.col("key") == "gap", "overall").otherwise(F.col("key")))

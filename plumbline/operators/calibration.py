"""Calibration of forecast ensembles; all per observation and feature, grouped sorts only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import running, with_overall
from ..sources.panels import Forecast


def cells(fc: Forecast, keep: tuple[str, ...] = ()) -> DataFrame:
    """(obs, feature, xs sorted array, y): an ensemble beside what came true, once each is complete; keep: label columns by obs."""
    xs = fc.samples.groupBy("obs").agg(F.count("*").alias("n"), *[F.sort_array(F.collect_list(f)).alias(f"x_{f}") for f in fc.features])
    both = xs.join(fc.actuals, "obs")
    c = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"x_{f}").alias("xs"), F.col(f).alias("y")) for f in fc.features])
    return both.select("obs", "n", F.explode(c).alias("c")).where((F.size("c.xs") == F.col("n")) & F.col("c.y").isNotNull()).select("obs", "c.feature", "c.xs", "c.y")


def _pit(c: DataFrame) -> DataFrame:
    share = F.size(F.filter("xs", lambda x: x <= F.col("y"))) / F.size("xs")
    return c.withColumn("v", F.least(F.greatest(share, F.lit(1e-6)), F.lit(1 - 1e-6)))


def _uniform_ks(p: DataFrame, group: list[str]) -> DataFrame:
    """(group, ks) of v against the uniform distribution."""
    c = p.groupBy(*group, "v").agg(F.count("*").alias("c"))
    r = running(c, group, "v", ["c"], p).withColumnRenamed("c_all", "n")
    gap = F.greatest(F.col("c_to") / F.col("n") - F.col("v"), F.col("v") - (F.col("c_to") - F.col("c")) / F.col("n"))
    return r.groupBy(*group).agg(F.max(gap).alias("ks"))


def pit_uniformity(fc: Forecast, c: DataFrame | None = None) -> DataFrame:
    """Kolmogorov-Smirnov distance of the probability integral transforms from uniform; overall: pooled over features."""
    p = _pit(cells(fc) if c is None else c)
    both = p.select(F.explode(F.array("feature", F.lit("overall"))).alias("key"), "v")
    return _uniform_ks(both, ["key"]).select("key", F.col("ks").alias("value"))


def crps_cells(c: DataFrame) -> DataFrame:
    """c with `crps`, from the sorted ensemble."""
    n = F.size("xs")
    first = F.aggregate("xs", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("y"))) / n
    spread = F.aggregate(F.transform("xs", lambda x, i: (2.0 * (i + 1) - n - 1) * x), F.lit(0.0), lambda a, x: a + x)
    second = F.when(n > 1, 2.0 / (n * F.greatest(n - 1, F.lit(1))) * spread).otherwise(0.0)
    return c.withColumn("crps", F.greatest(first - 0.5 * second, F.lit(0.0)))


def crps(fc: Forecast, c: DataFrame | None = None) -> DataFrame:
    """Mean ranked probability score over the deviation of the actuals."""
    return _over_deviation(fc, crps_cells(cells(fc) if c is None else c))


def _over_deviation(fc: Forecast, c: DataFrame) -> DataFrame:
    """crps, of cells that have it."""
    sd = fc.actuals.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("y")) for f in fc.features])).alias("c")).groupBy("c.feature").agg(F.stddev_pop("c.y").alias("sd"))
    per = c.groupBy("feature").agg(F.avg("crps").alias("m")).join(F.broadcast(sd), "feature")
    return with_overall(per.select(F.col("feature").alias("key"), (F.col("m") / (F.col("sd") + 1e-10)).alias("value")))


def quantile_of(xs: str, p: float) -> object:
    """Linear quantile of a sorted array column."""
    place = (F.size(xs) - 1) * F.lit(p)
    lo = F.floor(place).cast("int")
    a, b = F.get(F.col(xs), lo), F.get(F.col(xs), F.least(lo + 1, F.size(xs) - 1))
    return a + (b - a) * (place - lo)


def coverage(fc: Forecast, level: float, c: DataFrame | None = None) -> DataFrame:
    """Per feature the share of actuals in the central interval; overall: mean over features of its distance from the level."""
    c = cells(fc) if c is None else c
    alpha = (1 - level) / 2
    inside = (F.col("y") >= quantile_of("xs", alpha)) & (F.col("y") <= quantile_of("xs", 1 - alpha))
    per = c.groupBy("feature").agg(F.avg(inside.cast("double")).alias("value")).select(F.col("feature").alias("key"), "value")
    return with_overall(per, F.avg(F.abs(F.col("value") - F.lit(level))))


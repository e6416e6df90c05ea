"""Baseline generators and bootstrap intervals. All draws are hashes of (seed, counters), so they can be repeated anywhere."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import bucketed, cuts, held, local, uniform
from ..sources.panels import Flat, Paths

#: Draws that a task of `bootstrap_ci` makes.
DRAWS_A_TASK = 2_000_000


def numbered(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """df with `idx` 0.. in order: rows are dealt to ranges of the first order column, numbered inside, and offset by the ranges before.

    Rows whose first order column equals a cut are a range of their own, which
    is dealt again by the second column, so a value that holds much of the table
    is no single task's."""
    lead = order[0]
    bounds = local(df.agg(cuts(lead).alias("_cuts")))  # found once: sketches merged in another order would cut elsewhere
    bounds = bounds.withColumn("_at", F.array_distinct(F.concat("_cuts.coarse", F.flatten("_cuts.fine"))))
    cut = bucketed(df.join(F.broadcast(bounds)), "_cuts", lead, "_b")
    cut = cut.withColumn("_b", 2 * F.col("_b") + F.coalesce(F.array_contains("_at", F.col(lead)), F.lit(False)).cast("int")).drop("_at")
    if len(order) > 1:
        again = local(cut.where(F.col("_b") % 2 == 1).groupBy("_b").agg(cuts(order[1]).alias("_cuts")))
        cut = bucketed(cut.join(F.broadcast(again), "_b", "left"), "_cuts", order[1], "_c").withColumn("_c", F.greatest("_c", F.lit(0)))
    else:
        cut = cut.withColumn("_c", F.lit(0))
    n = cut.groupBy("_b", "_c").agg(F.count("*").alias("_n"))
    off = n.select("_b", "_c", F.coalesce(F.sum("_n").over(Window.orderBy("_b", "_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_b", "_c").orderBy(*order)) - 1
    return cut.withColumn("_i", inside).join(off, ["_b", "_c"]).withColumn("idx", F.col("_i") + F.col("_o")).drop("_b", "_c", "_i", "_o")


def _place(seed: int, n: Column, *parts: Column | str) -> Column:
    return F.floor(uniform(seed, *parts) * n).cast("long")


def historical_bootstrap(real: DataFrame, features: tuple[str, ...], order: tuple[str, ...], n_samples: int, seed: int = 42) -> DataFrame:
    """n_samples rows drawn with replacement: (row, idx, features)."""
    base = numbered(real.select(*dict.fromkeys([*order, *features])), order).select("idx", *features)
    size = base.agg(F.count("*").alias("_n"))
    draws = real.sparkSession.range(n_samples).join(F.broadcast(size)).select(F.col("id").alias("row"), _place(seed, F.col("_n"), "id").alias("idx"))
    return draws.join(base, "idx").select("row", "idx", *features)


def block_bootstrap(real: DataFrame, features: tuple[str, ...], order: tuple[str, ...], n_paths: int, length: int, block: int = 20, seed: int = 42) -> DataFrame:
    """Paths of `length` steps put together from runs of `block` rows: (path, t, idx, features)."""
    base = numbered(real.select(*dict.fromkeys([*order, *features])), order).select("idx", *features)
    size = base.agg(F.count("*").alias("_n"))
    blocks = -(-length // block)
    draws = real.sparkSession.range(n_paths).select(F.col("id").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    starts = draws.join(F.broadcast(size)).where(F.col("_n") >= block).select("path", "b", _place(seed, F.col("_n") - block + 1, "path", "b").alias("s"))
    steps = starts.select("path", "b", "s", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("k")).select("path", (F.col("b") * block + F.col("k")).alias("t"), (F.col("s") + F.col("k")).alias("idx")).where(F.col("t") < length)
    return steps.join(base, "idx").select("path", "t", "idx", *features)


def normal(seed: int, *parts: Column | str) -> Column:
    """A standard normal by Box and Muller from two hashes."""
    u, v = uniform(seed, *parts, F.lit("u")), uniform(seed, *parts, F.lit("v"))
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * math.pi * v)


def gaussian_baseline(real: DataFrame, features: tuple[str, ...], n_samples: int, seed: int = 42, spark: SparkSession | None = None) -> DataFrame:
    """n_samples rows of the Gaussian with the features' means and sample covariance (over complete rows): (row, features)."""
    d = len(features)
    full = real.dropna(subset=list(features))
    aggs = [F.avg(f) for f in features]
    got = real.agg(*aggs).head()
    cov = full.agg(*[F.covar_samp(a, b) for a in features for b in features]).head()
    c = np.array([cov[i] for i in range(d * d)], float).reshape(d, d) + 1e-10 * np.eye(d)
    low = np.linalg.cholesky(c)
    z = [normal(seed, "id", F.lit(j)) for j in range(d)]
    cols = [(F.lit(float(got[i])) + sum((F.lit(float(low[i, j])) * F.col(f"_z{j}") for j in range(i + 1)), F.lit(0.0))).alias(f) for i, f in enumerate(features)]
    return (spark or real.sparkSession).range(n_samples).select(F.col("id").alias("row"), "id", *[x.alias(f"_z{j}") for j, x in enumerate(z)]).select("row", *cols)


def baseline(name: str, panel: Flat | Paths, n: int, seed: int = 42, block: int = 20) -> DataFrame:
    """A synthetic side by name, shaped as the panel's real side."""
    real = panel.df.where("side = 'real'")
    if isinstance(panel, Paths):
        h = panel.horizon()["real"]
        if name == "block_bootstrap":
            return block_bootstrap(real, panel.features, ("path", "t"), n, h, block, seed).select(F.lit("synthetic").alias("side"), "path", F.col("t").cast("int").alias("t"), *panel.features)
        if name == "gaussian":
            g = gaussian_baseline(real, panel.features, n * h, seed)
            return g.select(F.lit("synthetic").alias("side"), F.floor(F.col("row") / h).alias("path"), (F.col("row") % h).cast("int").alias("t"), *panel.features)
        raise ValueError(f"no path baseline {name!r}")
    if name in ("block_bootstrap", "historical"):
        return historical_bootstrap(real, panel.features, panel.order, n, seed).select(F.lit("synthetic").alias("side"), F.col("row").alias(panel.order[0]), *panel.features)
    if name == "gaussian":
        return gaussian_baseline(real, panel.features, n, seed).select(F.lit("synthetic").alias("side"), F.col("row").alias(panel.order[0]), *panel.features)
    raise ValueError(f"no baseline {name!r}")


def bootstrap_ci(df: DataFrame, order: tuple[str, ...], metric: Callable[[DataFrame], DataFrame], replicates: int = 200, block: int = 1, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(low, high, n) of a metric over resamples of both sides.

    All replicates are one plan: rows get a replicate number `rep`, and `metric`
    maps (rep, side, ...) to (rep, value). block: rows drawn together, 1 for
    independent draws; values that are not finite are skipped. There are
    `replicates` times as many draws as rows, so they are dealt to the rows by
    place and never sent to every task; a block is dealt as a whole."""
    spark = df.sparkSession
    with held(df) as df:
        sides = []
        for side in ("real", "synthetic"):
            base = numbered(df.where(F.col("side") == side), order)
            n = df.where(F.col("side") == side).count()
            per = -(-n // block)
            draws = spark.range(0, replicates * per, 1, max(1, -(-replicates * per // DRAWS_A_TASK))).select(F.expr(f"id div {max(per, 1)}").alias("rep"), F.expr(f"id % {max(per, 1)}").alias("j"))
            draws = draws.select("rep", "j", _place(seed, F.lit(max(n - block + 1, 1)), F.lit(side), "rep", "j").alias("s"))
            if block == 1:
                sides.append(draws.select("rep", F.col("s").alias("idx")).join(base.hint("shuffle_hash"), "idx").drop("idx"))
                continue
            # runs of `block` rows, of which a drawn block meets two at most
            runs = base.groupBy(F.expr(f"idx div {block}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", *df.columns))).alias("rows"))
            at, size = F.col("s") % block, F.least(F.lit(block), F.lit(n) - F.col("j") * block)
            first = F.least(size, block - at)
            parts = F.array(F.struct(F.expr(f"s div {block}").alias("run"), at.alias("at"), first.alias("size")), F.struct((F.expr(f"s div {block}") + 1).alias("run"), F.lit(0).cast("long").alias("at"), (size - first).alias("size")))
            draws = draws.select("rep", F.explode(parts).alias("p")).select("rep", "p.run", "p.at", "p.size").where("size > 0")
            drawn = draws.join(runs.hint("shuffle_hash"), "run").select("rep", F.explode(F.slice("rows", (F.col("at") + 1).cast("int"), F.col("size").cast("int"))).alias("r"))
            sides.append(drawn.select("rep", *[F.col("r")[c].alias(c) for c in df.columns]))
        values = metric(sides[0].unionByName(sides[1])).where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
        tail = (1 - level) / 2
        return local(values.agg(F.percentile("value", tail).alias("low"), F.percentile("value", 1 - tail).alias("high"), F.count("*").alias("n")))

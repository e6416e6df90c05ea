"""Coverage, plausibility and memorisation of generated paths or points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import blocks, first_rows, local, rows, tasks
from ..sources.panels import REAL, SYNTHETIC, Flat, Paths

CAP = 2000


def path_features(paths: Paths) -> DataFrame:
    """(side, path, cum_*, vol_*, mdd_*, skew_*): sum, deviation, deepest fall of the running sum, skewness."""
    w = paths.window()
    to = w.rowsBetween(Window.unboundedPreceding, 0)
    x = paths.df.withColumns({f"c_{f}": F.sum(f).over(to) for f in paths.features})
    x = x.withColumns({f"p_{f}": F.max(f"c_{f}").over(to) for f in paths.features})
    aggs = [F.coalesce(F.sum(f), F.lit(0.0)).alias(f"cum_{f}") for f in paths.features]
    aggs += [F.stddev_pop(f).alias(f"vol_{f}") for f in paths.features]
    aggs += [F.min(F.col(f"c_{f}") - F.col(f"p_{f}")).alias(f"mdd_{f}") for f in paths.features]
    aggs += [F.coalesce(F.skewness(f), F.lit(0.0)).alias(f"skew_{f}") for f in paths.features]
    return x.groupBy("side", "path").agg(*aggs)


def feature_names(paths: Paths) -> tuple[str, ...]:
    return tuple(f"{k}_{f}" for k in ("cum", "vol", "mdd", "skew") for f in paths.features)


def as_points(panel: Paths | Flat, cap: int = CAP) -> DataFrame:
    """Points standardised by the real side: (side, _id, v); paths by their path features; non-finite ones dropped, then the first `cap` of a side.

    A point is one array, so plans do not grow with the number of dimensions."""
    if isinstance(panel, Paths):
        panel = Flat(path_features(panel), feature_names(panel), ("path",))
    points = Flat(panel.df.select("side", *panel.order, F.array(*panel.features).alias("v")), ("v",), panel.order)
    fine = points.df.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) != float("inf"))))
    ident = F.row_number().over(Window.partitionBy("side").orderBy(*panel.order))
    first = local(points.head(fine, cap).select("side", ident.alias("_id"), "v"))
    per = first.where(F.col("side") == REAL).select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), (F.stddev_pop("x") + 1e-12).alias("d"))
    m = per.agg(F.sort_array(F.collect_list(F.struct("i", "m", "d"))).alias("k")).select(F.col("k.m").alias("m"), F.col("k.d").alias("d"))
    z = F.zip_with(F.zip_with("v", "m", lambda x, y: x - y), "d", lambda x, y: x / y)
    return first.join(F.broadcast(m)).select("side", "_id", z.alias("v"))


def _sides(x: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The capped points (side, v) of the real and of the synthetic side, as matrices; missing values are NaN. The points of a side must be of one length."""
    table, out = x.select("side", "v").toArrow(), []
    for name in (REAL, SYNTHETIC):
        v = table.filter(pc.equal(table.column("side"), name)).column("v").combine_chunks()
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(float)
        if len(v) and len(flat) != len(v) * len(v[0]):
            raise ValueError(f"the points of the {name} side are not of one length")
        out.append(flat.reshape(len(v), -1) if len(v) else np.zeros((0, 1)))
    return out[0], out[1]


def _nearest(spark: SparkSession, real: np.ndarray, syn: np.ndarray, run, schema: str, n: str) -> DataFrame:
    """run(rows, real, synthetic) over blocks of rows of one side (n), each held against both capped sides, which go to every task."""
    held = spark.sparkContext.broadcast((real, syn))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield run(batch.column(0).to_numpy(), *held.value)

    return tasks(spark, len(real) if n == REAL else len(syn), part, schema)


def _others(rows_: np.ndarray, real: np.ndarray, k: int) -> np.ndarray:
    """Distance of some real points to their k-th nearest other one; infinite where there are fewer."""
    out = np.full(len(rows_), np.inf)
    for at, d in blocks(real[rows_], real):
        d[np.arange(len(d)), rows_[at]] = np.inf
        if len(real) >= k:
            out[at] = np.partition(d, k - 1, axis=1)[:, k - 1]
    return out


def density_coverage(panel: Paths | Flat, k: int = 5, cap: int = CAP) -> DataFrame:
    """density: synthetic points inside the balls of real ones, over k and their number; coverage: balls that hold one. A ball reaches to the (k+1)-th nearest other real point."""
    x = as_points(panel, cap)
    real, syn = _sides(x)

    def run(rows_: np.ndarray, real: np.ndarray, syn: np.ndarray) -> pa.RecordBatch:
        radius, n = _others(rows_, real, k + 1), np.zeros(len(rows_), np.int64)
        for at, d in blocks(real[rows_], syn):
            n[at] = (d <= radius[at, None]).sum(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(n)], names=["n"])

    hits = _nearest(x.sparkSession, real, syn, run, "n long", REAL)
    one = hits.agg(F.sum("n").alias("n"), F.avg((F.col("n") > 0).cast("double")).alias("coverage"))
    density = F.col("n") / F.nullif(F.lit(k * len(syn)), F.lit(0))
    return rows(one, {"density": density, "coverage": F.col("coverage")}, F.col("coverage"))


def _deficit(panel: Paths | Flat, k: int, key: str) -> DataFrame:
    d = density_coverage(panel, k).where(F.col("key") == key)
    one = d.agg(F.max("value").alias("v"))
    return rows(one, {key: F.col("v")}, F.greatest(1 - F.col("v"), F.lit(0.0)))


def coverage_deficit(panel: Paths | Flat, k: int = 5) -> DataFrame:
    return _deficit(panel, k, "coverage")


def plausibility_deficit(panel: Paths | Flat, k: int = 5) -> DataFrame:
    return _deficit(panel, k, "density")


def enough_reference(n_real: int, dims: int, k: int = 5) -> bool:
    """Too few real points make both deficits not applicable."""
    return n_real >= max(k + 1, 3 * dims)


def memorization(paths: Paths, cap: int = CAP, least: int = 10) -> DataFrame:
    """1 less the ratio of the median distance of synthetic paths to their nearest real one to that among real paths, at least 0; and the share of synthetic paths nearer than the 5% quantile of the latter."""
    first = first_rows(paths.df.select("side", "path").distinct(), ["side"], ["path"], cap, "_n").select("side", "path")
    cell = F.struct("t", *paths.features)
    v = paths.df.join(F.broadcast(first), ["side", "path"]).groupBy("side", "path").agg(F.sort_array(F.collect_list(cell)).alias("v"))
    real, syn = _sides(v.select("side", F.flatten(F.transform("v", lambda c: F.array(*[c[f] for f in paths.features]))).alias("v")))
    if real.shape[1] != syn.shape[1] and len(real) and len(syn):
        raise ValueError("the sides' horizons differ")
    d = len(paths.features)
    if len(real):
        scale = np.tile(np.array([np.nanstd(real[:, j::d]) for j in range(d)]) + 1e-12, real.shape[1] // d)
        real, syn = real / scale, syn / scale if len(syn) else syn
    real, syn = (x[~np.isnan(x).any(axis=1)] for x in (real, syn))

    def among(rows_: np.ndarray, real: np.ndarray, syn: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(_others(rows_, real, 1))], names=["d"])

    def to_real(rows_: np.ndarray, real: np.ndarray, syn: np.ndarray) -> pa.RecordBatch:
        out = np.full(len(rows_), np.inf)
        for at, d in blocks(syn[rows_], real):
            out[at] = d.min(axis=1, initial=np.inf)
        return pa.RecordBatch.from_arrays([pa.array(out)], names=["d"])

    spark = paths.df.sparkSession
    rr, sr = _nearest(spark, real, syn, among, "d double", REAL), _nearest(spark, real, syn, to_real, "d double", SYNTHETIC)
    r = rr.agg(F.percentile("d", 0.5).alias("med_r"), F.percentile("d", 0.05).alias("q05"))
    s = sr.crossJoin(F.broadcast(r)).agg(F.percentile("d", 0.5).alias("med_s"), F.avg((F.col("d") < F.col("q05")).cast("double")).alias("near"), F.max("med_r").alias("med_r"), F.count("*").alias("n"))
    ratio = F.col("med_s") / (F.col("med_r") + 1e-12)
    return rows(s, {"nn_ratio": ratio, "near_duplicate_fraction": F.col("near")}, F.when(F.col("n") >= least, F.greatest(1 - ratio, F.lit(0.0))))


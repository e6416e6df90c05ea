"""Planted defects score worse than matched panels; equal panels score 0; kernels agree with numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.stats import first_rows, mid_ranks, quantiles, running, safe_corr
from plumbline.operators import baselines, calibration, conditional, dependence, generative, joint, marginal, temporal
from plumbline.plans import api
from plumbline.sources.panels import Flat, Forecast, Paths


def flat(spark, real, syn):
    rows = [("real", i, *map(float, r)) for i, r in enumerate(real)] + [("synthetic", i, *map(float, r)) for i, r in enumerate(syn)]
    names = [f"f{j}" for j in range(real.shape[1])]
    return Flat.of(spark.createDataFrame(rows, ["side", "row", *names]).repartition(4), names, ["row"])


def paths(spark, real, syn):
    rows = [(s, p, t, *map(float, x[p, t])) for s, x in (("real", real), ("synthetic", syn)) for p in range(x.shape[0]) for t in range(x.shape[1])]
    names = [f"f{j}" for j in range(real.shape[2])]
    return Paths.of(spark.createDataFrame(rows, ["side", "path", "t", *names]).repartition(4), names)


def value(df, key="overall"):
    return {r["key"]: r["value"] for r in df.collect()}[key]


@pytest.fixture(scope="module")
def panels(spark):
    g = np.random.default_rng(42)
    t5 = lambda n: np.stack([(x := g.standard_t(5, n) * 0.01), 0.7 * x + 0.3 * g.standard_t(5, n) * 0.01], axis=1)
    real = t5(800)
    return {"same": flat(spark, real, real).df.cache(), "matched": flat(spark, real, t5(800)), "scaled": flat(spark, real, t5(800) * 5), "loose": flat(spark, real, g.normal(0, 0.013, (800, 2)))}


def as_flat(df):
    return Flat.of(df, ("f0", "f1"), ("row",))


@pytest.mark.parametrize("metric", [marginal.marginal_ks, marginal.tail_quantiles, marginal.tail_heaviness, marginal.marginal_skew, marginal.far_tail_quantiles, marginal.hill_tail_index, dependence.pearson_corr, dependence.spearman_corr, dependence.copula_distance, dependence.tail_dependence_lower, dependence.correlation_breakdown, dependence.coskewness])
def test_equal_panels_are_perfect(panels, metric):
    assert value(metric(as_flat(panels["same"]))) == pytest.approx(0.0, abs=1e-9)


@pytest.mark.parametrize(("metric", "broken"), [(marginal.marginal_ks, "scaled"), (marginal.tail_quantiles, "scaled"), (marginal.energy_distance, "scaled"), (dependence.pearson_corr, "loose"), (dependence.copula_distance, "loose"), (joint.c2st, "scaled"), (dependence.variogram_score, "loose")])
def test_defects_score_worse(panels, metric, broken):
    assert value(metric(panels[broken])) > value(metric(panels["matched"]))


def test_dynamics(spark):
    g = np.random.default_rng(1)
    iid, ar = g.normal(0, 1, (40, 40, 2)), np.zeros((40, 40, 2))
    for t in range(1, 40):
        ar[:, t] = 0.8 * ar[:, t - 1] + g.normal(0, 1, (40, 2))
    good, bad = paths(spark, iid, g.normal(0, 1, (40, 40, 2))), paths(spark, iid, ar)
    for metric in (temporal.acf_returns, temporal.variance_term_structure, temporal.regime_persistence):
        assert value(metric(bad)) > value(metric(good))
    assert value(generative.memorization(paths(spark, iid, iid))) == pytest.approx(1.0, abs=1e-6)
    short = paths(spark, iid[:, :10], iid[:, :10])
    with pytest.raises(ValueError):
        temporal.acf_returns(short)
    r = api.validate_paths(short, metrics=("acf_returns", "cross_correlation"), include_flat=False)
    assert "too short" in r.metrics["acf_returns"].error and r.metrics["cross_correlation"].passed


def test_subwindow(spark):
    x = np.random.default_rng(2).normal(0, 1, (6, 25, 1))
    p = paths(spark, x, x)
    cut = p.subwindow(10)
    assert cut.df.where("side = 'real'").select("path").distinct().count() == 12 and cut.df.agg(F.max("t")).head()[0] == 9
    assert p.subwindow(25) is p and p.subwindow(None) is p
    r = api.validate_paths(p, metrics=("extreme_clustering", "drawdown_distribution"), include_flat=False, subwindow=10)
    assert r.metrics["extreme_clustering"].effective_n == 12 and r.metrics["drawdown_distribution"].effective_n == 6


def test_calibration(spark):
    g = np.random.default_rng(3)
    y = g.normal(0, 1, (150, 1))
    def fc(scale):
        s = [(i, j, float(v)) for i in range(150) for j, v in enumerate(g.normal(0, scale, 60))]
        labels = [(i, "vol", "a" if i % 2 else "b") for i in range(150)]
        return Forecast.of(spark.createDataFrame(s, "obs long, sample int, f0 double"), spark.createDataFrame([(i, float(v)) for i, v in enumerate(y[:, 0])], "obs long, f0 double"), ("f0",), spark.createDataFrame(labels, "obs long, axis string, label string"))
    good, narrow = fc(1.0), fc(0.3)
    assert 0.4 < value(calibration.crps(good)) < 0.75
    assert value(calibration.coverage(good, 0.9), "f0") > 0.8 > value(calibration.coverage(narrow, 0.9), "f0")
    assert value(calibration.pit_uniformity(narrow)) > value(calibration.pit_uniformity(good))
    report = api.validate_conditional(good)
    assert "conditional_sensitivity@vol" in report.metrics and report.metrics["within_regime_calibration_gap"].value >= 0
    assert set(api.validate_calibration(good).metrics) == {"pit_uniformity", "crps", "coverage_50", "coverage_90", "coverage_95"}


def test_crps_of_one_sample_is_the_error(spark):
    fc = Forecast.of(spark.createDataFrame([(1, 0, 3.0), (2, 0, 5.0)], "obs long, sample int, f0 double"), spark.createDataFrame([(1, 1.0), (2, 9.0)], "obs long, f0 double"), ("f0",))
    assert [r[0] for r in calibration.crps_cells(calibration.cells(fc)).orderBy("obs").select("crps").collect()] == [2.0, 4.0]


def test_collapse_and_far_points(spark):
    g = np.random.default_rng(4)
    centres = np.array([[0, 0], [6, 6], [-6, 6]])
    real = centres[g.integers(0, 3, 150)] + g.normal(0, 0.3, (150, 2))
    fine = centres[g.integers(0, 3, 150)] + g.normal(0, 0.3, (150, 2))
    assert value(generative.coverage_deficit(flat(spark, real, fine))) < value(generative.coverage_deficit(flat(spark, real, g.normal(0, 0.3, (150, 2)))))
    assert value(generative.plausibility_deficit(flat(spark, real, real + 25))) == 1.0
    few = api.validate_generative(flat(spark, real[:5], fine))
    assert not few.metrics["coverage_deficit"].applicable


def test_regime_conditional_numbers(spark):
    g = np.random.default_rng(5)
    x = np.concatenate([g.normal(0, 0.01, (60, 12, 2)), g.normal(0, 0.05, (60, 12, 2))])
    y = g.normal(0, 0.03, (120, 12, 2))
    assert value(conditional.regime_conditional(paths(spark, x, x))) == pytest.approx(0.0, abs=1e-6)
    assert value(conditional.regime_conditional(paths(spark, x, y))) > 0.2


def test_kernels_against_numpy(spark):
    g = np.random.default_rng(6)
    v = np.concatenate([g.integers(0, 30, 500).astype(float), g.normal(0, 5, 501)])
    df = spark.createDataFrame([("real", float(x)) for x in v], "side string, f0 double").repartition(5)
    q = quantiles(df.select("side", F.col("f0").alias("v")), ["side"], [0.0, 0.1, 0.5, 0.999, 1.0]).head()["q"]
    assert np.allclose(q, np.quantile(v, [0.0, 0.1, 0.5, 0.999, 1.0]))
    ranks = sorted(r["f0"] for r in mid_ranks(df, ("f0",)).collect())
    order = np.sort(v)
    assert np.allclose(ranks, sorted((np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") + 1) / 2 for x in v))
    assert df.select(F.lit(1.0).alias("c"), "f0").agg(safe_corr(F.col("c"), F.col("f0"))).head()[0] is None


def test_running_sums_with_a_hot_value(spark):
    g = np.random.default_rng(9)
    v = np.concatenate([np.full(700, 3.0), g.normal(0, 9, 1300)])
    long = spark.createDataFrame([("a" if i % 3 else "b", float(x)) for i, x in enumerate(v)], "g string, v double").repartition(5)
    got = running(long.groupBy("g", "v").agg(F.count("*").alias("c")), ["g"], "v", ["c"], long).collect()
    of = {k: np.array([x for i, x in enumerate(v) if ("a" if i % 3 else "b") == k]) for k in "ab"}
    assert len(got) == sum(len(np.unique(x)) for x in of.values())
    assert all(r["c_to"] == (of[r["g"]] <= r["v"]).sum() and r["c_all"] == len(of[r["g"]]) for r in got)


def test_first_rows_of_hot_groups(spark):
    rows = [("hot" if i % 4 else "rare", (i * 37) % 1000, i) for i in range(1000)]
    got = first_rows(spark.createDataFrame(rows, "g string, k int, i int").repartition(6), ["g"], ["k"], 300, "n").collect()
    want = [(g, k, n + 1) for g in ("hot", "rare") for n, k in enumerate(sorted(k for h, k, _ in rows if h == g)[:300])]
    assert sorted((r["g"], r["k"], r["n"]) for r in got) == sorted(want)


@pytest.mark.parametrize("order", [("a", "b"), ("b",)])
def test_numbered_with_a_hot_lead(spark, order):
    rows = [(7 if i % 3 else i % 50, i) if i else (None, i) for i in range(2000)]
    got = baselines.numbered(spark.createDataFrame(rows, "a int, b int").repartition(6), order).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) if order == ("a", "b") else sorted(rows, key=lambda r: r[1])
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["idx"])] == want and sorted(r["idx"] for r in got) == list(range(2000))


def test_missing_values(spark):
    rows = [(s, i, float("nan") if i % 7 == 0 else float(i % 11), None if i % 5 == 0 else float(i % 13)) for s in ("real", "synthetic") for i in range(200)]
    p = Flat.of(spark.createDataFrame(rows, "side string, row int, f0 double, f1 double"), ("f0", "f1"), ("row",))
    for m in (marginal.marginal_ks, marginal.tail_quantiles, dependence.pearson_corr, dependence.spearman_corr):
        assert value(m(p)) == pytest.approx(0.0, abs=1e-9)
    with pytest.raises(ValueError, match="2D"):
        Flat.of(p.df, ("f0", "f9"), ("row",))
    with pytest.raises(ValueError, match="3D"):
        Paths.of(p.df, ("f0",))


def test_baselines(spark):
    g = np.random.default_rng(7)
    p = flat(spark, g.normal(1, 2, (300, 2)), g.normal(1, 2, (50, 2)))
    real = p.side("real")
    one, two = (baselines.historical_bootstrap(real, p.features, p.order, 100).collect() for _ in range(2))
    assert sorted(one) == sorted(two) and len(one) == 100
    b = baselines.block_bootstrap(real, p.features, p.order, 5, 50, 20).collect()
    assert sorted((r["path"], r["t"]) for r in b) == [(i, t) for i in range(5) for t in range(50)]
    assert all(y["idx"] == x["idx"] + 1 for x, y in zip(sorted(b, key=lambda r: (r["path"], r["t"])), sorted(b, key=lambda r: (r["path"], r["t"]))[1:], strict=False) if y["t"] % 20 and y["path"] == x["path"])
    z = baselines.gaussian_baseline(real, p.features, 4000).agg(F.avg("f0"), F.stddev("f1")).head()
    assert abs(z[0] - 1) < 0.3 and abs(z[1] - 2) < 0.3
    with pytest.raises(ValueError):
        baselines.baseline("other", p, 10)
    gap = lambda df: df.groupBy("rep").agg((F.avg(F.when(F.col("side") == "real", F.col("f0"))) - F.avg(F.when(F.col("side") != "real", F.col("f0")))).alias("value"))
    ci = baselines.bootstrap_ci(p.df, p.order, gap, replicates=30, block=5).head()
    assert ci["low"] <= ci["high"] and ci["n"] == 30


def test_reports(panels):
    r = api.validate(panels["matched"], metrics=("marginal_ks", "pearson_corr", "no_such"))
    assert set(r.metrics) == {"marginal_ks", "pearson_corr"} and r.metrics["marginal_ks"].effective_n == 800 and r.overall_score > 0.6
    assert api.validate(panels["matched"], metrics=("nothing",)).overall_score == 0.0
    out = api.validate_against_baselines(panels["scaled"], names=("gaussian",), metrics=("marginal_ks",))
    assert out["gaussian"]["n_worse"] == 1
    assert set(api.random_split_floor(panels["matched"], ("marginal_ks",))) == {"marginal_ks"}


def test_monitor(spark, tmp_path):
    from plumbline.streaming.monitor import monitor

    g = np.random.default_rng(8)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(g.normal(0, 1, 200))], "row long, f0 double")
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    q = monitor(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), df, ("f0",), ("row",), lambda rows, i: seen.extend(rows.collect()), str(tmp_path / "cp"), metrics=("marginal_ks",))
    q.awaitTermination(60)
    assert {r["key"] for r in seen} == {"f0", "overall"} and all(r["value"] == 0 for r in seen)

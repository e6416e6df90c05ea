"""Panels are computed once for all that is done with them; exact places and correlations by counts and blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import stats
from plumbline.operators import conditional, temporal
from plumbline.plans import api
from plumbline.sources.panels import Forecast, Paths


def counted(spark, df):
    """df, and how many of its rows have been computed."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


@pytest.fixture(scope="module")
def forecast(spark):
    def make():
        g = np.random.default_rng(5)
        obs = range(90)
        actual, a = counted(spark, spark.createDataFrame([(i, float(g.normal(3 * (i % 3), 1))) for i in obs], "obs long, x double"))
        sample, s = counted(spark, spark.createDataFrame([(i, k, float(g.normal(3 * (i % 3), 1))) for i in obs for k in range(5)], "obs long, sample long, x double"))
        labels = spark.createDataFrame([(i, n, f"r{(i + j) % 3}") for i in obs for j, n in enumerate(("shock", "vol"))], "obs long, axis string, label string")
        return Forecast.of(sample, actual, ["x"], labels), a, s

    return make


@pytest.mark.parametrize("run", [lambda f: conditional.multi_axis_sensitivity(f).collect(), lambda f: conditional.within_regime_calibration_gap(f).collect(), api.validate_conditional, api.validate_calibration])
def test_forecasts_once(forecast, run):
    fc, actuals, samples = forecast()
    run(fc)
    assert actuals.value == 90 and samples.value == 450
    assert not fc.samples.storageLevel.useMemory


@pytest.mark.parametrize("run", [temporal.regime_persistence, temporal.extreme_clustering, lambda p: api.validate_paths(p, ["acf_returns", "regime_persistence"], include_flat=False)])
def test_paths_once(spark, run):
    g = np.random.default_rng(6)
    df, seen = counted(spark, spark.createDataFrame([(s, p, t, float(g.normal())) for s in ("real", "synthetic") for p in range(6) for t in range(40)], "side string, path long, t int, x double"))
    got = run(Paths.of(df, ["x"]))
    assert (got.count() if hasattr(got, "count") else len(got.metrics)) == 2
    assert seen.value == 480


@pytest.mark.parametrize("grid", [400, 3])
def test_places_are_exact(spark, monkeypatch, grid):
    monkeypatch.setattr(stats, "GRID", grid)
    g = np.random.default_rng(7)
    x = {"a": g.normal(0, 1, 3001), "b": np.round(g.normal(0, 1, 500), 1), "c": np.array([2.0]), "d": np.full(40, 0.1), "e": np.concatenate([g.normal(0, 1, 300), [-np.inf, np.inf, np.inf]])}
    long = spark.createDataFrame([(k, float(v)) for k in x for v in x[k]], "k string, v double").repartition(5)
    probs = [0.0, 0.004, 0.05, 0.5, 0.95, 0.999]
    got = {r["k"]: r for r in stats.quantiles(long, ["k"], probs).collect()}
    for k in "abcd":
        assert got[k]["n"] == len(x[k]) and got[k]["q"] == pytest.approx(np.quantile(x[k], probs))
    places = stats.order_statistics(long, ["k"], lambda n: [0, n // 3, n - 1])
    for k, v in x.items():
        assert places[k,] == (len(v), sorted(v)[0:1] + [sorted(v)[len(v) // 3], sorted(v)[-1]])


def test_a_wrong_sketch_is_seen(spark, monkeypatch):
    long = spark.createDataFrame([(1, float(v)) for v in range(1000)], "k int, v double")
    monkeypatch.setattr(F, "percentile_approx", lambda *_: F.array(*[F.lit(5000.0 + i) for i in range(stats.GRID - 1)]))
    real = stats.cuts
    monkeypatch.setattr(stats, "cuts", lambda v: F.struct(F.array(F.lit(300.0)).alias("coarse"), F.array(F.array(F.lit(100.0)), F.array(F.lit(700.0))).alias("fine")))
    assert real and stats.order_statistics(long, ["k"], lambda n: [10, 500]) == {(1,): (1000, [10.0, 500.0])}


def test_correlations_against_numpy(spark):
    g = np.random.default_rng(9)
    x = g.normal(1e6, 1, (700, 4))
    x[:, 1] += x[:, 0]
    x[:, 3] = 0.1
    for holes in (False, True):
        if holes:
            x[g.random((700, 4)) < 0.2] = np.nan
        rows = [(i % 3 if i % 3 < 2 else None, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)]
        df = spark.createDataFrame(rows, "k int, " + ", ".join(f"f{i} double" for i in range(4))).repartition(4)
        got = {(r["of"], r["a"], r["b"]): r for r in stats.correlations(df, F.col("k"), ["f0", "f1", "f2", "f3"]).collect()}
        assert len(got) == 12
        for (k, a, b), r in got.items():
            p = x[np.arange(700) % 3 == k][:, [int(a[1]), int(b[1])]]
            p = p[~np.isnan(p).any(axis=1)]
            assert r["n"] == len(p) and r["va"] == pytest.approx(p[:, 0].var(), rel=1e-6)
            assert r["r"] is None and r["vb"] == 0 if b == "f3" else r["r"] == pytest.approx(np.corrcoef(p.T)[0, 1], abs=1e-9)


def test_ranks_once(spark, monkeypatch):
    from plumbline.operators import dependence
    from plumbline.sources.panels import Flat

    g = np.random.default_rng(11)
    panel = Flat.of(spark.createDataFrame([(("real", "synthetic")[i % 2], i, *map(float, g.normal(0, 1, 2))) for i in range(300)], "side string, i int, x double, y double"), ["x", "y"], ["i"])
    names = ["spearman_corr", "tail_dependence_upper", "tail_dependence_asymmetry"]
    want = {m: {r["key"]: r["value"] for r in api.FLAT[m](panel).collect()}["overall"] for m in names}
    monkeypatch.setattr(dependence, "mid_ranks", None)
    got = api.validate(panel, names).metrics
    assert {m: got[m].value for m in names} == pytest.approx(want)

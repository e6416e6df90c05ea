"""The entry points on whole inputs, and readers of prices."""

import math

import numpy as np
import pytest

from plumbline.plans import api
from plumbline.plans.scoring import LENS_WEIGHTS
from plumbline.sources.panels import Forecast, log_returns, read_numeric

from test_operators import paths

G = np.random.default_rng(21)


@pytest.fixture(scope="module")
def whole(spark):
    real, syn = G.standard_t(4, (50, 24, 2)) * 0.01, G.standard_t(4, (50, 24, 2)) * 0.01
    obs = range(60)
    actual = spark.createDataFrame([(i, float(G.normal(2 * (i % 2), 1))) for i in obs], "obs long, x double")
    sample = spark.createDataFrame([(i, k, float(G.normal(2 * (i % 2), 1))) for i in obs for k in range(8)], "obs long, sample long, x double")
    labels = spark.createDataFrame([(i, "vol", f"r{i % 2}") for i in obs], "obs long, axis string, label string")
    return paths(spark, real, syn), Forecast.of(sample, actual, ["x"], labels)


def test_validate_full(whole):
    panel, forecast = whole
    r = api.validate_full(panel, forecast)
    assert {*api.FLAT, *api.PATH, *api.CALIBRATION, "coverage_deficit", "plausibility_deficit", "conditional_sensitivity", "within_regime_calibration_gap", "crps@r0", "coverage_90@r1"} <= set(r.metrics)
    assert set(r.per_lens) == set(LENS_WEIGHTS) and 0 < r.overall_score <= 1
    # long lags and windows do not fit 24 steps: errors of their own, not scores
    failed = {m for m, x in r.metrics.items() if x.error}
    assert "long_memory" not in failed and failed <= {"acf_returns", "volatility_clustering", "leverage_effect"}
    out = r.to_dict()["metrics"]["marginal_ks"]
    assert out["category"] == "distribution" and out["thresholds"] == {"excellent": 0.05, "good": 0.1, "acceptable": 0.2} and "marginal_ks" in out["interpretation"]


def test_paths_against_baselines(whole):
    out = api.validate_against_baselines(whole[0], names=("block_bootstrap", "gaussian"), metrics=("marginal_ks", "tail_quantiles", "variance_term_structure"))
    for name in ("block_bootstrap", "gaussian"):
        assert set(out[name]["delta"]) == {"marginal_ks", "tail_quantiles", "variance_term_structure"} and out[name]["n_better"] + out[name]["n_worse"] <= 3
    assert out["gaussian"]["baseline"].metrics["tail_quantiles"].value > out["block_bootstrap"]["baseline"].metrics["tail_quantiles"].value


def test_prices(spark, tmp_path):
    prices = spark.createDataFrame([("a", 0, 100.0, "x"), ("a", 1, 110.0, "x"), ("a", 2, -5.0, "x"), ("b", 0, 1.0, "x"), ("b", 1, math.e, "x")], "s string, t int, p double, note string")
    got = [(r["s"], r["t"], r["p"]) for r in log_returns(prices, ["p"], ["t"], by=["s"]).orderBy("s", "t").collect()]
    assert [g[:2] for g in got] == [("a", 1), ("a", 2), ("b", 1)]
    assert [g[2] for g in got] == pytest.approx([math.log(1.1), math.log(1e-9 / 110), 1.0])
    prices.write.parquet(f"{tmp_path}/p")
    assert read_numeric(spark, f"{tmp_path}/p").columns == ["t", "p"]

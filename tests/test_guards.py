"""Too small inputs have no score; paths where rows were expected; the replay and the floors."""

import math

import numpy as np
import pytest


from plumbline.operators import conditional, dependence, joint, marginal, temporal
from plumbline.plans import api
from plumbline.sources.panels import Flat, Forecast

from test_operators import flat, paths, value

G = np.random.default_rng(8)


@pytest.fixture(scope="module")
def few(spark):
    return flat(spark, G.normal(0, 1, (12, 2)), G.normal(0, 1, (12, 2)))


def test_few_rows_have_no_overall_value(spark, few):
    for metric in (dependence.coskewness, dependence.variogram_score, dependence.cross_correlation):
        assert value(metric(few)) is None
    tiny = flat(spark, G.normal(0, 1, (3, 2)), G.normal(5, 1, (3, 2)))
    for n_perm in (0, 10):
        assert value(joint.c2st(tiny, n_perm=n_perm)) is None
    # so a tiny panel does not trip that gate
    report = api.validate(tiny)
    assert report.metrics["c2st"].error and "c2st" not in api.FullReport(report.metrics).failing_gates
    assert value(joint.c2st(flat(spark, G.normal(0, 1, (10, 2)), G.normal(50, 1, (10, 2))), n_perm=0)) == 1.0


def test_short_paths_raise(spark):
    short = paths(spark, G.normal(0, 1, (6, 4, 2)), G.normal(0, 1, (6, 4, 2)))
    for metric in (temporal.time_reversal_asymmetry, temporal.regime_persistence, marginal.conditional_heavy_tails):
        with pytest.raises(ValueError):
            metric(short)
    with pytest.raises(ValueError):
        marginal.aggregational_gaussianity(short, taus=(5, 10))
    with pytest.raises(ValueError):
        temporal.variance_term_structure(paths(spark, G.normal(0, 1, (6, 4, 2)), G.normal(0, 1, (6, 5, 2))))
    assert value(conditional.regime_conditional(short)) is None
    r = api.compute("regime_persistence", temporal.regime_persistence, short)
    assert r.value == math.inf and r.error.startswith("ValueError") and r.to_dict()["value"] is None


def test_paths_where_rows_are_taken(spark):
    x = G.normal(0, 1, (40, 12, 2))
    same, apart = paths(spark, x, G.normal(0, 1, (40, 12, 2))), paths(spark, x, G.normal(0, 4, (40, 12, 2)))
    assert value(joint.c2st(apart, n_perm=20)) > value(joint.c2st(same, n_perm=20))
    assert value(joint.c2st(apart, n_perm=20), "p_value") < 0.1
    assert value(dependence.tail_dependence_asymmetry(same)) == pytest.approx(value(dependence.tail_dependence_asymmetry(same.flatten())))


def test_ks_p_values(spark):
    real, syn = G.normal(0, 1, (300, 2)), np.stack([G.normal(0, 1, 200), G.normal(0.5, 1, 200)], axis=1)
    panel = flat(spark, real, syn)
    d = {r["key"]: r["value"] for r in marginal.marginal_ks(panel).collect()}
    got = {r["key"]: r["value"] for r in marginal.marginal_ks_p_values(panel).collect()}
    for f in ("f0", "f1"):
        x = d[f] * math.sqrt(300 * 200 / 500)
        assert got[f] == pytest.approx(min(1.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 60))), abs=1e-9)
    assert got["f1"] < 0.001 < got["f0"] and got["overall"] == got["f1"]


def test_replay_of_the_real_side(spark):
    real = G.normal(0, 1, (400, 2))
    for panel in (flat(spark, real, G.normal(0, 1, (400, 2))), paths(spark, G.normal(0, 1, (60, 30, 2)), G.normal(0, 1, (60, 30, 2)))):
        for name, r in api.validate_generative(panel).metrics.items():
            assert 0 <= r.value < 0.6 and {"density", "coverage", "bootstrap_density", "bootstrap_coverage", f"{name}_vs_bootstrap"} == set(r.details)
            kind = "coverage" if name == "coverage_deficit" else "density"
            assert r.details[f"{name}_vs_bootstrap"] == pytest.approx(r.value - max(1 - r.details[f"bootstrap_{kind}"], 0))
    collapsed = api.validate_generative(flat(spark, real, np.tile(real[:4], (100, 1)))).metrics["coverage_deficit"]
    assert collapsed.value > 0.5 and collapsed.details["coverage_deficit_vs_bootstrap"] > 0.3


def test_any_axes(spark):
    obs = range(90)
    actual = spark.createDataFrame([(i, float(G.normal(3 * (i % 3), 1))) for i in obs], "obs long, x double")
    sample = spark.createDataFrame([(i, k, float(G.normal(3 * (i % 3), 1))) for i in obs for k in range(5)], "obs long, sample long, x double")
    blind = spark.createDataFrame([(i, k, float(G.normal(0, 1))) for i in obs for k in range(5)], "obs long, sample long, x double")
    labels = spark.createDataFrame([(i, a, f"r{(i + s) % 3}") for i in obs for s, a in enumerate(("shock", "credit"))], "obs long, axis string, label string")
    good, bad = (Forecast.of(s, actual, ["x"], labels) for s in (sample, blind))
    got = {r["key"]: r["value"] for r in conditional.multi_axis_sensitivity(good).collect()}
    assert set(got) == {"conditional_sensitivity@shock", "conditional_sensitivity@credit", "overall"} and got["overall"] == max(got.values())
    assert value(conditional.multi_axis_sensitivity(bad)) > got["overall"]
    report = api.validate_conditional(bad).metrics
    assert {f"{m}@r{i}" for m in ("crps", "pit_uniformity", "coverage_90") for i in range(3)} <= set(report)
    assert report["crps@r0"].category == "regime_sensitivity" and report["within_regime_calibration_gap"].applicable


def test_calibration_levels(spark):
    x = G.standard_t(3, (2400, 2)) * 0.01
    panel = Flat.of(spark.createDataFrame([("real", i, *map(float, r)) for i, r in enumerate(x)], ["side", "row", "f0", "f1"]), ("f0", "f1"), ("row",))
    levels = api.calibration_levels(panel, horizon=20, metrics=["marginal_ks", "tail_heaviness", "far_tail_quantiles", "variance_term_structure", "memorization"])
    assert {"marginal_ks", "far_tail_quantiles", "variance_term_structure", "memorization", "coverage_deficit"} <= set(levels)
    assert levels["far_tail_quantiles"]["gaussian"] > levels["far_tail_quantiles"]["floor"] and levels["marginal_ks"]["floor"] < 0.12


def test_kernels_of_pairs_against_numpy(spark):
    from plumbline.functions.stats import pair_sums

    rows = [(str(i % 3), i, float(a), float(b)) for i, (a, b) in enumerate(G.normal(0, 1, (1700, 2)))]
    points = spark.createDataFrame(rows, "s string, i long, x double, y double").repartition(3)
    got = {(r["a"], r["b"]): r["total"] for r in pair_sums(points, "s", ["x", "y"]).collect()}
    xs = {k: np.array([r[2:] for r in rows if r[0] == k]) for k in "012"}
    for a in "012":
        for b in "012":
            if a <= b:
                d = np.sqrt(((xs[a][:, None] - xs[b][None]) ** 2).sum(axis=2)).sum() / (2 if a == b else 1)
                assert got[a, b] == pytest.approx(d)


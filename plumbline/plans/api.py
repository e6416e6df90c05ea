"""Entry points: a report from panels. Each metric is one Spark job whose few result rows are collected; one that fails becomes an error result."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import partial

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import held, mid_ranks
from ..operators import baselines, calibration, conditional, dependence, generative, joint, marginal, temporal
from ..sources.panels import REAL, SYNTHETIC, Flat, Forecast, Paths
from .scoring import FullReport, Report, Result, absolute_weights

Metric = Callable[..., DataFrame]

FLAT: dict[str, Metric] = {f.__name__: f for f in (
    marginal.marginal_ks, marginal.energy_distance, marginal.tail_quantiles, marginal.far_tail_quantiles, marginal.marginal_skew, marginal.hill_tail_index, joint.c2st,
    dependence.pearson_corr, dependence.spearman_corr, dependence.copula_distance, dependence.tail_dependence_upper, dependence.tail_dependence_lower, dependence.correlation_breakdown,
    dependence.tail_dependence_asymmetry, dependence.covariance_calibration, dependence.coskewness, dependence.variogram_score)}
#: Metrics that need two features.
PAIRED = {"pearson_corr", "spearman_corr", "copula_distance", "tail_dependence_upper", "tail_dependence_lower", "correlation_breakdown", "tail_dependence_asymmetry", "covariance_calibration", "coskewness", "variogram_score"}
#: Metrics of the ranks of all rows.
RANKED = ("spearman_corr", "tail_dependence_upper", "tail_dependence_lower", "tail_dependence_asymmetry")
PATH: dict[str, Metric] = {f.__name__: f for f in (
    temporal.acf_returns, temporal.volatility_clustering, temporal.leverage_effect, temporal.cross_correlation, temporal.variance_term_structure, temporal.extreme_clustering, temporal.long_memory,
    temporal.time_reversal_asymmetry, temporal.regime_persistence, marginal.aggregational_gaussianity, marginal.conditional_heavy_tails, temporal.drawdown_distribution,
    conditional.regime_conditional, generative.memorization, joint.signature_distance)}
#: Path metrics that always see whole horizons.
FULL_HORIZON = {"drawdown_distribution", "memorization", "regime_conditional", "variance_term_structure"}
CALIBRATION: dict[str, Metric] = {"pit_uniformity": calibration.pit_uniformity, "crps": calibration.crps, **{f"coverage_{round(100 * x)}": partial(calibration.coverage, level=x) for x in (0.5, 0.9, 0.95)}}


def compute(name: str, metric: Metric, *args, n: int | None = None) -> Result:
    """The result of one metric; what the input does not allow, or what Spark fails at, is an error result of its own."""
    try:
        got = {r["key"]: r["value"] for r in metric(*args).collect()}
    except (ValueError, ArithmeticError, PySparkException, Py4JJavaError) as e:
        return Result(name, float("inf"), error=f"{type(e).__name__}: {(str(e).splitlines() or [''])[0][:300]}", failed=isinstance(e, (PySparkException, Py4JJavaError)))
    if got.get("overall") is None:
        return Result(name, float("inf"), {k: v for k, v in got.items() if v is not None}, error="too little input for an overall value", effective_n=n)
    return Result(name, got.pop("overall", None), {k: v for k, v in got.items() if v is not None}, effective_n=n)


def _chosen(metrics: str | Iterable[str], of: dict[str, Metric]) -> list[str]:
    return list(of) if metrics == "all" else [m for m in of if m in set(metrics)]


def _weights(weights: dict[str, float] | None, metrics: dict[str, Result]) -> dict[str, float]:
    return {k: w for k, w in (weights or absolute_weights()).items() if k in metrics}


def validate(panel: Flat, metrics: str | Iterable[str] = "all", weights: dict[str, float] | None = None) -> Report:
    """Flat metrics of a panel."""
    n = panel.df.where(F.col("side") == REAL).count()
    names = [m for m in _chosen(metrics, FLAT) if len(panel.features) > 1 or m not in PAIRED]
    with ranked(panel, names) as ranks:
        out = {m: compute(m, ranks.get(m, FLAT[m]), panel, n=n) for m in names}
    return Report(out, _weights(weights, out))


@contextmanager
def ranked(panel: Flat, names: Iterable[str]) -> Iterator[dict[str, Metric]]:
    """Metrics of ranks by name, over ranks that are computed once for all that is done inside."""
    chosen = [m for m in names if m in RANKED]
    if len(chosen) < 2:
        yield {}
        return
    try:
        ranks = mid_ranks(panel.df, panel.features)
    except (ValueError, ArithmeticError, PySparkException, Py4JJavaError):  # each metric then fails by itself, if it does
        yield {}
        return
    with held(ranks):
        yield {m: partial(FLAT[m], ranks=ranks) for m in chosen}


def validate_paths(paths: Paths, metrics: str | Iterable[str] = "all", weights: dict[str, float] | None = None, include_flat: bool = True, subwindow: int | None = None, instead: dict[str, Metric] | None = None) -> Report:
    """Path metrics, on sub-windows where asked, and flat metrics of the pooled steps. instead: path metrics by name that take the place of the usual ones."""
    out, of = {}, PATH | (instead or {})
    with paths.held() as paths:
        n = paths.df.where(F.col("side") == REAL).select("path").distinct().count()
        cut = paths.subwindow(subwindow)
        m_cut = n if cut is paths else cut.df.where(F.col("side") == REAL).select("path").distinct().count()
        for m in _chosen(metrics, of):
            whole = m in FULL_HORIZON or cut is paths
            out[m] = compute(m, of[m], paths if whole else cut, n=n if whole else m_cut)
        if include_flat:
            flat = validate(paths.flatten(), metrics, weights)
            out |= {k: v for k, v in flat.metrics.items() if k not in out}
    return Report(out, _weights(weights, out))


def validate_calibration(fc: Forecast, metrics: str | Iterable[str] = "all", weights: dict[str, float] | None = None) -> Report:
    with fc.held(), held(calibration.cells(fc)) as c:
        n = fc.actuals.count()
        out = {m: compute(m, partial(CALIBRATION[m], c=c), fc, n=n) for m in _chosen(metrics, CALIBRATION)}
    return Report(out, _weights(weights, out))


def validate_conditional(fc: Forecast) -> Report:
    """Sensitivity of each regime axis, the worst as headline, and calibration within the regimes of the primary axis."""
    with fc.held():
        return _conditional(fc)


def _conditional(fc: Forecast) -> Report:
    axes = [r[0] for r in fc.labels.select("axis").distinct().orderBy("axis").collect()]
    out: dict[str, Result] = {}
    for axis in axes:
        r = compute(f"conditional_sensitivity@{axis}", partial(conditional.conditional_sensitivity, axis=axis), fc)
        r.applicable = r.failed or r.value != float("inf")
        out[r.name] = r
    fine, failed = [r for r in out.values() if r.value != float("inf")], [r for r in out.values() if r.failed]
    head = max(fine, key=lambda r: r.value, default=None)
    ok = head is not None and (len(axes) < 2 or len(fine) >= 2)
    if failed:  # the worst axis is not known
        out["conditional_sensitivity"] = Result("conditional_sensitivity", float("inf"), error=f"{failed[0].name}: {failed[0].error}", failed=True)
    else:
        out["conditional_sensitivity"] = Result("conditional_sensitivity", head.value if head else float("inf"), applicable=ok, error="" if ok else f"only {len(fine)} of {len(axes)} axes can be measured")
    primary = "vol" if "vol" in axes else axes[0] if axes else ""
    # one run gives the gap and what each regime of the primary axis has
    got = compute("within_regime_calibration_gap", lambda f: conditional.stratified_calibration(f, primary).withColumn("key", F.when(F.col("key") == "gap", "overall").otherwise(F.col("key"))), fc)
    regimes = {k: v for k, v in got.details.items() if "@" in k}
    got.details = {k: v for k, v in got.details.items() if k not in regimes}
    got.applicable = got.failed or got.value != float("inf")
    out[got.name] = got
    out |= {k: Result(k, v) for k, v in sorted(regimes.items())}
    return Report(out, {"conditional_sensitivity": 0.6, "within_regime_calibration_gap": 0.4})


def validate_generative(panel: Flat | Paths, k: int = 5, baseline_block: int = 20, seed: int = 42) -> Report:
    """Coverage and plausibility deficits, with those of a bootstrap replay of the real side (blocks of `baseline_block` steps for paths, single rows else) and the deltas against it; not applicable where the real side is too small."""
    if isinstance(panel, Paths):
        count, dims = (lambda s: panel.df.where(F.col("side") == s).select("path").distinct().count()), 4 * len(panel.features)
    else:
        count, dims = (lambda s: panel.df.where(F.col("side") == s).count()), len(panel.features)
    n = count(REAL)
    names = {"coverage_deficit": "coverage", "plausibility_deficit": "density"}
    if not generative.enough_reference(n, dims, k):
        return Report({m: Result(m, float("inf"), applicable=False, error="too few real points") for m in names}, {})
    real = panel.df.where(F.col("side") == REAL)
    replay = real.unionByName(baselines.baseline("block_bootstrap", panel, count(SYNTHETIC), seed, baseline_block), allowMissingColumns=True)
    other = Paths(replay, panel.features) if isinstance(panel, Paths) else Flat(replay, panel.features, panel.order)
    got, base = (compute("coverage_deficit", partial(generative.density_coverage, k=k), x, n=n) for x in (panel, other))
    out = {}
    for m, key in names.items():
        value, replayed = (max(1 - r.details[key], 0.0) if key in r.details else float("inf") for r in (got, base))
        details = {f"{p}{c}": r.details[c] for p, r in (("", got), ("bootstrap_", base)) for c in ("density", "coverage") if c in r.details}
        if float("inf") not in (value, replayed):
            details[f"{m}_vs_bootstrap"] = value - replayed
        out[m] = Result(m, value, details, error=got.error or base.error, effective_n=n, failed=got.failed or base.failed)
    return Report(out, {"coverage_deficit": 0.5, "plausibility_deficit": 0.5})


def validate_against_baselines(panel: Flat | Paths, names: Iterable[str] = ("block_bootstrap", "gaussian"), metrics: str | Iterable[str] = "all", seed: int = 42) -> dict[str, dict]:
    """The model's and each baseline's values; delta: model less baseline, over finite ones."""
    run = validate_paths if isinstance(panel, Paths) else validate
    model = run(panel, metrics)
    real = panel.df.where(F.col("side") == REAL)
    if isinstance(panel, Paths):
        n = panel.df.where(F.col("side") == SYNTHETIC).select("path").distinct().count()
    else:
        n = panel.df.where(F.col("side") == SYNTHETIC).count()
    out = {}
    for name in names:
        df = real.unionByName(baselines.baseline(name, panel, n, seed), allowMissingColumns=True)
        other = run(Paths(df, panel.features) if isinstance(panel, Paths) else Flat(df, panel.features, panel.order), metrics)
        inf = float("inf")
        delta = {m: r.value - other.metrics[m].value for m, r in model.metrics.items() if m in other.metrics and r.value != inf and other.metrics[m].value != inf}
        out[name] = {"model": model, "baseline": other, "delta": delta, "n_better": sum(d < 0 for d in delta.values()), "n_worse": sum(d > 0 for d in delta.values()), "mean_delta": sum(delta.values()) / len(delta) if delta else None}
    return out


def validate_full(panel: Flat | Paths, forecast: Forecast | None = None, subwindow: int | None = None) -> FullReport:
    """Whatever the inputs allow, through lenses and gates."""
    pooled = validate_paths(panel, subwindow=subwindow) if isinstance(panel, Paths) else validate(panel)
    out = dict(pooled.metrics) | validate_generative(panel).metrics
    if forecast is not None:
        if forecast.labels is not None:
            out |= validate_conditional(forecast).metrics
        out |= validate_calibration(forecast).metrics
    return FullReport(out)


def random_split_floor(panel: Flat, metrics: str | Iterable[str] = "all", seed: int = 7) -> dict[str, float]:
    """What each flat metric gives for two random halves of the real side."""
    from ..functions.stats import uniform

    real = panel.df.where(F.col("side") == REAL)
    halves = real.withColumn("side", F.when(uniform(seed, *panel.order) < 0.5, REAL).otherwise(SYNTHETIC))
    return {m: r.value for m, r in validate(Flat(halves, panel.features, panel.order), metrics).metrics.items()}


def calibration_levels(returns: Flat, horizon: int = 20, seed: int = 0, metrics: str | Iterable[str] = "all") -> dict[str, dict[str, float]]:
    """What every metric gives at its floor, between two random halves of the real side, and for a Gaussian of its moments: `floor` and `gaussian` by metric.

    Flat metrics on rows; path and generative ones on overlapping windows of `horizon` steps, a quarter of it apart, if there are at least 40."""
    from ..functions.stats import uniform

    real = Flat(returns.finite().where(F.col("side") == REAL), returns.features, returns.order)
    halves = lambda df, *by: df.withColumn("side", F.when(uniform(seed, *by) < 0.5, REAL).otherwise(SYNTHETIC))
    split = Flat(halves(real.df, *real.order), real.features, real.order)
    half = split.df.where(F.col("side") == REAL)
    gaussian = baselines.baseline("gaussian", real, half.count(), seed)
    floor = dict(validate(split, metrics).metrics)
    bad = dict(validate(Flat(half.unionByName(gaussian, allowMissingColumns=True), real.features, real.order), metrics).metrics)
    n = real.df.count()
    stride = max(1, horizon // 4)
    windows = max(0, -(-(n - horizon) // stride))
    if windows >= 40:
        idx = F.col("idx")
        first = F.greatest(F.ceil((idx - horizon + 1) / stride), F.lit(0))
        last = F.least(F.floor(idx / stride), F.lit(windows - 1))
        steps = baselines.numbered(real.df.select(*dict.fromkeys([*real.order, *real.features])), real.order).where(first <= last)
        steps = steps.select("idx", *real.features, F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("path"))
        steps = steps.select(F.lit(REAL).alias("side"), "path", (idx - F.col("path") * stride).cast("int").alias("t"), *real.features)
        whole, parted = Paths(steps, real.features), Paths(halves(steps, "path"), real.features)
        other = Paths(steps.unionByName(baselines.baseline("gaussian", whole, windows, seed)), real.features)
        for out, panel in ((floor, parted), (bad, other)):
            out |= validate_paths(panel, metrics, include_flat=False).metrics | validate_generative(panel).metrics
    return {m: {"floor": floor[m].value, "gaussian": bad[m].value} for m in floor if m in bad}

"""Cross-feature dependence of flat panels."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import correlations, local, mean, mid_ranks, quantiles, rows
from ..sources.panels import REAL, SYNTHETIC, Flat, Paths, on


#: Up to so many features, rows of equal cells are counted together before their pairs are looked at.
MERGED = 6


def pairs(features: tuple[str, ...]) -> list[tuple[str, str]]:
    return list(combinations(features, 2))


def _name(a: str, b: str) -> str:
    return f"{a}<->{b}"


def _enough(least: int) -> tuple[list[Column], Column]:
    """Aggregates that count the rows of each side, and whether both have at least so many."""
    return [F.count(on(s, F.lit(1))).alias(f"n|{s}") for s in (REAL, SYNTHETIC)], F.least(f"n|{REAL}", f"n|{SYNTHETIC}") >= least


_SIDES = (SYNTHETIC, REAL)


def _side() -> Column:
    """The side's place in _SIDES."""
    return F.when(F.col("side") == SYNTHETIC, 0).when(F.col("side") == REAL, 1)


def _of_pair(of: int, a: str, b: str, what: Column) -> Column:
    """Aggregate over `correlations`: what a pair has in one group, else 0."""
    return F.coalesce(F.max(F.when((F.col("of") == of) & (F.col("a") == a) & (F.col("b") == b), what)), F.lit(0.0))


def _corr_gap(df: DataFrame, features: tuple[str, ...], least: int = 10, rows_needed: int = 0) -> DataFrame:
    """Gap of correlations per pair over rows where both are present; under `least` of them, or with a constant, the correlation is 0. No overall value under `rows_needed` rows on a side."""
    got = correlations(df, _side(), features)
    one = got.agg(*[F.coalesce(F.max(F.when(F.col("of") == i, F.col("n"))), F.lit(0)).alias(f"n|{s}") for i, s in enumerate(_SIDES)],
                  *[_of_pair(i, a, b, F.when(F.col("n") >= least, F.col("r"))).alias(f"{s}|{a}|{b}") for a, b in pairs(features) for i, s in enumerate(_SIDES)])
    items = {_name(a, b): F.abs(F.col(f"{SYNTHETIC}|{a}|{b}") - F.col(f"{REAL}|{a}|{b}")) for a, b in pairs(features)}
    return rows(one, items, F.when(F.least(*[F.col(f"n|{s}") for s in _SIDES]) >= rows_needed, mean(list(items.values()))))


def pearson_corr(panel: Flat) -> DataFrame:
    return _corr_gap(panel.df, panel.features)


def cross_correlation(panel: Flat) -> DataFrame:
    """As pearson_corr over complete rows, of which each side needs 50."""
    return _corr_gap(panel.complete(), panel.features, rows_needed=50)


def spearman_corr(panel: Flat, ranks: DataFrame | None = None) -> DataFrame:
    """ranks, here and below: `mid_ranks` of the panel, where they are at hand."""
    return _corr_gap(mid_ranks(panel.df, panel.features) if ranks is None else ranks, panel.features)


#: 20 points from 0.05 to 0.95.
def grid(n: int = 20) -> list[float]:
    return [0.05 + 0.9 * i / (n - 1) for i in range(n)]


def _cell(u: Column, points: list[float]) -> Column:
    """How many of the evenly spaced points lie below u: found by its distance from the first, and made exact by the two points there."""
    g, last = F.array(*[F.lit(x) for x in points]), len(points) - 1
    k = F.greatest(F.lit(0), F.least(F.lit(last), F.floor((u - points[0]) * (last / (points[-1] - points[0]))).cast("int")))
    return k + (u > F.get(g, k)).cast("int") + F.coalesce((u > F.get(g, k + 1)).cast("int"), F.lit(0))


def _capped(features: tuple[str, ...], cap: int, seed: int, ordered: bool = False) -> list[tuple[str, str]]:
    """All pairs, or a seeded choice of them."""
    import hashlib

    of = list(permutations(features, 2)) if ordered else pairs(features)
    if len(of) <= cap:
        return of
    return sorted(sorted(of, key=lambda p: hashlib.md5(f"{seed}|{p}".encode()).hexdigest())[:cap])


def copula_distance(panel: Flat, size: int = 20, cap: int = 5000) -> DataFrame:
    """Root mean square gap of the two empirical copulas on a grid.

    A row counts in the first cell whose grid lines are not below its ranks; two
    running sums over the cells give the copula, whatever the number of rows."""
    points = grid(size)
    r = mid_ranks(panel.complete(), panel.features)
    chosen = _capped(panel.features, cap, 42)
    n = F.col(f"n_{panel.features[0]}")  # of complete rows all features have as many
    at = r.select("side", n.alias("n"), *[(F.col(f) / (F.col(f"n_{f}") + 1)).alias(f) for f in panel.features])
    binned = at.select("side", "n", *[_cell(F.col(f), points).alias(f) for f in panel.features])
    cells = F.array(*[F.struct(F.lit(_name(a, b)).alias("key"), F.col(a).alias("i"), F.col(b).alias("j")) for a, b in chosen])
    # rows in the same cells count together; of many features few rows would
    binned = binned.groupBy("side", "n", *panel.features).agg(F.count("*").alias("w")) if len(panel.features) <= MERGED else binned.withColumn("w", F.lit(1))
    counts = binned.select("side", "n", "w", F.explode(cells).alias("c")).groupBy("side", "n", "c.key", "c.i", "c.j").agg(F.sum("w").alias("c"))
    if len(chosen) <= 200:  # at most 441 cells a pair and side, read twice below
        counts = local(counts)
    every = F.sequence(F.lit(0), F.lit(size - 1))
    dense = counts.select("side", "n", "key").distinct().select("side", "n", "key", F.explode(every).alias("i")).select("side", "n", "key", "i", F.explode(every).alias("j"))
    dense = dense.join(counts, ["side", "n", "key", "i", "j"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    up = lambda a, b: Window.partitionBy("side", "key", a).orderBy(b).rowsBetween(Window.unboundedPreceding, 0)
    run = dense.withColumn("c", F.sum("c").over(up("i", "j"))).withColumn("c", F.sum("c").over(up("j", "i")) / F.col("n"))
    gap = run.groupBy("key", "i", "j").agg(F.max(on(REAL, F.col("c"))).alias("r"), F.max(on(SYNTHETIC, F.col("c"))).alias("s"))
    out = gap.groupBy("key").agg(F.sqrt(F.avg(F.pow(F.col("s") - F.col("r"), 2))).alias("value"))
    return out.unionByName(out.agg(F.avg("value").alias("value")).select(F.lit("overall").alias("key"), "value"))


def _tails(panel: Flat, q: float, missing: Column, ranks: DataFrame | None) -> tuple[DataFrame, dict[tuple[str, str, str, str], Column]]:
    """One row with the lower and upper tail coefficients of each pair and side; `missing` where a tail is empty or rows are under 50."""
    ranks = mid_ranks(panel.df, panel.features) if ranks is None else ranks
    u = {f: F.col(f) / (F.col(f"n_{f}") + 1) for f in panel.features}
    ranks = ranks.select("side", *[F.when(u[f] < q, -1).when(u[f] > 1 - q, 1).when(u[f].isNotNull(), 0).alias(f) for f in panel.features])
    # rows that lie in the same tails count together; of many features few rows would
    few = len(panel.features) <= MERGED
    ranks = ranks.groupBy("side", *panel.features).agg(F.count("*").alias("w")) if few else ranks.withColumn("w", F.lit(1))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0))
    aggs, names = [], {}
    for a, b in pairs(panel.features):
        for s in (REAL, SYNTHETIC):
            both = (F.col("side") == s) & F.col(a).isNotNull() & F.col(b).isNotNull()
            for tail, at in (("lower", -1), ("upper", 1)):
                x, y = F.col(a) == at, F.col(b) == at
                c = F.when(count(both) >= 50, count(both & x & y) / F.nullif(count(both & x), F.lit(0)))
                name = f"{tail}|{s}|{a}|{b}"
                aggs.append(F.coalesce(c, missing).alias(name))
                names[(tail, s, a, b)] = F.col(name)
    return ranks.agg(*aggs), names


def _tail_dependence(panel: Flat, q: float, tail: str, ranks: DataFrame | None) -> DataFrame:
    a, names = _tails(panel, q, F.lit(0.0), ranks)
    return rows(a, {_name(x, y): F.abs(names[(tail, SYNTHETIC, x, y)] - names[(tail, REAL, x, y)]) for x, y in pairs(panel.features)})


def tail_dependence_upper(panel: Flat, q: float = 0.05, ranks: DataFrame | None = None) -> DataFrame:
    return _tail_dependence(panel, q, "upper", ranks)


def tail_dependence_lower(panel: Flat, q: float = 0.05, ranks: DataFrame | None = None) -> DataFrame:
    return _tail_dependence(panel, q, "lower", ranks)


def tail_dependence_asymmetry(panel: Flat | Paths, q: float = 0.10, ranks: DataFrame | None = None) -> DataFrame:
    """Lower less upper tail coefficient per pair and side; overall: the gap of the two sides' means over pairs with all tails. Paths are taken as their pooled steps."""
    panel = panel.flatten() if isinstance(panel, Paths) else panel
    a, names = _tails(panel, q, F.lit(None).cast("double"), ranks)
    asym = {}
    for x, y in pairs(panel.features):
        both = {s: names[("lower", s, x, y)] - names[("upper", s, x, y)] for s in (REAL, SYNTHETIC)}
        ok = both[REAL].isNotNull() & both[SYNTHETIC].isNotNull()
        for s in both:
            asym[(s, x, y)] = F.when(ok, both[s])
    sides = {s: mean([c for (side, _, _), c in asym.items() if side == s]) for s in (REAL, SYNTHETIC)}
    items = {_name(x, y): F.abs(asym[(SYNTHETIC, x, y)] - asym[(REAL, x, y)]) for x, y in pairs(panel.features)}
    items |= {"mean_asymmetry_real": sides[REAL], "mean_asymmetry_synthetic": sides[SYNTHETIC]}
    return rows(a, items, F.abs(sides[SYNTHETIC] - sides[REAL]))


def correlation_breakdown(panel: Flat, percentile: float = 10.0, least: int = 20) -> DataFrame:
    """Mean correlation gap in the rows whose feature mean lies below the side's percentile (stress), and in the rest (calm); overall: the larger."""
    level = sum((F.col(f) for f in panel.features), F.lit(0.0)) / len(panel.features)
    df = panel.df.withColumn("_m", level)
    cut = quantiles(df.select("side", F.col("_m").alias("v")), ["side"], [percentile / 100]).select("side", F.col("q")[0].alias("_cut"))
    regimes = ("stress", "calm")
    inside = F.when(F.col("_m") < F.col("_cut"), 0).when(F.col("_m") >= F.col("_cut"), 1)
    got = correlations(df.join(F.broadcast(cut), "side"), 2 * inside + _side(), panel.features)
    aggs = []
    for k, regime in enumerate(regimes):
        for i, s in enumerate(_SIDES):
            aggs.append(F.coalesce(F.max(F.when(F.col("of") == 2 * k + i, F.col("n"))), F.lit(0)).alias(f"n|{regime}|{s}"))
            aggs += [_of_pair(2 * k + i, a, b, F.col("r")).alias(f"{regime}|{s}|{a}|{b}") for a, b in pairs(panel.features)]
    one = got.agg(*aggs)
    error = {}
    for regime in ("stress", "calm"):
        gap = mean([F.abs(F.col(f"{regime}|{SYNTHETIC}|{a}|{b}") - F.col(f"{regime}|{REAL}|{a}|{b}")) for a, b in pairs(panel.features)])
        error[regime] = F.when(F.least(F.col(f"n|{regime}|{REAL}"), F.col(f"n|{regime}|{SYNTHETIC}")) < least, 0.0).otherwise(gap)
    return rows(one, {"stress": error["stress"], "calm": error["calm"]}, F.greatest(error["stress"], error["calm"]))


def covariance_calibration(panel: Flat) -> DataFrame:
    """Mean absolute log ratio of two dispersions, synthetic to real: of the pairs' correlations, and of the features' log variances; one whose real dispersion is 0 is left out."""
    got, aggs = correlations(panel.finite(), _side(), panel.features), []
    for i, s in enumerate(_SIDES):
        var = lambda f: F.coalesce(*[F.max(F.when((F.col("of") == i) & (F.col(x) == f), F.col(f"v{x}"))) for x in "ab"])  # noqa: B023, E731
        aggs += [F.log(var(f) + 1e-30).alias(f"v|{s}|{f}") for f in panel.features]
        aggs += [_of_pair(i, a, b, F.col("r")).alias(f"c|{s}|{a}|{b}") for a, b in pairs(panel.features)]
        aggs.append(F.coalesce(F.max(F.when(F.col("of") == i, F.col("n"))), F.lit(0)).alias(f"n|{s}"))
    one = got.agg(*aggs)

    parts = F.array(*[F.struct(F.lit(axis).alias("axis"), F.lit(s).alias("side"), F.col(c % s).alias("v")) for axis, cols in (("corr", [f"c|%s|{a}|{b}" for a, b in pairs(panel.features)]), ("var", [f"v|%s|{f}" for f in panel.features])) for s in (REAL, SYNTHETIC) for c in cols])
    enough = F.least(f"n|{REAL}", f"n|{SYNTHETIC}") >= 20
    spread = one.select(enough.alias("enough"), F.explode(parts).alias("c")).select("enough", "c.axis", "c.side", "c.v").groupBy("enough", "axis", "side").agg(F.stddev_pop("v").alias("sd"))
    real, syn = F.max(on(REAL, F.col("sd"))), F.max(on(SYNTHETIC, F.col("sd")))
    ratio = spread.groupBy("axis").agg(F.first("enough").alias("enough"), F.when(real > 1e-9, syn / (real + 1e-12)).alias("value"))
    total = ratio.agg(F.avg(F.when(F.col("enough"), F.abs(F.log(F.greatest("value", F.lit(1e-12)))))).alias("value"))
    return ratio.select(F.concat("axis", F.lit("_dispersion_ratio")).alias("key"), "value").unionByName(total.select(F.lit("overall").alias("key"), "value"))


def _moments(panel: Flat, df: DataFrame, sides: tuple[str, ...]) -> DataFrame:
    m = df.agg(*[g(on(s, F.col(f))).alias(f"{n}_{s}_{f}") for s in sides for f in panel.features for n, g in (("m", F.avg), ("sd", F.stddev_pop))])
    return df.join(F.broadcast(m))


def coskewness(panel: Flat, cap: int = 200) -> DataFrame:
    """Gap of E[z_i^2 z_j] over ordered pairs, each side by its own mean and deviation; a side needs 50 complete rows."""
    df = _moments(panel, panel.complete(), (REAL, SYNTHETIC))
    z = {(s, f): on(s, (F.col(f) - F.col(f"m_{s}_{f}")) / (F.col(f"sd_{s}_{f}") + 1e-12)) for s in (REAL, SYNTHETIC) for f in panel.features}
    chosen = _capped(panel.features, cap, 0, ordered=True)
    count, enough = _enough(50)
    one = df.agg(*count, *[F.avg(z[(s, a)] * z[(s, a)] * z[(s, b)]).alias(f"{s}|{a}|{b}") for a, b in chosen for s in (REAL, SYNTHETIC)])
    items = {f"{a}^2*{b}": F.abs(F.col(f"{SYNTHETIC}|{a}|{b}") - F.col(f"{REAL}|{a}|{b}")) for a, b in chosen}
    return rows(one, items, F.when(enough, mean(list(items.values()))))


def variogram_score(panel: Flat, p: float = 0.5) -> DataFrame:
    """Gap of E|z_i - z_j|^p per pair, both sides by the real mean and deviation; a side needs 50 finite rows."""
    df = _moments(panel, panel.finite(), (REAL,))
    z = {f: (F.col(f) - F.col(f"m_{REAL}_{f}")) / (F.col(f"sd_{REAL}_{f}") + 1e-12) for f in panel.features}
    count, enough = _enough(50)
    one = df.agg(*count, *[F.avg(on(s, F.pow(F.abs(z[a] - z[b]), p))).alias(f"{s}|{a}|{b}") for a, b in pairs(panel.features) for s in (REAL, SYNTHETIC)])
    items = {_name(a, b): F.abs(F.col(f"{SYNTHETIC}|{a}|{b}") - F.col(f"{REAL}|{a}|{b}")) for a, b in pairs(panel.features)}
    return rows(one, items, F.when(enough, mean(list(items.values()))))


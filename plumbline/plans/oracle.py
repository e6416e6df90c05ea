"""The same queries in DuckDB's SQL, over the driver's tables."""

from __future__ import annotations

from itertools import combinations, permutations

FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
PATHS = ("price", "quantity")

FLAT = """flat AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'real' ELSE 'synthetic' END AS side,
  row_number() OVER (PARTITION BY l_linestatus = 'F' ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"""
LONG = FLAT + ", long AS (SELECT side, rn, feature, v FROM flat UNPIVOT (v FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax)))"
PATH = """px AS (SELECT l_suppkey, row_number() OVER w AS n, ln(l_extendedprice / lag(l_extendedprice) OVER w) AS price, ln(l_quantity / lag(l_quantity) OVER w) AS quantity, count(*) OVER (PARTITION BY l_suppkey) AS c
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
p AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'real' ELSE 'synthetic' END AS side, l_suppkey * 1000 + (n - 2) // 60 AS path, ((n - 2) % 60)::INT AS t, price, quantity FROM px WHERE n > 1 AND n - 2 < ((c - 1) // 60) * 60)"""
PLONG = PATH + ", long AS (SELECT side, path, t, feature, v FROM p UNPIVOT (v FOR feature IN (price, quantity)))"
FORE = """fx AS (SELECT l_partkey AS obs, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS n, count(*) OVER (PARTITION BY l_partkey) AS c, l_extendedprice AS price, l_quantity AS quantity FROM lineitem),
samples AS (SELECT obs, n - 1 AS sample, price, quantity FROM fx WHERE n <= 10 AND n < c), actuals AS (SELECT obs, price, quantity FROM fx WHERE n = c),
labels AS (SELECT p_partkey AS obs, 'vol' AS axis, CASE WHEN p_size <= 17 THEN 'low' WHEN p_size <= 34 THEN 'mid' ELSE 'high' END AS label FROM part UNION ALL SELECT p_partkey, 'trend', p_type FROM part),
sl AS (SELECT obs, feature, x FROM samples UNPIVOT (x FOR feature IN (price, quantity))), al AS (SELECT obs, feature, y FROM actuals UNPIVOT (y FOR feature IN (price, quantity)))"""
CELLS = FORE + """, rk AS (SELECT obs, feature, x, y, row_number() OVER (PARTITION BY obs, feature ORDER BY x) AS i, count(*) OVER (PARTITION BY obs, feature) AS n FROM sl JOIN al USING (obs, feature)),
cells AS (SELECT obs, feature, any_value(y) AS y, greatest(avg(abs(x - y)) - CASE WHEN any_value(n) > 1 THEN 0.5 * 2 * sum((2 * i - n - 1) * x) / (any_value(n) * greatest(any_value(n) - 1, 1)) ELSE 0 END, 0) AS crps,
  least(greatest(avg(CASE WHEN x <= y THEN 1.0 ELSE 0.0 END), 1e-6), 1 - 1e-6) AS pit, quantile_cont(x, 0.05) AS q05, quantile_cont(x, 0.95) AS q95, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.75) AS q75, quantile_cont(x, 0.025) AS q025, quantile_cont(x, 0.975) AS q975 FROM rk GROUP BY ALL HAVING true)"""
CELLS = CELLS.replace("GROUP BY ALL HAVING true", "GROUP BY obs, feature")


def final(ctes: str, rows: str, overall: str = "SELECT 'overall', avg(value) FROM r") -> str:
    return f"WITH {ctes}, r AS ({rows}) SELECT key, round(value, 6) AS value FROM (SELECT key, value::DOUBLE AS value FROM r UNION ALL {overall})"


def pairs(features=FEATURES):
    return list(combinations(features, 2))


def _side(expr: str, side: str) -> str:
    return f"CASE WHEN side = '{side}' THEN {expr} END"


def _ks(ctes: str, source: str) -> str:
    return ctes + f""", kc AS (SELECT feature, v, sum((side = 'real')::INT) AS a, sum((side <> 'real')::INT) AS b FROM {source} GROUP BY feature, v),
kr AS (SELECT feature, sum(a) OVER w / sum(a) OVER (PARTITION BY feature)::DOUBLE AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY feature)::DOUBLE AS fb FROM kc WINDOW w AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _tails(probs: str, eps: str) -> str:
    n = probs.count(",") + 1
    return final(LONG + f", q AS (SELECT feature, side, quantile_cont(v, [{probs}]) AS q FROM long GROUP BY ALL), s AS (SELECT feature, stddev_pop(v) AS sd FROM long WHERE side = 'real' GROUP BY ALL)",
                 f"SELECT a.feature AS key, list_sum([abs(a.q[i] - b.q[i]) for i in range(1, {n + 1})]) / {n} / {eps} AS value FROM q a JOIN q b USING (feature) JOIN s USING (feature) WHERE a.side = 'synthetic' AND b.side = 'real'")


def _corrs(ctes: str, table: str, features) -> str:
    rows = " UNION ALL ".join(f"SELECT '{a}<->{b}' AS key, abs(coalesce(corr({_side(a, 'synthetic')}, {_side(b, 'synthetic')}), 0) - coalesce(corr({_side(a, 'real')}, {_side(b, 'real')}), 0)) AS value FROM {table}" for a, b in pairs(features))
    return final(ctes, rows)


RANKS = FLAT + ", ranks AS (SELECT side, count(*) OVER (PARTITION BY side) AS n, " + ", ".join(f"rank() OVER (PARTITION BY side ORDER BY {f}) + (count(*) OVER (PARTITION BY side, {f}) - 1) / 2.0 AS {f}" for f in FEATURES) + " FROM flat)"
U = RANKS + ", u AS (SELECT side, n, " + ", ".join(f"{f} / (n + 1) AS {f}" for f in FEATURES) + " FROM ranks)"


def _copula() -> str:
    points = [0.05 + 0.9 * i / 19 for i in range(20)]
    grid = "g AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {p!r}::DOUBLE)" for i, p in enumerate(points)) + ") t(i, p))"
    count = lambda f: " + ".join(f"({f} > {p!r}::DOUBLE)::INT" for p in points)
    binned = "b AS (SELECT side, n, " + ", ".join(f"{count(f)} AS {f}" for f in FEATURES) + " FROM u)"
    cells = "c AS (" + " UNION ALL ".join(f"SELECT side, n, '{a}<->{b}' AS key, {a} AS i, {b} AS j, count(*) AS c FROM b GROUP BY ALL" for a, b in pairs()) + ")"
    cum = "m AS (SELECT c.key, g1.i, g2.i AS j, sum(CASE WHEN side = 'real' THEN c.c::DOUBLE / n ELSE 0 END) AS r, sum(CASE WHEN side <> 'real' THEN c.c::DOUBLE / n ELSE 0 END) AS s FROM c JOIN g g1 ON c.i <= g1.i JOIN g g2 ON c.j <= g2.i GROUP BY ALL)"
    return final(f"{U}, {grid}, {binned}, {cells}, {cum}", "SELECT key, sqrt(avg((s - r) * (s - r))) AS value FROM m GROUP BY key")


def _tail_coef(a: str, b: str, side: str, tail: str, q: float, missing: str) -> str:
    x, y = (f"{f} < {q}" if tail == "lower" else f"{f} > 1 - {q}" for f in (a, b))
    s = f"side = '{side}'"
    return f"coalesce(count(*) FILTER ({s} AND {x} AND {y}) / nullif(count(*) FILTER ({s} AND {x}), 0)::DOUBLE, {missing})"


def _tail_dep(tail: str) -> str:
    return final(U, " UNION ALL ".join(f"SELECT '{a}<->{b}' AS key, abs({_tail_coef(a, b, 'synthetic', tail, 0.05, '0')} - {_tail_coef(a, b, 'real', tail, 0.05, '0')}) AS value FROM u" for a, b in pairs()))


def _asym() -> str:
    one = "a AS (" + " UNION ALL ".join(f"SELECT '{a}<->{b}' AS key, {_tail_coef(a, b, 'real', 'lower', 0.1, 'NULL')} - {_tail_coef(a, b, 'real', 'upper', 0.1, 'NULL')} AS ar, {_tail_coef(a, b, 'synthetic', 'lower', 0.1, 'NULL')} - {_tail_coef(a, b, 'synthetic', 'upper', 0.1, 'NULL')} AS sy FROM u" for a, b in pairs()) + ")"
    return final(f"{U}, {one}", "SELECT key, abs(sy - ar) AS value FROM a UNION ALL SELECT 'mean_asymmetry_real', avg(ar) FROM a UNION ALL SELECT 'mean_asymmetry_synthetic', avg(sy) FROM a", "SELECT 'overall', abs(avg(sy) - avg(ar)) FROM a")


def _breakdown() -> str:
    m = "m AS (SELECT *, (0.0 + " + " + ".join(FEATURES) + f") / {len(FEATURES)} AS m FROM flat), t AS (SELECT side, quantile_cont(m, 0.1) AS cut FROM m GROUP BY side), s AS (SELECT m.*, m.m < t.cut AS stress FROM m JOIN t USING (side))"
    gap = " + ".join(f"abs(corr({_side(a, 'synthetic')}, {_side(b, 'synthetic')}) - corr({_side(a, 'real')}, {_side(b, 'real')}))" for a, b in pairs())
    return final(f"{FLAT}, {m}", f"SELECT CASE WHEN stress THEN 'stress' ELSE 'calm' END AS key, ({gap}) / {len(pairs())} AS value FROM s GROUP BY stress", "SELECT 'overall', max(value) FROM r")


def _calibration() -> str:
    corr = " UNION ALL ".join(f"SELECT 'corr' AS axis, '{s}' AS side, corr({_side(a, s)}, {_side(b, s)}) AS v FROM flat" for a, b in pairs() for s in ("real", "synthetic"))
    var = " UNION ALL ".join(f"SELECT 'var' AS axis, '{s}' AS side, ln(var_pop({_side(f, s)}) + 1e-30) AS v FROM flat" for f in FEATURES for s in ("real", "synthetic"))
    return final(f"{FLAT}, d AS ({corr} UNION ALL {var}), s AS (SELECT axis, side, stddev_pop(v) AS sd FROM d GROUP BY ALL)",
                 "SELECT a.axis || '_dispersion_ratio' AS key, a.sd / (b.sd + 1e-12) AS value FROM s a JOIN s b USING (axis) WHERE a.side = 'synthetic' AND b.side = 'real'", "SELECT 'overall', avg(abs(ln(greatest(value, 1e-12)))) FROM r")


def _moments(sides: tuple[str, ...]) -> str:
    return "mo AS (SELECT " + ", ".join(f"avg({_side(f, s)}) AS m_{s}_{f}, stddev_pop({_side(f, s)}) AS d_{s}_{f}" for f in FEATURES for s in sides) + " FROM flat)"


def _coskew() -> str:
    z = lambda f, s: f"(({f} - m_{s}_{f}) / (d_{s}_{f} + 1e-12))"
    rows = " UNION ALL ".join(f"SELECT '{a}^2*{b}' AS key, abs(" + " - ".join(f"avg({_side(f'{z(a, s)} * {z(a, s)} * {z(b, s)}', s)})" for s in ("synthetic", "real")) + ") AS value FROM flat, mo" for a, b in permutations(FEATURES, 2))
    return final(f"{FLAT}, {_moments(('real', 'synthetic'))}", rows)


def _variogram() -> str:
    z = lambda f: f"(({f} - m_real_{f}) / (d_real_{f} + 1e-12))"
    rows = " UNION ALL ".join(f"SELECT '{a}<->{b}' AS key, abs(" + " - ".join(f"avg({_side(f'pow(abs({z(a)} - {z(b)}), 0.5)', s)})" for s in ("synthetic", "real")) + ") AS value FROM flat, mo" for a, b in pairs())
    return final(f"{FLAT}, {_moments(('real',))}", rows)


def _skew() -> str:
    return final(LONG + ", m AS (SELECT feature, side, avg(v) AS m, stddev_pop(v) AS d FROM long GROUP BY ALL), k AS (SELECT feature, side, avg(pow((v - m) / d, 3)) AS k FROM long JOIN m USING (feature, side) GROUP BY ALL)",
                 "SELECT a.feature AS key, abs(a.k - b.k) AS value FROM k a JOIN k b USING (feature) WHERE a.side = 'synthetic' AND b.side = 'real'")


def _hill() -> str:
    return final(LONG + """, two AS (SELECT side, feature, 'u' AS tail, v FROM long UNION ALL SELECT side, feature, 'l', -v FROM long),
o AS (SELECT *, row_number() OVER (PARTITION BY side, feature, tail ORDER BY v DESC) AS i, count(*) OVER (PARTITION BY side, feature, tail) AS n FROM two),
th AS (SELECT side, feature, tail, v AS u FROM o WHERE i = greatest(10, floor(n * 0.05)) + 1), h AS (SELECT side, feature, tail, avg(ln(v / u)) AS h, count(*) AS m FROM two JOIN th USING (side, feature, tail) WHERE u > 1e-12 AND v > u GROUP BY ALL)""",
                 "SELECT a.feature AS key, avg(abs(a.h - b.h)) AS value FROM h a JOIN h b USING (feature, tail) WHERE a.side = 'synthetic' AND b.side = 'real' AND a.m >= 5 AND b.m >= 5 GROUP BY a.feature")


def _energy_sql(table: str, cols, group: str = "") -> str:
    """CTEs xy, xx, yy sums over a table (side, id, [group], cols)."""
    d = "sqrt(" + " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in cols) + ")"
    g, on = (f"a.{group} AS {group}, ", f" AND a.{group} = b.{group}") if group else ("", "")
    by = f" GROUP BY a.{group}" if group else ""
    q = lambda name, s1, s2, extra: f"{name} AS (SELECT {g}sum({d}) AS v FROM {table} a, {table} b WHERE a.side = '{s1}' AND b.side = '{s2}'{on}{extra}{by})"
    return ", ".join((q("xy", "synthetic", "real", ""), q("xx", "synthetic", "synthetic", " AND a.id < b.id"), q("yy", "real", "real", " AND a.id < b.id")))


def _energy() -> str:
    sd = " + ".join(f"stddev_pop({_side(f, 'real')})" for f in FEATURES)
    return final(FLAT + ", e AS (SELECT *, rn AS id FROM flat WHERE rn <= 5000), " + _energy_sql("e", FEATURES) + f", z AS (SELECT count(*) FILTER (side = 'synthetic') AS s, count(*) FILTER (side = 'real') AS r, ({sd}) / {len(FEATURES)} AS scale FROM e), "
                 "en AS (SELECT greatest(2 * xy.v / (s * r) - 2 * xx.v / (s * (s - 1)) - 2 * yy.v / (r * (r - 1)), 0) AS e, scale FROM xy, xx, yy, z)", "SELECT 'raw_energy' AS key, e AS value FROM en UNION ALL SELECT 'scale', scale FROM en", "SELECT 'overall', e / (scale + 1e-10) FROM en")


def _c2st() -> str:
    z = ", ".join(f"({f} - avg({f}) OVER ()) / (stddev_pop({f}) OVER () + 1e-12) AS {f}" for f in FEATURES)
    d = " + ".join(f"pow(a.{f} - b.{f}, 2)" for f in FEATURES)
    return final(FLAT + f""", n AS (SELECT least(1500, min(c)) AS n FROM (SELECT count(*) AS c FROM flat GROUP BY side)), pt AS (SELECT rn * 2 + (side = 'real')::INT AS id, (side = 'real')::INT AS label, {', '.join(FEATURES)} FROM flat, n WHERE rn <= n),
z AS MATERIALIZED (SELECT id, label, {z} FROM pt), nn AS (SELECT a.id, any_value(a.label) AS label, min_by(b.label, [{d}, b.id::DOUBLE], 5) AS near FROM z a, z b WHERE a.id <> b.id GROUP BY a.id),
acc AS (SELECT avg(CASE WHEN (list_sum(near) / 5.0 >= 0.5)::INT = label THEN 1.0 ELSE 0.0 END) AS acc FROM nn)""", "SELECT 'accuracy' AS key, acc AS value FROM acc", "SELECT 'overall', abs(2 * acc - 1) FROM acc")


def _lagged(ctes: str, lags, key: str, value: str, by_feature: bool = True, horizon: str = "") -> str:
    """Rows |synthetic - real| of an aggregate `value` over (side, feature, k) of table j."""
    g = ctes + f", a AS (SELECT feature, k, side, {value} AS c FROM j GROUP BY ALL), gap AS (SELECT feature, k, abs(max(c) FILTER (side = 'synthetic') - max(c) FILTER (side = 'real')) AS v FROM a GROUP BY ALL)"
    return final(g, "SELECT feature AS key, avg(v) AS value FROM gap GROUP BY feature" if by_feature else "SELECT feature || '@' || k AS key, v AS value FROM gap")


def _lags(lags) -> str:
    return "lags AS (SELECT unnest([" + ", ".join(map(str, lags)) + "]) AS k)"


def _acf(lags, power: int, ctes: str = PLONG, table: str = "long") -> str:
    v = "v" if power == 1 else "v * v"
    return _lagged(ctes + f", {_lags(lags)}, x AS (SELECT side, path, t, feature, {v} - avg({v}) OVER (PARTITION BY side, path, feature) AS x FROM {table}), den AS (SELECT side, path, feature, sum(x * x) AS d FROM x GROUP BY ALL), "
                   "num AS (SELECT a.side, a.path, a.feature, k, sum(a.x * b.x) AS s FROM x a, lags, x b WHERE a.side = b.side AND a.path = b.path AND a.feature = b.feature AND b.t = a.t + k GROUP BY ALL), "
                   "j AS (SELECT side, feature, k, CASE WHEN d < 1e-12 THEN 0 ELSE s / d END AS acf FROM num JOIN den USING (side, path, feature))", lags, "feature", "avg(acf)")


LAGGED = "l AS (SELECT a.side, a.path, a.feature, k, a.v AS x, b.v AS y FROM long a, lags, long b WHERE a.side = b.side AND a.path = b.path AND a.feature = b.feature AND b.t = a.t + k)"


def _leverage() -> str:
    return _lagged(PLONG + f", {_lags((1, 2, 5, 10))}, {LAGGED}, j AS (SELECT side, path, feature, k, CASE WHEN stddev_pop(x) >= 1e-10 AND stddev_pop(abs(y)) >= 1e-10 THEN corr(x, abs(y)) END AS c0 FROM l GROUP BY ALL)", None, "", "avg(c0)")


def _pooled(lags, expr: str, by_feature: bool = True) -> str:
    return _lagged(PLONG + f", {_lags(lags)}, {LAGGED}, j AS (SELECT * FROM l)", lags, "", expr, by_feature)


def _extreme() -> str:
    return _lagged(PLONG + f", q AS (SELECT side, feature, quantile_cont(abs(v), 0.95) AS q FROM long GROUP BY ALL), {_lags((1,))}, j AS (SELECT a.side, a.feature, k, (abs(a.v) > q)::INT::DOUBLE AS x, (abs(b.v) > q)::INT::DOUBLE AS y FROM long a JOIN q USING (side, feature), lags, long b WHERE a.side = b.side AND a.path = b.path AND a.feature = b.feature AND b.t = a.t + k)", None, "", "coalesce(corr(x, y), 0)")


def _persistence() -> str:
    return final(PLONG + """, q AS (SELECT side, feature, quantile_cont(abs(v), 0.8) AS q FROM long GROUP BY ALL), e AS (SELECT side, path, feature, t - row_number() OVER (PARTITION BY side, path, feature ORDER BY t) AS island FROM long JOIN q USING (side, feature) WHERE abs(v) > q),
runs AS (SELECT side, path, feature, island, count(*) AS n FROM e GROUP BY ALL), m AS (SELECT side, feature, avg(n) AS m FROM runs GROUP BY ALL)""", "SELECT a.feature AS key, abs(a.m - b.m) / (b.m + 1e-9) AS value FROM m a JOIN m b USING (feature) WHERE a.side = 'synthetic' AND b.side = 'real'")


def _aggregational() -> str:
    per = " UNION ALL ".join(f"SELECT side, feature, {tau} AS tau, sum(v) AS v FROM long WHERE t < {60 // tau * tau} GROUP BY side, path, feature, t // {tau}" for tau in (1, 5, 10))
    return final(PLONG + f", s AS ({per}), k AS (SELECT side, feature, tau, kurtosis_pop(v) AS k FROM s GROUP BY ALL)", "SELECT a.feature || '@' || a.tau AS key, abs(a.k - b.k) AS value FROM k a JOIN k b USING (feature, tau) WHERE a.side = 'synthetic' AND b.side = 'real'")


def _heavy() -> str:
    return final(PLONG + ", w AS (SELECT side, feature, t, v, stddev_pop(v) OVER (PARTITION BY side, path, feature ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS s FROM long), k AS (SELECT side, feature, kurtosis_pop(v / s) AS k FROM w WHERE t >= 5 AND s > 1e-12 GROUP BY ALL)",
                 "SELECT a.feature AS key, abs(a.k - b.k) AS value FROM k a JOIN k b USING (feature) WHERE a.side = 'synthetic' AND b.side = 'real'")


def _variance_term() -> str:
    return final(PLONG + ", c AS (SELECT side, t, feature, sum(v) OVER (PARTITION BY side, path, feature ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM long), q AS (SELECT side, t, feature, var_pop(c) AS v FROM c GROUP BY ALL)",
                 "SELECT a.feature AS key, avg(abs(ln((a.v + 1e-12) / (b.v + 1e-12)))) AS value FROM q a JOIN q b USING (t, feature) WHERE a.side = 'synthetic' AND b.side = 'real' GROUP BY a.feature")


def _drawdown() -> str:
    return final(_ks(PLONG + ", r0 AS (SELECT side, path, feature, v AS x, max(v) OVER (PARTITION BY side, path, feature ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM long), dd AS (SELECT side, path, feature, max((m - x) / greatest(m, 1e-10)) AS v FROM r0 GROUP BY ALL)", "dd"), "SELECT feature AS key, max(abs(fa - fb)) AS value FROM kr GROUP BY feature")


def _signature() -> str:
    ch = ("time", *PATHS)
    inc = ", ".join(f"{c} - lag({c}) OVER w AS {c}" for c in ch)
    run = ", ".join(f"coalesce(sum({c}) OVER (PARTITION BY side, path ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r_{c}" for c in ch)
    names = [f"s_{c}" for c in ch] + [f"s_{a}_{b}" for a in ch for b in ch]
    agg = ", ".join([f"round(sum({c}), 12) AS s_{c}" for c in ch] + [f"round(sum(r_{a} * {b}), 12) AS s_{a}_{b}" for a in ch for b in ch])
    std = ", ".join(f"(s.{n} - l_{n} - avg(CASE WHEN side = 'real' THEN s.{n} - l_{n} END) OVER ()) / (stddev_pop(CASE WHEN side = 'real' THEN s.{n} END) OVER () + 1e-12) AS {n}" for n in names)
    low = ", ".join(f"min(CASE WHEN side = 'real' THEN {n} END) OVER () AS l_{n}" for n in names)
    norm = "sqrt(" + " + ".join(f"{n} * {n}" for n in names) + ")"
    return final(PATH + f""", tt AS (SELECT side, path, t, t / 59.0::DOUBLE AS time, price, quantity FROM p), i AS (SELECT side, path, t, {inc} FROM tt WINDOW w AS (PARTITION BY side, path ORDER BY t)), ii AS (SELECT * FROM i WHERE t > 0), rr AS (SELECT *, {run} FROM ii),
s0 AS (SELECT side, path, {agg} FROM rr GROUP BY side, path), s1 AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY side ORDER BY path) <= 1500), s AS MATERIALIZED (SELECT *, {low} FROM s1), e AS MATERIALIZED (SELECT side, path AS id, {std} FROM s), {_energy_sql('e', names)},
z AS (SELECT count(*) FILTER (side = 'synthetic') AS s, count(*) FILTER (side = 'real') AS r, avg({norm}) FILTER (side = 'real') AS norm FROM e), en AS (SELECT greatest(2 * xy.v / (z.s * z.r) - 2 * xx.v / (z.s * (z.s - 1)) - 2 * yy.v / (z.r * (z.r - 1)), 0) AS e, norm FROM xy, xx, yy, z)""",
                 "SELECT 'energy' AS key, e AS value FROM en UNION ALL SELECT 'norm', norm FROM en", "SELECT 'overall', e / (norm + 1e-9) FROM en")


def _regime() -> str:
    sd = "(stddev_pop(CASE WHEN side = 'real' THEN price END) + stddev_pop(CASE WHEN side = 'real' THEN quantity END)) / 2"
    return final(PATH + f""", vol AS (SELECT side, path, sqrt(sum(price * price + quantity * quantity) / (2 * count(*))) AS v FROM p GROUP BY ALL), q AS (SELECT quantile_cont(v, 1 / 3.0::DOUBLE) AS q1, quantile_cont(v, 2 / 3.0::DOUBLE) AS q2 FROM vol WHERE side = 'real'),
b AS (SELECT side, path, (v >= q1)::INT + (v >= q2)::INT AS regime FROM vol, q), sh AS (SELECT regime, count(*) FILTER (side = 'synthetic') / (SELECT count(*) FROM b WHERE side = 'synthetic')::DOUBLE AS s, count(*) FILTER (side = 'real') / (SELECT count(*) FROM b WHERE side = 'real')::DOUBLE AS r FROM b GROUP BY regime),
mass AS (SELECT sum(abs(s - r)) / 2 AS mass FROM sh), e AS MATERIALIZED (SELECT * FROM (SELECT side, regime, row_number() OVER (PARTITION BY side, regime ORDER BY path, t) AS id, price, quantity FROM p JOIN b USING (side, path)) WHERE id <= 5000), {_energy_sql('e', PATHS, 'regime')},
z AS (SELECT regime, count(*) FILTER (side = 'synthetic') AS s, count(*) FILTER (side = 'real') AS r, {sd} AS scale FROM e GROUP BY regime),
en AS (SELECT regime, CASE WHEN s < 50 OR r < 50 THEN 1.0 ELSE greatest(2 * xy.v / (s * r) - 2 * xx.v / (s * (s - 1)) - 2 * yy.v / (r * (r - 1)), 0) / (scale + 1e-10) END AS v FROM z LEFT JOIN xy USING (regime) LEFT JOIN xx USING (regime) LEFT JOIN yy USING (regime)),
ev AS (SELECT k AS regime, coalesce(v, 1.0) AS v FROM (SELECT unnest([0, 1, 2]) AS k) LEFT JOIN en ON regime = k)""",
                 "SELECT 'regime_' || regime AS key, v AS value FROM ev UNION ALL SELECT 'mass_error', mass FROM mass", "SELECT 'overall', (SELECT sum(v * [0.25, 0.30, 0.45][regime + 1]) FROM ev) + 0.5 * mass FROM mass")


def _memorization() -> str:
    return final(PATH + """, pick AS (SELECT side, path FROM (SELECT DISTINCT side, path FROM p) QUALIFY row_number() OVER (PARTITION BY side ORDER BY path) <= 2000), sd AS (SELECT stddev_pop(price) + 1e-12 AS dp, stddev_pop(quantity) + 1e-12 AS dq FROM p JOIN pick USING (side, path) WHERE side = 'real'),
v AS MATERIALIZED (SELECT side, path, list(price / dp ORDER BY t) || list(quantity / dq ORDER BY t) AS v FROM p JOIN pick USING (side, path), sd GROUP BY side, path),
rr AS (SELECT a.path, min(list_distance(a.v, b.v)) AS d FROM v a, v b WHERE a.side = 'real' AND b.side = 'real' AND a.path <> b.path GROUP BY a.path), sr AS (SELECT a.path, min(list_distance(a.v, b.v)) AS d FROM v a, v b WHERE a.side = 'synthetic' AND b.side = 'real' GROUP BY a.path),
q AS (SELECT quantile_cont(d, 0.5) AS mr, quantile_cont(d, 0.05) AS q05 FROM rr), o AS (SELECT quantile_cont(d, 0.5) / (any_value(mr) + 1e-12) AS ratio, avg((d < q05)::INT) AS near FROM sr, q)""",
                 "SELECT 'nn_ratio' AS key, ratio AS value FROM o UNION ALL SELECT 'near_duplicate_fraction', near FROM o", "SELECT 'overall', greatest(1 - ratio, 0) FROM o")


def _pit() -> str:
    return f"WITH {CELLS}, k AS (SELECT feature AS key, pit FROM cells UNION ALL SELECT 'overall', pit FROM cells), i AS (SELECT key, pit, row_number() OVER (PARTITION BY key ORDER BY pit) AS i, count(*) OVER (PARTITION BY key) AS n FROM k) SELECT key, round(max(greatest(i / n::DOUBLE - pit, pit - (i - 1) / n::DOUBLE)), 6) AS value FROM i GROUP BY key"


CRPS = CELLS + ", sd AS (SELECT feature, stddev_pop(y) AS sd FROM al GROUP BY feature), cr AS (SELECT feature AS key, avg(crps) / (any_value(sd) + 1e-10) AS value FROM cells JOIN sd USING (feature) GROUP BY feature)"


def _coverage(level: float, lo: str, hi: str) -> str:
    return final(CELLS, f"SELECT feature AS key, avg((y >= {lo} AND y <= {hi})::INT) AS value FROM cells GROUP BY feature", f"SELECT 'overall', avg(abs(value - {level})) FROM r")


def _pools(axis: str, tag: str) -> str:
    d = "sqrt(pow(a.price - b.price, 2) + pow(a.quantity - b.quantity, 2))"
    out = f"big_{tag} AS (SELECT label FROM labels JOIN actuals USING (obs) WHERE axis = '{axis}' GROUP BY label HAVING count(*) >= 15)"
    for side, source, order in (("r", "actuals", "obs"), ("m", "samples", "obs, sample")):
        t = f"{side}_{tag}"
        out += f""", p_{t} AS MATERIALIZED (SELECT label, row_number() OVER (PARTITION BY label ORDER BY {order}) AS id, price, quantity FROM {source} JOIN labels USING (obs) JOIN big_{tag} USING (label) WHERE axis = '{axis}' QUALIFY id <= 2000),
x_{t} AS (SELECT a.label AS la, b.label AS lb, sum({d}) AS v FROM p_{t} a, p_{t} b WHERE a.label < b.label GROUP BY ALL), i_{t} AS (SELECT a.label, sum({d}) AS v FROM p_{t} a JOIN p_{t} b ON a.label = b.label AND a.id < b.id GROUP BY ALL),
n_{t} AS (SELECT label, n, 2 * coalesce(v, 0) / (n * (n - 1)) AS s FROM (SELECT label, count(*) AS n FROM p_{t} GROUP BY label) LEFT JOIN i_{t} USING (label)),
d_{t} AS (SELECT avg(greatest(2 * v / (a.n * b.n) - a.s - b.s, 0)) AS d FROM x_{t} JOIN n_{t} a ON a.label = la JOIN n_{t} b ON b.label = lb)"""
    return out + f", o_{tag} AS (SELECT r.d AS d_real, m.d AS d_model, CASE WHEN r.d >= 1e-9 THEN abs(ln((m.d + 1e-9 + 1e-3 * r.d) / (r.d + 1e-9 + 1e-3 * r.d))) END AS v FROM d_r_{tag} r, d_m_{tag} m)"


STRAT = CRPS + """, bl AS (SELECT label FROM labels JOIN actuals USING (obs) WHERE axis = 'vol' GROUP BY label HAVING count(*) >= 15), cl AS (SELECT cells.*, label FROM cells JOIN labels USING (obs) JOIN bl USING (label) WHERE axis = 'vol'),
sl2 AS (SELECT label, feature, stddev_pop(y) AS sd FROM al JOIN labels USING (obs) JOIN bl USING (label) WHERE axis = 'vol' GROUP BY ALL), crl AS (SELECT label, avg(v) AS value FROM (SELECT label, feature, avg(crps) / (any_value(sd) + 1e-10) AS v FROM cl JOIN sl2 USING (label, feature) GROUP BY ALL) GROUP BY label),
pil AS (SELECT label, max(greatest(i / n::DOUBLE - pit, pit - (i - 1) / n::DOUBLE)) AS value FROM (SELECT label, pit, row_number() OVER (PARTITION BY label ORDER BY pit) AS i, count(*) OVER (PARTITION BY label) AS n FROM cl) GROUP BY label),
col AS (SELECT label, avg(v) AS value FROM (SELECT label, feature, abs(avg((y >= q05 AND y <= q95)::INT) - 0.9) AS v FROM cl GROUP BY ALL) GROUP BY label),
po AS (SELECT avg(value) AS v FROM cr), ga AS (SELECT greatest((SELECT max(value) FROM crl) - v, 0) AS v FROM po)"""


def _points() -> str:
    return """raw AS (SELECT CASE WHEN label < 5 THEN 'real' ELSE 'synthetic' END AS side, vec_id, embedding::DOUBLE[] AS v FROM embeddings), pick AS (SELECT side, row_number() OVER (PARTITION BY side ORDER BY vec_id) AS id, v FROM raw QUALIFY id <= 2000),
cell AS (SELECT side, id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM pick), mo AS (SELECT i, avg(x) AS m, stddev_pop(x) + 1e-12 AS d FROM cell WHERE side = 'real' GROUP BY i),
z AS MATERIALIZED (SELECT side, id, list((x - m) / d ORDER BY i) AS v FROM cell JOIN mo USING (i) GROUP BY side, id),
rad AS (SELECT id, d AS radius FROM (SELECT a.id, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v)) AS n FROM z a, z b WHERE a.side = 'real' AND b.side = 'real' AND a.id <> b.id) WHERE n = 6),
hit AS (SELECT a.id, count(*) FILTER (list_distance(a.v, b.v) <= radius) AS n FROM z a JOIN rad USING (id), z b WHERE a.side = 'real' AND b.side = 'synthetic' GROUP BY a.id),
dc AS (SELECT sum(n) / (5 * (SELECT count(*) FROM z WHERE side = 'synthetic'))::DOUBLE AS density, avg((n > 0)::INT) AS coverage FROM hit)"""


SUB = PATH + ", p30 AS (SELECT side, path * 2 + t // 30 AS path, t % 30 AS t, price, quantity FROM p), long AS (SELECT side, path, t, feature, v FROM p30 UNPIVOT (v FOR feature IN (price, quantity)))"


def _hash(parts: str) -> str:
    return f"(('0x' || substr(md5({parts}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


BASE = FLAT + ", base AS (SELECT rn - 1 AS idx, l_quantity, l_extendedprice, l_discount, l_tax FROM flat WHERE side = 'real'), n AS (SELECT count(*) AS n FROM base)"
HISTORICAL = f"WITH {BASE}, d AS (SELECT i AS row, floor({_hash("'42|' || i")} * n)::BIGINT AS idx FROM range(2000) t(i), n) SELECT row, idx, l_quantity, l_extendedprice, l_discount, l_tax FROM d JOIN base USING (idx)"
BLOCK = f"WITH {BASE}, s AS (SELECT i AS path, b, floor({_hash("'42|' || i || '|' || b")} * (n - 19))::BIGINT AS s FROM range(20) t(i), range(3) u(b), n), d AS (SELECT path, (b * 20 + k)::INT AS t, s + k AS idx FROM s, range(20) v(k)) SELECT path, t, idx, l_quantity, l_extendedprice, l_discount, l_tax FROM d JOIN base USING (idx)"


def _normal(j: int) -> str:
    u, v = (_hash(f"'42|' || i || '|{j}|{c}'") for c in "uv")
    return f"sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v})"


GAUSS = f"""WITH {PATH}, m AS (SELECT avg(price) AS mp, avg(quantity) AS mq, var_samp(price) + 1e-10 AS a, covar_samp(price, quantity) AS b, var_samp(quantity) + 1e-10 AS c FROM p WHERE side = 'real'),
z AS (SELECT i AS row, {_normal(0)} AS z0, {_normal(1)} AS z1 FROM range(2000) t(i)) SELECT row, round(mp + sqrt(a) * z0, 6) AS price, round(mq + b / sqrt(a) * z0 + sqrt(c - b * b / a) * z1, 6) AS quantity FROM z, m"""


def _ci(block: int) -> str:
    sides = []
    for side, odd in (("real", 0), ("synthetic", 1)):
        sides.append(f"""b_{side} AS (SELECT row_number() OVER (ORDER BY obs) - 1 AS idx, price FROM actuals WHERE obs % 2 = {odd}), n_{side} AS (SELECT count(*) AS n FROM b_{side}),
m_{side} AS (SELECT rep, avg(price) AS m FROM (SELECT rep, floor({_hash(f"'42|{side}|' || rep || '|' || j")} * greatest(n - {block} + 1, 1))::BIGINT + k AS idx FROM n_{side}, range(200) t(rep), range(100000) u(j), range({block}) v(k) WHERE j < ceil(n / {block}.0) AND j * {block} + k < n) JOIN b_{side} USING (idx) GROUP BY rep)""")
    return f"WITH {FORE}, {', '.join(sides)} SELECT round(quantile_cont(abs(s.m - r.m), 0.025), 4) AS low, round(quantile_cont(abs(s.m - r.m), 0.975), 4) AS high, count(*) AS n FROM m_real r JOIN m_synthetic s USING (rep)"


ORACLE: dict[str, str] = {
    "marginal_ks": final(_ks(LONG, "long"), "SELECT feature AS key, max(abs(fa - fb)) AS value FROM kr GROUP BY feature"),
    "energy_distance": _energy(),
    "tail_quantiles": _tails("0.01, 0.05, 0.95, 0.99", "greatest(sd, 1e-10)"),
    "far_tail_quantiles": _tails("0.005, 0.995", "(sd + 1e-12)"),
    "tail_heaviness": final(LONG + ", k AS (SELECT feature, side, kurtosis_pop(v) AS k FROM long GROUP BY ALL)", "SELECT a.feature AS key, abs(a.k - b.k) AS value FROM k a JOIN k b USING (feature) WHERE a.side = 'synthetic' AND b.side = 'real'"),
    "marginal_skew": _skew(), "hill_tail_index": _hill(), "c2st": _c2st(),
    "pearson_corr": _corrs(FLAT, "flat", FEATURES), "spearman_corr": _corrs(RANKS, "ranks", FEATURES), "copula_distance": _copula(),
    "tail_dependence_upper": _tail_dep("upper"), "tail_dependence_lower": _tail_dep("lower"), "tail_dependence_asymmetry": _asym(), "correlation_breakdown": _breakdown(), "covariance_calibration": _calibration(),
    "coskewness": _coskew(), "variogram_score": _variogram(),
    "acf_returns": _acf((1, 5, 10, 20), 1), "volatility_clustering": _acf((1, 2, 3, 4, 5), 2), "subwindow": _acf((1, 2, 3, 4, 5), 2, SUB), "leverage_effect": _leverage(), "cross_correlation": _corrs(PATH, "p", PATHS),
    "variance_term_structure": _variance_term(), "extreme_clustering": _extreme(), "long_memory": _pooled((20, 50), "coalesce(corr(abs(x), abs(y)), 0)", False),
    "time_reversal_asymmetry": _pooled((1, 2, 5), "coalesce(corr(x, abs(y)), 0) - coalesce(corr(y, abs(x)), 0)"), "regime_persistence": _persistence(), "aggregational_gaussianity": _aggregational(),
    "conditional_heavy_tails": _heavy(), "drawdown_distribution": _drawdown(), "signature_distance": _signature(), "regime_conditional": _regime(), "memorization": _memorization(),
    "pit_uniformity": _pit(), "crps": f"WITH {CRPS} SELECT key, round(value, 6) AS value FROM (SELECT * FROM cr UNION ALL SELECT 'overall', avg(value) FROM cr)",
    "coverage_50": _coverage(0.5, "q25", "q75"), "coverage_90": _coverage(0.9, "q05", "q95"), "coverage_95": _coverage(0.95, "q025", "q975"),
    "conditional_sensitivity": final(f"{FORE}, {_pools('vol', 'v')}", "SELECT 'd_real' AS key, d_real AS value FROM o_v UNION ALL SELECT 'd_model', d_model FROM o_v", "SELECT 'overall', v FROM o_v"),
    "multi_axis_sensitivity": final(f"{FORE}, {_pools('vol', 'v')}, {_pools('trend', 't')}", "SELECT 'conditional_sensitivity@vol' AS key, v AS value FROM o_v UNION ALL SELECT 'conditional_sensitivity@trend', v FROM o_t", "SELECT 'overall', max(value) FROM r"),
    "stratified_calibration": f"WITH {STRAT} SELECT key, round(value, 6) AS value FROM (SELECT 'crps@' || label AS key, value FROM crl UNION ALL SELECT 'pit_uniformity@' || label, value FROM pil UNION ALL SELECT 'coverage_90@' || label, value FROM col UNION ALL SELECT 'pooled_crps', v FROM po UNION ALL SELECT 'gap', v FROM ga)",
    "within_regime_calibration_gap": f"WITH {STRAT} SELECT key, round(value, 6) AS value FROM (SELECT 'pooled_crps' AS key, v AS value FROM po UNION ALL SELECT 'overall', v FROM ga)",
    "density_coverage": final(_points(), "SELECT 'density' AS key, density AS value FROM dc UNION ALL SELECT 'coverage', coverage FROM dc", "SELECT 'overall', coverage FROM dc"),
    "coverage_deficit": final(_points(), "SELECT 'coverage' AS key, coverage AS value FROM dc", "SELECT 'overall', greatest(1 - coverage, 0) FROM dc"),
    "plausibility_deficit": final(_points(), "SELECT 'density' AS key, density AS value FROM dc", "SELECT 'overall', greatest(1 - density, 0) FROM dc"),
    "path_features": f"""WITH {PLONG}, c AS (SELECT *, sum(v) OVER (PARTITION BY side, path, feature ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM long), m AS (SELECT *, c - max(c) OVER (PARTITION BY side, path, feature ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fall, avg(v) OVER (PARTITION BY side, path, feature) AS mu, stddev_pop(v) OVER (PARTITION BY side, path, feature) AS sd FROM c),
f AS (SELECT side, path, feature, sum(v) AS cum, any_value(sd) AS vol, min(fall) AS mdd, avg(pow((v - mu) / (sd + 1e-12), 3)) AS skew FROM m GROUP BY ALL)
SELECT a.side, a.path, round(a.cum, 6) AS cum_price, round(b.cum, 6) AS cum_quantity, round(a.vol, 6) AS vol_price, round(b.vol, 6) AS vol_quantity, round(a.mdd, 6) AS mdd_price, round(b.mdd, 6) AS mdd_quantity, round(a.skew, 6) AS skew_price, round(b.skew, 6) AS skew_quantity FROM f a JOIN f b USING (side, path) WHERE a.feature = 'price' AND b.feature = 'quantity'""",
    "historical_bootstrap": HISTORICAL, "block_bootstrap": BLOCK, "gaussian_baseline": GAUSS, "iid_bootstrap_ci": _ci(1), "block_bootstrap_ci": _ci(20),
}

ORACLE["log_returns"] = """SELECT o_custkey, o_orderkey, round(ln(greatest(o_totalprice, 1e-9)) - ln(greatest(before, 1e-9)), 6) AS log_return
FROM (SELECT o_custkey, o_orderkey, o_totalprice::DOUBLE AS o_totalprice, lag(o_totalprice::DOUBLE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE before IS NOT NULL"""
ORACLE["marginal_ks_p_values"] = final(_ks(LONG, "long"), """SELECT key, CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(list_sum([CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * x * x) FOR j IN range(1, 101)]), 0), 1) END AS value
FROM (SELECT feature AS key, max(abs(fa - fb)) * any_value(sqrt(na * nb / (na + nb))) AS x FROM kr JOIN (SELECT feature, count(*) FILTER (side = 'real')::DOUBLE AS na, count(*) FILTER (side = 'synthetic')::DOUBLE AS nb FROM long GROUP BY feature) USING (feature) GROUP BY feature)""", "SELECT 'overall', min(value) FROM r")

_VALUE = "(SELECT value FROM ({sql}) WHERE key = 'overall')"


def _unrounded(m: str) -> str:
    """A metric's statement without the rounding of what it shows: scores are of the values themselves."""
    return ORACLE[m].replace("round(value, 6) AS value", "value")


def _seeded_c2st() -> str:
    """c2st on the rows of least hash by seed 0, as the operator takes them unless told otherwise."""
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    parts = " || '|' || ".join(("'0'", *columns))
    return _unrounded("c2st").replace("ORDER BY l_orderkey", f"ORDER BY {_hash(parts)}, l_orderkey")


def _with_reports() -> None:
    """The entry points' reports: every metric by its own statement, scored and graded."""
    from .api import CALIBRATION, FLAT, PATH
    from .scoring import LENS_SCORED, LENS_WEIGHTS, absolute_weights, thresholds_of

    w, own = absolute_weights(), {"c2st": _seeded_c2st(), "conditional_sensitivity": _unrounded("multi_axis_sensitivity")}

    def scored(values: dict[str, str]) -> str:
        out = []
        for m, value in values.items():
            e, g, a = thresholds_of(m)
            lens, lw = LENS_SCORED.get(m, ("", 0.0))
            out.append(f"SELECT '{m}' AS metric, {value}::DOUBLE AS value, {e}::DOUBLE AS e, {g}::DOUBLE AS g, {a}::DOUBLE AS a, {w.get(m, 0.0)}::DOUBLE AS w, '{lens}' AS lens, {lw}::DOUBLE AS lw")
        return "v AS MATERIALIZED (" + " UNION ALL ".join(out) + """), s AS (SELECT *, CASE WHEN value IS NULL OR NOT isfinite(value) THEN 0 WHEN value <= e THEN 1 - 0.1 * greatest(value, 0) / e WHEN value <= g THEN 0.9 - 0.2 * (value - e) / (g - e) WHEN value <= a THEN 0.7 - 0.2 * (value - g) / (a - g) ELSE 0.5 * exp(-(value - a) / (a - e)) END AS score,
CASE WHEN value IS NULL OR NOT isfinite(value) THEN 'poor' WHEN value < e THEN 'excellent' WHEN value < g THEN 'good' WHEN value < a THEN 'acceptable' ELSE 'poor' END AS quality FROM v)"""

    def of(names) -> dict[str, str]:
        return {m: _VALUE.format(sql=own.get(m) or _unrounded(m)) for m in names}

    shown = "SELECT metric, round(value, 6) AS value, round(score, 5) AS score, quality FROM s"
    ORACLE["validate"] = f"WITH {scored(of(FLAT))} {shown}"
    ORACLE["validate_report"] = f"WITH {scored(of(FLAT))}, o AS (SELECT sum(score * w) / sum(w) AS x, avg((quality <> 'poor')::INT) AS p FROM s) SELECT round(x, 5) AS overall_score, CASE WHEN x >= 0.85 THEN 'excellent' WHEN x >= 0.65 THEN 'good' WHEN x >= 0.45 THEN 'acceptable' ELSE 'poor' END AS overall_quality, round(p, 6) AS pass_rate FROM o"
    ORACLE["validate_paths"] = f"WITH {scored(of(PATH))} {shown}"
    ORACLE["validate_calibration"] = f"WITH {scored(of(CALIBRATION))} {shown}"
    ORACLE["validate_generative"] = f"WITH {scored(of(('coverage_deficit', 'plausibility_deficit')))} {shown}"
    at = lambda m, key: f"(SELECT value FROM ({_unrounded(m)}) WHERE key = '{key}')"
    conditional = {f"conditional_sensitivity@{x}": at("multi_axis_sensitivity", f"conditional_sensitivity@{x}") for x in ("trend", "vol")} | of(("conditional_sensitivity", "within_regime_calibration_gap"))
    conditional |= {f"{m}@{r}": at("stratified_calibration", f"{m}@{r}") for m in ("crps", "pit_uniformity", "coverage_90") for r in ("low", "mid", "high")}
    ORACLE["validate_conditional"] = f"WITH {scored(conditional)} {shown}"
    lens = "CASE lens " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LENS_WEIGHTS.items()) + " END"
    ORACLE["lens_report"] = f"WITH {scored(of(LENS_SCORED))}, l AS (SELECT lens, sum(lw * score) / sum(lw) AS score FROM s GROUP BY lens) SELECT lens, round(score, 5) AS score FROM (SELECT lens, score FROM l UNION ALL SELECT 'overall', sum({lens} * score) / sum({lens}) FROM l)"


_with_reports()

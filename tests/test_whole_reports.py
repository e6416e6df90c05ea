"""The entry points as queries: no metric is left out, scores and grades agree with their SQL. The metrics' own values have queries of their own, but for the seeded c2st."""

import duckdb
import pytest

from plumbline.operators import joint
from plumbline.plans import api, catalogue, oracle
from plumbline.plans.scoring import LENS_SCORED, LENS_WEIGHTS, Result
from plumbline.sources import panels


@pytest.fixture(scope="module")
def con(sf):
    out = duckdb.connect()
    for t in ("lineitem", "part", "embeddings"):
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return out


def same(df, want):
    place = [want.columns.index(c) for c in df.columns]
    got = df.collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r[i] for i in place) for r in want.fetchall())
    return got


def test_reports_over_every_metric(spark, sf, con, monkeypatch):
    names = {*api.FLAT, *api.PATH, *api.CALIBRATION, *LENS_SCORED}
    sql = {n: oracle._unrounded(n) for n in names} | {"c2st": oracle._seeded_c2st(), "conditional_sensitivity": oracle._unrounded("multi_axis_sensitivity")}
    values = {n: dict(con.sql(q).fetchall())["overall"] for n, q in sql.items()}
    c2st = {r["key"]: r["value"] for r in joint.c2st(panels.lineitem_flat(spark, sf), n_perm=0).collect()}
    assert c2st["overall"] == pytest.approx(values["c2st"], abs=1e-9)
    monkeypatch.setattr(api, "compute", lambda name, *a, **kw: Result(name, values[name]))
    for name, key, all_of in (("validate", "metric", set(api.FLAT)), ("validate_report", None, None), ("validate_paths", "metric", set(api.PATH)), ("validate_calibration", "metric", set(api.CALIBRATION)), ("lens_report", "lens", {*LENS_WEIGHTS, "overall"})):
        got = same(catalogue.QUERIES[name](spark, sf), con.sql(oracle.ORACLE[name]))
        assert key is None or {r[key] for r in got} == all_of


@pytest.mark.parametrize("name", ["validate_calibration", "validate_conditional", "validate_generative"])
def test_entry_points_against_sql(spark, sf, con, name):
    got = same(catalogue.QUERIES[name](spark, sf), con.sql(oracle.ORACLE[name]))
    if name == "validate_conditional":
        assert {f"{m}@{r}" for m in ("crps", "pit_uniformity", "coverage_90") for r in ("low", "mid", "high")} <= {r["metric"] for r in got}

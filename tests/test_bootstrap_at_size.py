"""Resamples are dealt to the rows by place, and places do not hang on a sketch that is made twice."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import baselines


@pytest.mark.parametrize("block", [1, 4])
def test_draws_are_not_sent_to_every_task(spark, monkeypatch, block):
    monkeypatch.setattr(baselines, "DRAWS_A_TASK", 500, raising=False)
    g = np.random.default_rng(3)
    x = {s: g.normal(0, 1, n) for s, n in (("real", 203), ("synthetic", 150))}
    df = spark.createDataFrame([(s, i, float(v)) for s in x for i, v in enumerate(x[s])], "side string, i int, x double").repartition(5)
    plans = []

    def gap(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows.groupBy("rep").agg((F.avg(F.when(F.col("side") == "synthetic", F.col("x"))) - F.avg(F.when(F.col("side") == "real", F.col("x")))).alias("value"))

    got = baselines.bootstrap_ci(df, ("i",), gap, replicates=20, block=block).head()
    assert plans[0].count("ShuffledHashJoin") >= 2

    def means(s):
        n, out = len(x[s]), []
        for rep in range(20):
            idx = []
            for j in range(-(-n // block)):
                at = int(int(hashlib.md5(f"42|{s}|{rep}|{j}".encode()).hexdigest()[:8], 16) / 2**32 * (n - block + 1))
                idx += range(at, at + block)
            out.append(x[s][idx[:n]].mean())
        return np.array(out)

    assert (got["low"], got["high"]) == pytest.approx(tuple(np.quantile(means("synthetic") - means("real"), [0.025, 0.975])))
    assert got["n"] == 20


def test_places_are_cut_once(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    assert "percentile" not in baselines.numbered(df, ("a", "b"))._jdf.queryExecution().executedPlan().toString()

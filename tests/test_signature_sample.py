"""Where there are more paths than the cap, those of high ids are as likely to be seen as others."""

import numpy as np

from plumbline.operators import joint
from plumbline.sources.panels import Paths


def test_defect_of_high_paths_is_seen(spark):
    g = np.random.default_rng(8)
    real, syn = g.normal(0, 1, (120, 8)), g.normal(0, 1, (120, 8))
    syn[60:] *= 20
    rows = [(s, p, t, float(x[p, t])) for s, x in (("real", real), ("synthetic", syn)) for p in range(120) for t in range(8)]
    panel = Paths.of(spark.createDataFrame(rows, "side string, path int, t int, f0 double"), ("f0",))
    of = lambda **kw: {r["key"]: r["value"] for r in joint.signature_distance(panel, cap=40, **kw).collect()}["overall"]
    assert of() > 10 * max(of(seed=None), 0.01)

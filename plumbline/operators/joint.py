"""Omnibus tests: nearest-neighbour classifier and path signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import energy, first_rows, local, rows, uniform
from ..sources.panels import REAL, SYNTHETIC, Flat, Paths
from .generative import feature_names, path_features


def neighbours(points: DataFrame, features: tuple[str, ...], k: int) -> DataFrame:
    """(id, label, votes): the labels of each point's k nearest others, ties by id. points: id, label, features.

    The point set is capped by its callers, so it is sent to every task; each
    task finds neighbours of its own rows in blocks."""
    held = sorted(points.select("id", "label", *features).collect())
    everyone = points.sparkSession.sparkContext.broadcast((np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64), np.array([r[2:] for r in held], float).reshape(len(held), len(features))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, x = everyone.value
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                own = np.stack([part.column(i).to_numpy() for i in range(2, part.num_columns)], axis=1)
                d = np.zeros((len(part), len(x)))
                for j in range(x.shape[1]):
                    d += (own[:, j : j + 1] - x[None, :, j]) ** 2
                mine = part.column(0).to_numpy()
                d[np.arange(len(part)), np.searchsorted(ids, mine)] = np.inf
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(ids[near]), pa.list_(pa.int64())), pa.array(labels[near].sum(axis=1), pa.int64())], names=["id", "label", "near", "votes"])

    return points.select("id", "label", *features).mapInArrow(run, "id long, label int, near array<long>, votes long")


def capped_points(panel: Flat, cap: int, seed: int | None = None) -> DataFrame:
    """Complete rows, the first of each side in order, or by a seeded hash of the order columns; as many of each side; (id, label, side, features)."""
    df = panel.finite()
    if seed is not None:
        df = df.withColumn("_u", uniform(seed, *panel.order))
    order = (["_u"] if seed is not None else []) + list(panel.order)
    one = {s: df.where(F.col("side") == s).orderBy(*order).limit(cap) for s in (REAL, SYNTHETIC)}
    both = one[REAL].unionByName(one[SYNTHETIC])
    n = Window.partitionBy("side").orderBy(*order)
    both = local(both.withColumn("_n", F.row_number().over(n)).select("side", "_n", *panel.features))
    least = both.groupBy("side").count().agg(F.min("count").alias("_least"))
    both = both.join(F.broadcast(least)).where("_n <= _least")
    label = (F.col("side") == REAL).cast("int")
    return both.select((F.col("_n") * 2 + label).cast("long").alias("id"), label.alias("label"), "side", *panel.features)


def c2st(panel: Flat | Paths, k: int = 5, cap: int = 1500, n_perm: int = 100, seed: int | None = 0) -> DataFrame:
    """|2 accuracy - 1| of the leave-one-out vote of the k nearest neighbours; overall with accuracy and the permutation p-value. Paths are points of their path features. Under k + 5 complete points a side there is no overall value.

    The graph is found once; each permutation deals the labels anew by a hash."""
    if isinstance(panel, Paths):
        panel = Flat(path_features(panel), feature_names(panel), ("path",))
    points = capped_points(panel, cap, seed)
    m = points.agg(*[g(f).alias(f"{n}{f}") for f in panel.features for n, g in (("m_", F.avg), ("s_", F.stddev_pop))], F.count("*").alias("_n"))
    z = points.join(F.broadcast(m)).select("id", "label", *[((F.col(f) - F.col(f"m_{f}")) / (F.col(f"s_{f}") + 1e-12)).alias(f) for f in panel.features])
    graph = neighbours(z, panel.features, k)
    right = ((F.col("votes") / F.lit(float(k)) >= 0.5).cast("int") == F.col("label")).cast("double")
    if not n_perm:
        return rows(graph.agg(F.avg(right).alias("acc"), F.count("*").alias("n")), {"accuracy": F.col("acc")}, F.when(F.col("n") >= 2 * (k + 5), F.abs(2 * F.col("acc") - 1)))
    graph = graph.select("id", "label", "near", "votes")
    seen = graph.agg(F.avg(right).alias("acc"))
    held = graph.collect()  # at most 2 * cap rows
    if len(held) < 2 * (k + 5):
        return rows(seen, {"accuracy": F.col("acc")}, F.lit(None).cast("double"))
    ids = np.array([r[0] for r in held])
    order = np.argsort(ids)
    place = np.searchsorted(ids[order], np.array([r[2] for r in held]))
    labels = np.array([r[1] for r in held])[order]
    rng = np.random.default_rng(seed)
    acc = float(seen.head()[0])
    null = []
    for _ in range(n_perm):
        p = rng.permutation(labels)
        vote = p[place].mean(axis=1) >= 0.5
        null.append(abs(2 * float((vote == p[order.argsort()].astype(bool)).mean()) - 1))
    p = (sum(x >= abs(2 * acc - 1) for x in null) + 1) / (n_perm + 1)
    return rows(seen, {"accuracy": F.col("acc"), "p_value": F.lit(p)}, F.abs(2 * F.col("acc") - 1))


def signature_features(paths: Paths) -> tuple[DataFrame, tuple[str, ...]]:
    """Levels 1 and 2 of the signature of each path with time put before its features: increments, and sums of strict running increments times increments."""
    w = paths.window()
    h = Window.partitionBy("side", "path")
    channels = ("time", *paths.features)
    x = paths.df.withColumn("time", F.col("t") / F.greatest(F.max("t").over(h), F.lit(1)))
    x = x.select("side", "path", "t", *[(F.col(c) - F.lag(c).over(w)).alias(c) for c in channels]).where("t > 0")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({f"_{c}": F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in channels})
    first = [F.sum(c).alias(f"s_{c}") for c in channels]
    second = [F.sum(F.col(f"_{a}") * F.col(b)).alias(f"s_{a}_{b}") for a in channels for b in channels]
    names = tuple([f"s_{c}" for c in channels] + [f"s_{a}_{b}" for a in channels for b in channels])
    return x.groupBy("side", "path").agg(*first, *second), names


def signature_distance(paths: Paths, cap: int = 1500, seed: int | None = 0) -> DataFrame:
    """Energy distance of signature features, standardised by the real side, over their mean real length; of a side of more than `cap` paths, those of least seeded hash (seed=None: of least id)."""
    x, names = signature_features(paths)
    order = ["_u", "path"] if seed is not None else ["path"]
    x = x.withColumn("_u", uniform(seed, "path")) if seed is not None else x
    x = local(first_rows(x, ["side"], order, cap, "_n").select("side", "path", *names))
    # means are taken from the least value on: a constant feature (those of time alone) is then 0 exactly, not the noise of its sum over 1e-12
    x = x.select("side", "path", *[F.round(f, 12).alias(f) for f in names])
    real = x.where(F.col("side") == REAL)
    low = real.agg(*[F.min(f).alias(f"l_{f}") for f in names])
    m = real.join(F.broadcast(low)).agg(*[(F.avg(F.col(f) - F.col(f"l_{f}")) + F.min(f)).alias(f"m_{f}") for f in names], *[F.stddev_pop(f).alias(f"d_{f}") for f in names])
    z = x.join(F.broadcast(m)).select("side", F.col("path").alias("_id"), *[((F.col(f) - F.col(f"m_{f}")) / (F.col(f"d_{f}") + 1e-12)).alias(f) for f in names])
    norm = z.where(F.col("side") == REAL).agg(F.avg(F.sqrt(sum((F.col(f) * F.col(f) for f in names), F.lit(0.0)))).alias("norm"))
    e = energy(z, names).crossJoin(norm)
    return rows(e, {"energy": F.col("energy"), "norm": F.col("norm")}, F.col("energy") / (F.col("norm") + 1e-9))

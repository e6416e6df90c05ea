"""Kernels the metrics are made of. All are DataFrame plans; none gathers rows, but `pair_sums` its capped points."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of the value axis in running sums: so many coarse ones, each of as many fine ones.
WAYS = 20
#: Values of a feature with at most so many are summed in one window and their ranks sent to the rows; with more, sums are bucketed and rows dealt by value.
FEW_VALUES = 10_000
#: Parts of a sketch by which order statistics are found: a place is sought among three or four of them.
GRID = 400
#: Bytes of points that are sent to every task at most.
POINT_BYTES = 256 << 20
#: Parts that a group is dealt to before its first rows are taken.
SALTS = 64


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present; NULL where one side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def mean(items: Sequence[Column]) -> Column:
    """Mean over the items that are present."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in items), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in items), F.lit(0))
    return total / F.nullif(n, F.lit(0))


def rows(df: DataFrame, items: dict[str, Column], overall: Column | None = None) -> DataFrame:
    """A one-row DataFrame as (key, value) rows; overall: the mean of the items unless given."""
    out = dict(items)
    out["overall"] = mean(list(items.values())) if overall is None else overall
    cells = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in out.items()])
    return df.select(F.explode(cells).alias("c")).select("c.key", "c.value")


def with_overall(df: DataFrame, overall: Column | None = None) -> DataFrame:
    """(key, value) rows with one more, `overall`: an aggregate of value, by default its mean."""
    return df.select("key", "value").unionByName(df.agg((F.avg("value") if overall is None else overall).alias("value")).select(F.lit("overall").alias("key"), "value"))


def cuts(v: str) -> Column:
    """Aggregate: approximate quantiles that cut the value axis into WAYS^2 buckets; `coarse`, every WAYS-th of them, and `fine`, those between."""
    n = WAYS * WAYS
    q = F.percentile_approx(v, [i / n for i in range(1, n)], 5_000)
    coarse = F.transform(F.sequence(F.lit(1), F.lit(WAYS - 1)), lambda i: F.get(q, i * WAYS - 1))
    fine = F.transform(F.sequence(F.lit(0), F.lit(WAYS - 1)), lambda i: F.slice(q, i * WAYS + 1, F.lit(WAYS - 1)))
    return F.struct(coarse.alias("coarse"), fine.alias("fine"))


def bucketed(df: DataFrame, at: str, v: str, into: str) -> DataFrame:
    """df with `into`: how many of the cuts in `at` lie below v, which is dropped; found among the coarse ones, then among the fine ones there."""
    step = df.withColumn(into, F.size(F.filter(F.col(at)["coarse"], lambda c: c < F.col(v))))
    return step.withColumn(into, F.col(into) * WAYS + F.coalesce(F.size(F.filter(F.get(F.col(at)["fine"], F.col(into)), lambda c: c < F.col(v))), F.lit(0))).drop(at)


def running(df: DataFrame, group: Sequence[str], v: str, sums: Sequence[str], like: DataFrame) -> DataFrame:
    """df, of one row for each group and v, with `<sum>_to`: each sum over the rows of the group up to and with v, and `<sum>_all`: over all of them.

    The value axis of a group is cut at approximate quantiles of `like` (group,
    v), the rows that df counts: only sketches of them are shuffled. Totals of the
    buckets are summed over a few rows, values only inside their bucket, so a
    group of any size is spread over WAYS^2 tasks; the totals join on the keys by
    which the values lie already."""
    group = list(group)
    bounds = local(like.groupBy(*group).agg(cuts(v).alias("_cuts")))  # found once: sketches merged in another order would cut elsewhere
    cut = bucketed(df.join(F.broadcast(bounds), group), "_cuts", v, "_b")
    order = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*group, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    totals = totals.select(*group, "_b", *[F.coalesce(F.sum(f"_t_{s}").over(order), F.lit(0)).alias(f"_o_{s}") for s in sums], *[F.sum(f"_t_{s}").over(Window.partitionBy(*group)).alias(f"{s}_all") for s in sums])
    inside = Window.partitionBy(*group, "_b").orderBy(v).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({f"_i_{s}": F.sum(s).over(inside) for s in sums}).join(totals, [*group, "_b"])
    return out.withColumns({f"{s}_to": F.col(f"_i_{s}") + F.col(f"_o_{s}") for s in sums}).drop("_b", *[f"_i_{s}" for s in sums], *[f"_o_{s}" for s in sums])


def first_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], cap: int, number: str) -> DataFrame:
    """The first `cap` rows of each group in order, with their number from 1.

    Each group is dealt to SALTS parts, of which only the first rows go on."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    of = lambda *by: F.row_number().over(Window.partitionBy(*group, *by).orderBy(*order))
    few = salted.withColumn(number, of("_salt")).where(F.col(number) <= cap).drop("_salt", number)
    return few.withColumn(number, of()).where(F.col(number) <= cap)


def ks(long: DataFrame, group: str = "feature") -> DataFrame:
    """(group, n_real, n_syn, ks): the largest gap of the two sides' distribution functions. long: side, group, v."""
    real = (F.col("side") == "real").cast("long")
    c = long.groupBy(group, "v").agg(F.sum(real).alias("r"), F.sum(1 - real).alias("s"))
    r = running(c, [group], "v", ["r", "s"], long)
    gap = F.abs(F.col("s_to") / F.nullif("s_all", F.lit(0)) - F.col("r_to") / F.nullif("r_all", F.lit(0)))
    return r.groupBy(group).agg(F.max("r_all").alias("n_real"), F.max("s_all").alias("n_syn"), F.max(gap).alias("ks"))


def order_statistics(long: DataFrame, group: Sequence[str], places: Callable[[int], list[int]]) -> dict[tuple, tuple[int, list]]:
    """By group its n and the exact values at the places(n), from 0 to n - 1. long: group, v.

    A sketch says between which two values a place lies. Values between them are
    counted one by one, all others only as so many below, between or above. The
    counts show whether the sketch was right: where it was not, the place is
    found by `running`."""
    group, spark = list(group), long.sparkSession
    sketches = long.groupBy(*group).agg(F.count("*").alias("n"), F.percentile_approx("v", [i / GRID for i in range(1, GRID)], 10 * GRID).alias("q")).collect()
    if not sketches:
        return {}
    wanted, bounds = {}, []
    for r in sketches:
        key, n, q, spans = tuple(r[g] for g in group), r["n"], r["q"], []
        wanted[key] = (n, places(n))
        for i in sorted({int(p / n * GRID) for p in wanted[key][1]}):
            lo, hi = q[i - 2] if i >= 2 else float("-inf"), q[i + 1] if i + 1 < len(q) else float("inf")
            if spans and lo <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
            else:
                spans.append((lo, hi))
        bounds.append((*key, [x[0] for x in spans], [x[1] for x in spans], wanted[key][1]))
    kinds = StructType([long.schema[g] for g in group])
    bounds = spark.createDataFrame(bounds, StructType([*kinds, *StructType.fromDDL("_lo array<double>, _hi array<double>, _at array<bigint>")]))
    # odd slots are spans, even ones lie between them; each end is a column, as functions over arrays are slow
    ends = range(max(len(at) for _, at in wanted.values()))
    slot = sum((F.coalesce(c.cast("int"), F.lit(0)) for i in ends for c in (F.col(f"_lo{i}") <= F.col("v"), F.col(f"_hi{i}") < F.col("v"))), F.lit(0))
    wide = bounds.select(*group, *[F.get(e, F.lit(i)).alias(f"{e}{i}") for i in ends for e in ("_lo", "_hi")])
    c = long.join(F.broadcast(wide), group).select(*group, "v", slot.alias("_slot")).groupBy(*group, "_slot", F.when(F.col("_slot") % 2 == 1, F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    c = c.withColumn("c_to", F.sum("c").over(Window.partitionBy(*group).orderBy("_slot", "v").rowsBetween(Window.unboundedPreceding, 0)))
    most = max(len(at) for _, at in wanted.values())
    found = c.join(F.broadcast(bounds.drop("_lo", "_hi")), group).groupBy(*group).agg(*[F.min(F.when(F.col("c_to") > F.get("_at", F.lit(i)), F.struct("_slot", "v"))).alias(f"_{i}") for i in range(most)]).collect()
    out = {}
    for r in found:
        key = tuple(r[g] for g in group)
        n, at = wanted[key]
        got = [r[f"_{i}"] for i in range(len(at))]
        if all(x["_slot"] % 2 for x in got):
            out[key] = (n, [x["v"] for x in got])
    for key in wanted.keys() - out.keys():
        n, at = wanted[key]
        of = [F.col(g).eqNullSafe(F.lit(k)) for g, k in zip(group, key, strict=True)]
        one = long.where(reduce(lambda x, y: x & y, of)).select(F.lit(1).alias("_one"), "v")
        run = running(one.groupBy("_one", "v").agg(F.count("*").alias("c")), ["_one"], "v", ["c"], one)
        out[key] = (n, list(run.agg(*[F.min(F.when(F.col("c_to") > i, F.col("v"))).alias(f"_{j}") for j, i in enumerate(at)]).head()))
    return out


def quantiles(long: DataFrame, group: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(group, n, q array): quantiles between order statistics, linear, exact. long: group, v."""
    def places(n: int) -> list[int]:
        return [x for p in probs for x in (math.floor((n - 1) * p), min(math.floor((n - 1) * p) + 1, n - 1))]

    out = []
    for key, (n, x) in order_statistics(long, group, places).items():
        q = [x[2 * i] + (x[2 * i + 1] - x[2 * i]) * ((n - 1) * p - math.floor((n - 1) * p)) for i, p in enumerate(probs)]
        out.append((*key, n, q))
    return long.sparkSession.createDataFrame(out, StructType([*[long.schema[g] for g in group], *StructType.fromDDL("n bigint, q array<double>")]))


def correlations(df: DataFrame, of: Column, features: Sequence[str]) -> DataFrame:
    """(of, a, b, n, va, vb, r) for each whole number `of` (no row where it is NULL) and pair of features: rows where both are present, their variances over these, and Pearson's correlation, NULL where one side is constant.

    Blocks of rows give means and centred sums of products, which are put together as such."""
    names = list(features)
    pairs = list(combinations(range(len(names)), 2))
    sums = ("n", "ma", "mb", "caa", "cbb", "cab", "la", "ha", "lb", "hb")

    def part(x: np.ndarray, y: np.ndarray) -> tuple:
        ma, mb = x.mean(), y.mean()
        return len(x), ma, mb, ((x - ma) ** 2).sum(), ((y - mb) ** 2).sum(), ((x - ma) * (y - mb)).sum(), x.min(), x.max(), y.min(), y.max()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            of_, all_ = batch.column(0).to_numpy(zero_copy_only=False), matrix(pa.Table.from_batches([batch]), names)
            for g in np.unique(of_).tolist():
                x = all_[of_ == g]
                there = ~np.isnan(x)
                whole = bool(there.all())
                if whole:
                    m, lo, hi = x.mean(axis=0), x.min(axis=0), x.max(axis=0)
                    with np.errstate(invalid="ignore"):
                        c = (x - m).T @ (x - m)
                for i, j in pairs:
                    if whole:
                        b = (len(x), m[i], m[j], c[i, i], c[j, j], c[i, j], lo[i], hi[i], lo[j], hi[j])
                    else:
                        both = there[:, i] & there[:, j]
                        if not both.any():
                            continue
                        b = part(x[both, i], x[both, j])
                    a = held.get((g, i, j))
                    if a is not None:
                        n, da, db = a[0] + b[0], b[1] - a[1], b[2] - a[2]
                        w = a[0] * b[0] / n
                        b = (n, a[1] + da * b[0] / n, a[2] + db * b[0] / n, a[3] + b[3] + da * da * w, a[4] + b[4] + db * db * w, a[5] + b[5] + da * db * w, min(a[6], b[6]), max(a[7], b[7]), min(a[8], b[8]), max(a[9], b[9]))
                    held[g, i, j] = b
        if held:
            keys, cells = list(held), list(held.values())
            cols = [pa.array([k[0] for k in keys], pa.int64()), pa.array([names[k[1]] for k in keys]), pa.array([names[k[2]] for k in keys])]
            cols += [pa.array([int(x[0]) for x in cells], pa.int64())] + [pa.array([float(x[i]) for x in cells], pa.float64()) for i in range(1, len(sums))]
            yield pa.RecordBatch.from_arrays(cols, names=["of", "a", "b", *sums])

    got = df.select(of.cast("long").alias("_of"), *features).where("_of is not null").mapInArrow(run, "of long, a string, b string, n long, " + ", ".join(f"{x} double" for x in sums[1:]))
    every = Window.partitionBy("of", "a", "b")
    got = got.withColumns({m: F.sum(F.col("n") * F.col(f"m{m[-1]}")).over(every) / F.sum("n").over(every) for m in ("_a", "_b")})
    da, db = F.col("ma") - F.col("_a"), F.col("mb") - F.col("_b")
    one = got.groupBy("of", "a", "b").agg(F.sum("n").alias("n"), F.sum(F.col("caa") + F.col("n") * da * da).alias("caa"), F.sum(F.col("cbb") + F.col("n") * db * db).alias("cbb"), F.sum(F.col("cab") + F.col("n") * da * db).alias("cab"), (F.max("ha") == F.min("la")).alias("_ka"), (F.max("hb") == F.min("lb")).alias("_kb"))
    va, vb = (F.when(F.col(k), 0.0).otherwise(F.col(c) / F.col("n")) for k, c in (("_ka", "caa"), ("_kb", "cbb")))
    return one.select("of", "a", "b", "n", va.alias("va"), vb.alias("vb"), (F.col("cab") / F.col("n") / F.nullif(F.sqrt(va) * F.sqrt(vb), F.lit(0.0))).alias("r"))


def mid_ranks(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Each side's rows with features replaced by their ranks, ties sharing the middle, and `n_<feature>` present values (both NULL where the feature is)."""
    few = df.agg(*[F.approx_count_distinct(f).alias(f) for f in features]).head()
    out = df.select("side", *keep, *features)
    for f in features:  # each from its own column: one long table would be made again for every feature
        long = df.select("side", F.col(f).alias("v")).where("v is not null")
        c = long.groupBy("side", "v").agg(F.count("*").alias("c"))
        if small := few[f] <= FEW_VALUES:
            up = Window.partitionBy("side").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
            sums = c.withColumns({"c_to": F.sum("c").over(up), "c_all": F.sum("c").over(Window.partitionBy("side"))})
        else:
            sums = running(c, ["side"], "v", ["c"], long)
        one = sums.select(F.col("side").alias("_s"), F.col("v").alias("_v"), (F.col("c_to") - (F.col("c") - 1) / 2.0).alias(f"r_{f}"), F.col("c_all").alias(f"n_{f}"))
        one = F.broadcast(one) if small else one
        out = out.join(one, (F.col("side") == F.col("_s")) & (F.col(f) == F.col("_v")), "left").drop("_s", "_v")
    return out.select("side", *keep, *[F.col(f"r_{f}").alias(f) for f in features], *[f"n_{f}" for f in features])


def distance(features: Sequence[str], a: str, b: str) -> Column:
    """Euclidean distance between the rows of two aliases."""
    return F.sqrt(sum((F.pow(F.col(f"{a}.{f}") - F.col(f"{b}.{f}"), 2) for f in features), F.lit(0.0)))


def blocks(a: np.ndarray, b: np.ndarray, rows_at_once: int = 256) -> Iterator[tuple[slice, np.ndarray]]:
    """Distances of all rows of a to all of b, some rows of a at a time; differences are summed, as norms and dot products lose digits near 0."""
    for lo in range(0, len(a), rows_at_once):
        at = slice(lo, min(len(a), lo + rows_at_once))
        d = np.zeros((at.stop - lo, len(b)))
        for j in range(a.shape[1]):
            gap = a[at, j, None] - b[None, :, j]
            gap *= gap
            d += gap
        yield at, np.sqrt(d, out=d)


def matrix(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """Columns of numbers as one matrix, missing ones as NaN."""
    return np.stack([table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1) if table.num_rows else np.zeros((0, len(columns)))


def tasks(spark, n: int, run, schema: str) -> DataFrame:
    """run over the numbers 0 .. n - 1, dealt evenly to the executors."""
    return spark.range(0, n, 1, max(1, min(n, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, schema)


def local(df: DataFrame) -> DataFrame:
    """A table that its caller has capped, computed once and held by the driver, so that what is made of it does not compute it again."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


@contextmanager
def held(*tables: DataFrame) -> Iterator[DataFrame | tuple[DataFrame, ...]]:
    """Tables computed once for all that is done with them inside, kept by the executors (in memory, else on their disks) and let go at the end. What is kept already is left to whoever keeps it."""
    mine = [t.persist() for t in tables if not (t.storageLevel.useMemory or t.storageLevel.useDisk)]
    try:
        yield tables[0] if len(tables) == 1 else tables
    finally:
        for t in mine:
            t.unpersist()


def pair_sums(points: DataFrame, of: str, features: Sequence[str], inner_only_with: str | None = None) -> DataFrame:
    """(a, b, total): sums of distances over the pairs of points of the sets a < b, and over each set's own pairs, once each. of: the column that names a point's set.

    inner_only_with: sets are only paired where their names are equal up to this mark.
    The points are capped by their callers to `POINT_BYTES` in all; they are sent to
    every task, which sums blocks of pairs as they arise."""
    spark = points.sparkSession
    table = points.select(F.col(of).cast("string").alias("_of"), *features).toArrow()
    names, x = np.array(table.column("_of").to_pylist(), object), matrix(table, features)
    sets = {n: x[names == n] for n in sorted(set(names.tolist()))}
    family = lambda n: n.partition(inner_only_with)[0] if inner_only_with else ""
    order = list(sets)
    work = [(a, b, lo) for i, a in enumerate(order) for b in order[i:] if family(a) == family(b) for lo in range(0, len(sets[a]), 512)]
    held = spark.sparkContext.broadcast((sets, work))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, work = held.value
        for batch in batches:
            out = []
            for i in batch.column(0).to_pylist():
                a, b, lo = work[i]
                part, total = sets[a][lo : lo + 512], 0.0
                if a != b:
                    total = sum(float(np.nansum(d)) for _, d in blocks(part, sets[b]))
                else:
                    total = sum(float(np.nansum(d)) for _, d in blocks(part, sets[a][lo + 512 :])) + sum(float(np.nansum(d)) for _, d in blocks(part, part)) / 2
                out.append((a, b, total))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.float64())], names=["a", "b", "total"])

    return tasks(spark, len(work), run, "a string, b string, total double").groupBy("a", "b").agg(F.sum("total").alias("total"))


def energy(df: DataFrame, features: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """(group, n_syn, n_real, energy, scale) of capped rows (side, group, features): twice the mean cross distance less both mean inner ones, at least 0; scale: mean population deviation of the real features."""
    group, df = list(group), local(df.select("side", *group, *features))
    name = F.concat_ws("|", F.lit("g"), *[F.col(g).cast("string") for g in group])
    size = df.groupBy(*group).agg(F.count_if(F.col("side") == "synthetic").alias("n_syn"), F.count_if(F.col("side") == "real").alias("n_real"), (sum((F.stddev_pop(F.when(F.col("side") == "real", F.col(f))) for f in features), F.lit(0.0)) / len(features)).alias("scale"))
    sums = pair_sums(df.withColumn("_set", F.concat(name, F.lit("#"), "side")), "_set", features, "#")
    side = lambda c: F.substring_index(c, "#", -1)
    per = sums.groupBy(F.substring_index("a", "#", 1).alias("_g")).agg(
        F.sum(F.when(side("a") != side("b"), F.col("total"))).alias("xy"), F.sum(F.when((side("a") == "synthetic") & (side("b") == "synthetic"), F.col("total"))).alias("xx"), F.sum(F.when((side("a") == "real") & (side("b") == "real"), F.col("total"))).alias("yy"))
    out = size.withColumn("_g", name).join(per, "_g", "left")
    s, r = F.col("n_syn"), F.col("n_real")
    e = 2 * F.col("xy") / F.nullif(s * r, F.lit(0)) - 2 * F.coalesce("xx", F.lit(0.0)) / F.nullif(s * (s - 1), F.lit(0)) - 2 * F.coalesce("yy", F.lit(0.0)) / F.nullif(r * (r - 1), F.lit(0))
    return out.select(*group, "n_syn", "n_real", F.greatest(e, F.lit(0.0)).alias("energy"), "scale")


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from a counter: the first 8 hex digits of the MD5 of seed and parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)

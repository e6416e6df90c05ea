"""Panels: two sides (`real`, `synthetic`) of the same features, as DataFrames.

Flat panels have one row a sample; path panels one row a path and step; forecasts
pair an ensemble with what came true. NaN becomes NULL when a panel is made, so
aggregates skip it. Every panel carries columns that order it totally: caps take
the first rows in that order, never in file order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import held

REAL, SYNTHETIC = "real", "synthetic"


def _doubles(df: DataFrame, features: Sequence[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    out = {}
    for f in features:
        c = F.col(f).cast("double")
        out[f] = F.when(~F.isnan(c), c) if kinds[f] in ("double", "float") else c
    return df.withColumns(out)


def on(side: str, c: Column) -> Column:
    """c on the rows of one side, else NULL."""
    return F.when(F.col("side") == side, c)


@dataclass(frozen=True)
class Flat:
    """df: side, the order columns, the features."""

    df: DataFrame
    features: tuple[str, ...]
    order: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame, features: Sequence[str], order: Sequence[str]) -> Flat:
        if missing := {"side", *features, *order} - set(df.columns):
            raise ValueError(f"a 2D panel needs the columns {sorted(missing)}")
        return cls(_doubles(df.select("side", *dict.fromkeys([*order, *features])), features), tuple(features), tuple(order))

    @classmethod
    def pair(cls, synthetic: DataFrame, real: DataFrame, features: Sequence[str], order: Sequence[str]) -> Flat:
        return cls.of(synthetic.withColumn("side", F.lit(SYNTHETIC)).unionByName(real.withColumn("side", F.lit(REAL)), allowMissingColumns=True), features, order)

    def side(self, name: str) -> DataFrame:
        return self.df.where(F.col("side") == name)

    def complete(self) -> DataFrame:
        """Rows without a missing feature. Many features are tested as one array: the optimizer's inference over as many conjuncts takes minutes."""
        if len(self.features) > 8:
            return self.df.where(F.forall(F.array(*self.features), lambda x: x.isNotNull()))
        return self.df.dropna(subset=list(self.features))

    def finite(self) -> DataFrame:
        return self.complete().where(F.forall(F.array(*self.features), lambda x: F.abs(x) != float("inf")))

    def head(self, df: DataFrame, n: int) -> DataFrame:
        """The first n rows of each side in the panel's order: per-task heaps, no sort of the whole."""
        one = lambda s: df.where(F.col("side") == s).orderBy(*self.order).limit(n)
        return one(REAL).unionByName(one(SYNTHETIC))

    def long(self, df: DataFrame | None = None) -> DataFrame:
        """(side, feature, v), a row for each present value."""
        cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in self.features])
        return (self.df if df is None else df).select("side", F.explode(cells).alias("c")).select("side", "c.feature", "c.v").where("v is not null")


@dataclass(frozen=True)
class Paths:
    """df: side, path, t (0, 1, ...), the features; every path of a side has the same number of steps."""

    df: DataFrame
    features: tuple[str, ...]
    kept: bool = False

    @contextmanager
    def held(self) -> Iterator[Paths]:
        """The same paths, computed once and kept path by path in order of steps for all that is done inside."""
        if self.kept:
            yield self
            return
        with held(self.df.repartition("side", "path").sortWithinPartitions("side", "path", "t")) as df:
            yield Paths(df, self.features, True)

    @classmethod
    def of(cls, df: DataFrame, features: Sequence[str]) -> Paths:
        if missing := {"side", "path", "t", *features} - set(df.columns):
            raise ValueError(f"a 3D panel needs the columns {sorted(missing)}")
        return cls(_doubles(df.select("side", "path", "t", *features), features), tuple(features))

    def window(self) -> object:
        return Window.partitionBy("side", "path").orderBy("t")

    def flatten(self) -> Flat:
        return Flat(self.df, self.features, ("path", "t"))

    def horizon(self) -> dict[str, int]:
        return {r[0]: r[1] + 1 for r in self.df.groupBy("side").agg(F.max("t")).collect()}

    def subwindow(self, width: int | None) -> Paths:
        """Each path cut into runs of width steps, the remainder dropped; nothing changes if no path is longer."""
        if not width or max(self.horizon().values(), default=0) <= width:
            return self
        per = self.df.groupBy("side").agg((F.max("t") + 1).alias("h"))
        cut = self.df.join(F.broadcast(per), "side").where(F.col("t") < F.floor(F.col("h") / width) * width)
        return Paths(cut.select("side", (F.col("path") * F.floor(F.col("h") / width) + F.floor(F.col("t") / width)).alias("path"), (F.col("t") % width).alias("t"), *self.features), self.features)

    def levels(self) -> Paths:
        """Prices exp(cumulative returns)."""
        w = self.window().rowsBetween(Window.unboundedPreceding, 0)
        return Paths(self.df.withColumns({f: F.exp(F.sum(f).over(w)) for f in self.features}), self.features)


@dataclass(frozen=True)
class Forecast:
    """samples: obs, sample, features; actuals: obs, features; labels: obs, axis, label; source: a table that both are made of, if there is one."""

    samples: DataFrame
    actuals: DataFrame
    features: tuple[str, ...]
    labels: DataFrame | None = None
    source: DataFrame | None = None

    @contextmanager
    def held(self) -> Iterator[Forecast]:
        """Samples and actuals are computed once for all that is done inside."""
        with held(*([self.source] if self.source is not None else [self.samples, self.actuals])):
            yield self

    @classmethod
    def of(cls, samples: DataFrame, actuals: DataFrame, features: Sequence[str], labels: DataFrame | None = None, source: DataFrame | None = None) -> Forecast:
        for name, df, need in (("3D samples", samples, {"obs", "sample"}), ("2D actuals", actuals, {"obs"})):
            if missing := {*need, *features} - set(df.columns):
                raise ValueError(f"{name} need the columns {sorted(missing)}")
        return cls(_doubles(samples.select("obs", "sample", *features), features), _doubles(actuals.select("obs", *features), features), tuple(features), labels, source)


def log_returns(prices: DataFrame, features: Sequence[str], order: Sequence[str], by: Sequence[str] = (), floor: float = 1e-9) -> DataFrame:
    """Price columns as log returns, the first row of each series dropped."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = prices.withColumns({f"_{f}": F.log(F.greatest(F.col(f), F.lit(floor))) for f in features})
    out = out.withColumns({f: F.col(f"_{f}") - F.lag(f"_{f}").over(w) for f in features})
    return out.withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n", *[f"_{f}" for f in features])


def read_numeric(spark: SparkSession, path: str) -> DataFrame:
    """The numeric columns of a Parquet table."""
    df = spark.read.parquet(path)
    return df.select(*[c for c, kind in df.dtypes if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal")])


# Canonical panels over the driver's tables.

FLAT_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def lineitem_flat(spark: SparkSession, sf_dir: str) -> Flat:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    side = F.when(F.col("l_linestatus") == "F", REAL).otherwise(SYNTHETIC)
    return Flat.of(li.withColumn("side", side), FLAT_FEATURES, _LINE)


_SHIP = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def supplier_paths(spark: SparkSession, sf_dir: str, horizon: int = 60) -> Paths:
    """Log changes of price and quantity over each supplier's lines, cut into paths; even suppliers are real."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", *_SHIP, "l_quantity")
    w = Window.partitionBy("l_suppkey").orderBy(*_SHIP)
    x = li.select("l_suppkey", F.row_number().over(w).alias("n"), F.log(F.col("l_extendedprice") / F.lag("l_extendedprice").over(w)).alias("price"), F.log(F.col("l_quantity") / F.lag("l_quantity").over(w)).alias("quantity"), F.count("*").over(Window.partitionBy("l_suppkey")).alias("all")).where("n > 1")
    whole = F.floor((F.col("all") - 1) / horizon) * horizon
    x = x.where(F.col("n") - 2 < whole)
    side = F.when(F.col("l_suppkey") % 2 == 0, REAL).otherwise(SYNTHETIC)
    block, supplier = F.floor((F.col("n") - 2) / horizon), F.col("l_suppkey").cast("long")
    # block 1000 and later would run into the ids of other suppliers: those have ids of their own, below 0
    path = F.when(block < 1000, supplier * 1000 + block).otherwise(-(supplier * F.lit(1 << 31) + block))
    return Paths.of(x.select(side.alias("side"), path.alias("path"), ((F.col("n") - 2) % horizon).cast("int").alias("t"), "price", "quantity"), ("price", "quantity"))


def embedding_points(spark: SparkSession, sf_dir: str, dims: int = 64) -> Flat:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    side = F.when(F.col("label") < 5, REAL).otherwise(SYNTHETIC)
    names = tuple(f"d{i}" for i in range(dims))
    return Flat(e.select(side.alias("side"), "vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names, ("vec_id",))


def part_forecasts(spark: SparkSession, sf_dir: str, ensemble: int = 10) -> Forecast:
    """Each part's last line as the actual, its first lines before that as the ensemble; regimes by size and type."""
    key = ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", *key, "l_quantity")
    w = Window.partitionBy("l_partkey")
    x = li.select(F.col("l_partkey").alias("obs"), F.row_number().over(w.orderBy(*key)).alias("n"), F.count("*").over(w).alias("all"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity")).where((F.col("n") <= ensemble) | (F.col("n") == F.col("all")))
    samples = x.where((F.col("n") <= ensemble) & (F.col("n") < F.col("all"))).select("obs", (F.col("n") - 1).alias("sample"), "price", "quantity")
    actuals = x.where("n = all").select("obs", "price", "quantity")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    vol = F.when(F.col("p_size") <= 17, "low").when(F.col("p_size") <= 34, "mid").otherwise("high")
    labels = part.select(F.col("p_partkey").alias("obs"), F.explode(F.array(F.struct(F.lit("vol").alias("axis"), vol.alias("label")), F.struct(F.lit("trend").alias("axis"), F.col("p_type").alias("label")))).alias("a")).select("obs", "a.axis", "a.label")
    return Forecast.of(samples, actuals, ("price", "quantity"), labels, x)

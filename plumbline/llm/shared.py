"""What the operators share: the shared folder, checkpoints, size-checked broadcasts, row keys."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with more rows than this, or more bytes as JSON, is never broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir, or the one that the context checkpoints to. Where neither is set, a folder of this machine in local mode (one process, as in tests), else an error: on a cluster there is none to fall back to."""
    try:
        place = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # unknown keys without a default raise in some sessions
        place = None
    context = spark.sparkContext
    place = place or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not place and re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        place = f"file://{os.path.join(tempfile.gettempdir(), 'plumbline-shared')}"
    if not place:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(place)
    return place


def cut(df: DataFrame, rows: int | None = None, per: int = 1_000_000, deal: bool = False) -> DataFrame:
    """A reliable checkpoint of df in the shared folder.

    rows: a bound on its rows, where one is known; then it is written as one file for every `per` of them (8 at
    least), not one for each partition of the session's setting. deal: by a shuffle of its own, where the rows are few but dear to make."""
    shared_dir(df.sparkSession)
    if rows is not None:
        n = max(8, -(-rows // per))
        df = df.repartition(n) if deal else df.coalesce(n)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, marked for broadcast if it is known to have few rows and bytes; else as it is, for a shuffled join. df: cheap to read again."""
    n = df.count() if rows is None else rows
    if n > BROADCAST_ROWS:
        return df
    return F.broadcast(df) if (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).head()[0] or 0) <= BROADCAST_BYTES else df


#: Keys of more than one in so many rows are hot; there are no more of them than that.
HOT = 2_000


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], n: str) -> DataFrame:
    """rows with the columns of keyed, inner. keyed: one row a key, with `n`, the number of its rows, and in a form that is cheap to read again.

    The hot keys, `HOT` at most, go to every task, and their rows are dealt by a
    hash of the whole row; all other rows are dealt by their key."""
    total = keyed.agg(F.sum(n)).head()[0] or 0
    limit = max(2_000, total // HOT)
    hot = keyed.where(F.col(n) > limit)
    if not hot.head(1):
        return rows.join(keyed.drop(n), on)
    rest = [c for c in keyed.columns if c not in (*on, n)]
    k, h, r = own(rows, "_key"), own(rows, "_hot"), own(rows, "_rest")
    info = F.struct(*rest)
    near = rows.join(F.broadcast(hot.select(*on, info.alias(h))), on, "left")
    # 0 for rows that have met no hot key; the others are dealt by their own hash and meet nothing more, as no other key equals theirs
    lone = row_hash(rows)
    near = near.withColumn(k, F.when(F.col(h).isNull(), F.lit(0).cast("long")).otherwise(lone))
    cold = keyed.where(F.col(n) <= limit).select(F.lit(0).cast("long").alias(f"{k}0"), *[F.col(c).alias(f"{k}{c}") for c in on], info.alias(r))
    met = near[k] == cold[f"{k}0"]
    for c in on:
        met = met & (near[c] == cold[f"{k}{c}"])
    out = near.join(cold, met, "left").withColumn(h, F.coalesce(F.col(h), F.col(r))).where(F.col(h).isNotNull())
    return out.select(*[near[c] for c in rows.columns], *[F.col(f"{h}.{c}").alias(c) for c in rest])


def own(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = f"_{wanted}"
    return wanted


def carried(docs: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with all columns but the needed ones under plain names of their own, and a function that gives a frame over them the columns of docs back, in order, and any further ones after them.

    So no column of docs can clash with what an operator adds, whatever it is called (dots, case, repeated names)."""
    names, left = [], list(needed)
    for i, c in enumerate(docs.columns):
        names.append(c if c in left else f"carried_{i}")
        if c in left:
            left.remove(c)

    def back(out: DataFrame, *more: Column) -> DataFrame:
        return out.select(*[F.col(a).alias(c) for a, c in zip(names, docs.columns, strict=True)], *more)

    return docs.toDF(*names), back


def row_hash(docs: DataFrame) -> Column:
    """A hash of a whole row; maps, which have no order, and what holds them by their text."""
    return F.xxhash64(*[F.col(f"`{c}`").cast("string") if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes])


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")

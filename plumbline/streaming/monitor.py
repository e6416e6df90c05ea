"""A drift monitor: each micro-batch of a stream is held against a fixed reference panel."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.api import FLAT
from ..plans.scoring import score_column, thresholds_of
from ..sources.panels import Flat


def drift_rows(batch: DataFrame, batch_id: int, reference: DataFrame, features: tuple[str, ...], order: tuple[str, ...], metrics: Iterable[str]) -> DataFrame:
    """(batch_id, metric, key, value, score) of one batch."""
    panel = Flat.pair(batch, reference, features, order)
    out = None
    for m in metrics:
        one = FLAT[m](panel).select(F.lit(batch_id).cast("long").alias("batch_id"), F.lit(m).alias("metric"), "key", "value", score_column(F.col("value"), thresholds_of(m)).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def monitor(stream: DataFrame, reference: DataFrame, features: tuple[str, ...], order: tuple[str, ...], sink: Callable[[DataFrame, int], None], checkpoint: str, metrics: Iterable[str] = ("marginal_ks", "tail_quantiles")) -> StreamingQuery:
    """Starts a query that hands each batch's rows to sink(rows, batch_id); sink should write by batch_id, so that a repeated batch replaces itself."""
    chosen = tuple(metrics)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            sink(drift_rows(batch, batch_id, reference, features, order, chosen), batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

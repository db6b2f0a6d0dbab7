"""Incremental publication: micro-batches merged into the buckets of a keyed state, late revisions refused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.streaming.buckets import Buckets


def publisher(state: Buckets, current: tuple[DataFrame, list[str]] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch is merged into the state. current: (frame, columns) that rows must agree with to be taken."""

    def put(batch: DataFrame, batch_id: int) -> None:
        state.upsert(batch if current is None else batch.join(current[0], current[1], "left_semi"))

    return put


def run(source: DataFrame, state: Buckets, checkpoint: str, current: tuple[DataFrame, list[str]] | None = None) -> None:
    """Publishes all that a stream has now, and stops."""
    source.writeStream.foreachBatch(publisher(state, current)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event time; works on a stream, where rows later than the watermark are dropped, and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")

"""Incremental forms of batch operators. These go beyond what the operators were made from: there, a rerun skips keys that the
output has; here, a stream does the same for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.io import append_new


def enrich_once(stream: DataFrame, enrich: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Enrich each row of a stream once, by key, and append it to a table; what the table has already is left alone."""

    def each(batch: DataFrame, _: int) -> None:
        append_new(enrich(batch.dropDuplicates([key])), path, key)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alert_counts(events: DataFrame, time: str, alert: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """start, n, alerts of event-time windows, with a watermark."""
    by = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"))
    return by.agg(F.count("*").alias("n"), F.sum(F.col(alert).cast("int")).alias("alerts")).select(F.col("w.start").alias("start"), "n", "alerts")

"""Streams of turns and events. Each function maps a streaming or batch DataFrame to another one, so that
the same code runs in either mode; writers take a checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_turns(turns: DataFrame, keys: list[str], ts: str = "ts", late: str = "30 days") -> DataFrame:
    """Each turn once: copies within the watermark are dropped, so a redelivered batch changes nothing."""
    return turns.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def after_watermark(turns: DataFrame, marks: DataFrame, session: str, index: str) -> DataFrame:
    """Turns beyond what their session has captured; a session without a mark keeps all."""
    known = turns.join(marks.select(session, "captured"), session, "left")
    return known.where(F.col(index) >= F.coalesce("captured", F.lit(0))).drop("captured")


def sessions(events: DataFrame, by: list[str], gap: str = "12 hours", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Idle session closing: a session ends after `gap` without an event and is emitted when the watermark passes."""
    return events.withWatermark(ts, late).groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("opened_at"), F.max(ts).alias("closed_at")).drop("w")


def debounced_access(events: DataFrame, by: list[str], gap: str = "500 milliseconds", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Accesses closer than `gap` count as one burst."""
    return events.withWatermark(ts, late).groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("hits")).select(*by, F.col("w.start").alias("since"), "hits")


def windowed_counts(events: DataFrame, by: list[str], size: str = "1 hour", slide: str | None = None, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(*by, w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*by, F.col("w.start").alias("since"), "n", "total")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All available input once, then stop: exactly-once into files by the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def to_store(stream: DataFrame, apply, checkpoint: str) -> StreamingQuery:
    """Each micro-batch through `apply(batch, batch_id)`: write arbitration against the current store. The batch
    id lets a repeated batch be recognised."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

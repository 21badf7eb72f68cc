"""Structured Streaming: windowed counts of events, and upserts of the latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, n) of a stream or a table; rows later than the watermark are left out of a stream."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by the order columns (nulls first)."""
    w = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert_stream(stream: DataFrame, key: str, order: list[str], folder: str, checkpoint: str):
    """Writes a stream into the table at folder, which holds the latest row of each key; each batch writes only the key buckets it touches (see sinks.writers.upsert).

    A batch that is run again leaves the same rows, so the sink is idempotent.
    """
    from rillway.sinks.writers import upsert

    def step(batch: DataFrame, number: int) -> None:
        upsert(batch.sparkSession, batch, key, order, folder)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)

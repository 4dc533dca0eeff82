"""Streaming counts, deduplication and the sinks that keep their newest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import RETENTION_DAYS, TICK_SECONDS

LATE = f"{RETENTION_DAYS} days"


def tick_counts(events: DataFrame, keys: list[str], tick_seconds: int = TICK_SECONDS) -> DataFrame:
    """Events and bytes per key and tick. A late event goes to its own old tick for as long
    as ticks are retained."""
    window = F.window("ts", f"{tick_seconds} seconds")
    return (
        events.withWatermark("ts", LATE)
        .groupBy(*keys, window.alias("window"))
        .agg(F.count("*").alias("events"), F.sum("byte_length").alias("bytes"))
        .select(
            *keys,
            F.expr(f"unix_seconds(window.start) div {tick_seconds}").alias("tick_index"),
            "events",
            "bytes",
        )
    )


def moving_window_counts(
    events: DataFrame, keys: list[str], window: str = "1 hour", slide: str = "5 minutes"
) -> DataFrame:
    return (
        events.withWatermark("ts", LATE)
        .groupBy(*keys, F.window("ts", window, slide).alias("window"))
        .agg(F.count("*").alias("events"))
        .select(*keys, F.unix_seconds("window.start").alias("window_start_s"), "events")
    )


def first_arrivals(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each event once, whatever was sent again within the retention time."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark([key])


def write_updates(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    *,
    mode: str = "update",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write each micro-batch as its own numbered partition of a parquet table.

    A batch that is run again after a crash overwrites its own partition.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/update={number}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def newest_state(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Last written values per key of a table of updates."""
    updates = spark.read.option("basePath", path).parquet(f"{path}/update=*")
    values = [c for c in updates.columns if c not in (*keys, "update")]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "update").alias("_v"))
    return newest.select(*keys, "_v.*")

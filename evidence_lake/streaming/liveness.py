"""Which endpoints are alive, as a stream of changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import ACTIVE_SECONDS

LIVENESS_DDL = "endpoint STRING, status STRING, at TIMESTAMP"


def _latest_per_endpoint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last time heard per endpoint and minute of each Arrow batch."""
    for batch in batches:
        grouped = pa.Table.from_batches([batch]).group_by(["endpoint", "minute"])
        yield from (
            grouped.aggregate([("ts", "min"), ("ts", "max")])
            .select(["endpoint", "ts_min", "ts_max"])
            .rename_columns(["endpoint", "first_ts", "ts"])
            .to_batches()
        )


def heard(events: DataFrame, endpoint: str = "endpoint") -> DataFrame:
    """Events thinned to a row per endpoint and minute before anything is shuffled.

    A busy endpoint then costs the stateful step no more than a quiet one.
    """
    minute = F.expr("unix_seconds(ts) div 60").alias("minute")
    return events.select(F.col(endpoint).alias("endpoint"), "ts", minute).mapInArrow(
        _latest_per_endpoint, "endpoint STRING, first_ts TIMESTAMP, ts TIMESTAMP"
    )


class Liveness(StatefulProcessor):
    """Emits `active` when an endpoint is first heard or comes back, `gone` after silence."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seen_us BIGINT, active BOOLEAN")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        heard_at = pd.concat(list(rows)).sort_values("first_ts")
        seen, active = self.last.get() if self.last.exists() else (None, False)
        limit = ACTIVE_SECONDS * 1_000_000
        changes = []
        for first, last in zip(heard_at["first_ts"], heard_at["ts"]):
            first_us, last_us = first.value // 1000, last.value // 1000
            if seen is not None and active and first_us - seen > limit:
                changes.append((key[0], "gone", pd.Timestamp(seen + limit, unit="us")))
                active = False
            if not active and (seen is None or first_us > seen):
                changes.append((key[0], "active", first))
                active = True
            seen = last_us if seen is None else max(seen, last_us)
        self.last.update((seen, active))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due_ms = (seen + limit) // 1000 + 1
        if active and due_ms > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due_ms)
        elif active:
            changes.append((key[0], "gone", pd.Timestamp(seen + limit, unit="us")))
            self.last.update((seen, False))
        if changes:
            yield pd.DataFrame(changes, columns=["endpoint", "status", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, active = self.last.get()
        self.last.update((seen, False))
        if active:
            at = pd.Timestamp(seen + ACTIVE_SECONDS * 1_000_000, unit="us")
            yield pd.DataFrame([(key[0], "gone", at)], columns=["endpoint", "status", "at"])

    def close(self) -> None:
        pass


def liveness(events: DataFrame, endpoint: str = "endpoint", delay: str = "1 minute") -> DataFrame:
    """Stream of status changes; an endpoint silent for five minutes is gone."""
    return (
        heard(events, endpoint)
        .withWatermark("ts", delay)
        .groupBy("endpoint")
        .transformWithStateInPandas(
            statefulProcessor=Liveness(),
            outputStructType=LIVENESS_DDL,
            outputMode="update",
            timeMode="eventTime",
        )
    )

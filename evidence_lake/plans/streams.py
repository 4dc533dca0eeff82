"""Queries that run as streams until all given data is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, shared_dir
from ..sources.adapters import Capture
from ..streaming import windows
from ..streaming.forward import Forwarder, forward
from ..streaming.liveness import liveness
from .catalog import query
from .inputs import EVENT_LOG_SQL, LOG_SQL, event_log_of, file_key, transcript, write_logs, write_transcripts

EVENTS_DDL = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    # A glob, because the stream reader takes a plain path for a folder.
    raw = spark.readStream.schema(EVENTS_DDL).parquet(f"{sf_dir}/{{events}}.parquet")
    return event_log_of(raw)


@query(
    "stream_ticks",
    f"""
WITH {EVENT_LOG_SQL}
SELECT hostname, tick_index, count(*) AS events, CAST(sum(byte_length) AS BIGINT) AS bytes
FROM ev GROUP BY hostname, tick_index
""",
)
def stream_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = windows.tick_counts(event_stream(spark, sf_dir), ["hostname"])
    out = shared_dir(spark, "stream_ticks")
    windows.write_updates(counts, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return windows.newest_state(spark, f"{out}/table", ["hostname", "tick_index"])


@query(
    "stream_dedup",
    f"""
WITH {EVENT_LOG_SQL}
SELECT event_id, hostname, subtype, ts_ns FROM ev
""",
)
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is sent twice and kept once."""
    sent = event_stream(spark, sf_dir).select("event_id", "hostname", "subtype", "ts_ns", "ts")
    again = event_stream(spark, sf_dir).select("event_id", "hostname", "subtype", "ts_ns", "ts")
    once = windows.first_arrivals(sent.unionByName(again)).drop("ts")
    out = shared_dir(spark, "stream_dedup")
    windows.write_updates(
        once, f"{out}/table", f"{out}/checkpoint", mode="append"
    ).awaitTermination()
    return spark.read.option("basePath", f"{out}/table").parquet(f"{out}/table/update=*").drop("update")


@query(
    "stream_moving_counts",
    f"""
WITH {EVENT_LOG_SQL}, slides AS (
  SELECT hostname, ts_ns // 300000000000 AS slide, count(*) AS n FROM ev GROUP BY ALL
)
SELECT hostname, CAST((slide - k) * 300 AS BIGINT) AS window_start_s, CAST(sum(n) AS BIGINT) AS events
FROM slides, range(12) steps(k) GROUP BY ALL
""",
)
def stream_moving_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = windows.moving_window_counts(event_stream(spark, sf_dir), ["hostname"])
    out = shared_dir(spark, "stream_moving")
    windows.write_updates(counts, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return windows.newest_state(spark, f"{out}/table", ["hostname", "window_start_s"])


@query(
    "stream_tail",
    f"""
WITH {LOG_SQL}
SELECT log, part, line_number, byte_offset, byte_end, sha256,
       CAST(NULL AS VARCHAR) AS payload, 'live' AS origin
FROM ranged
""",
)
def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript files followed, parsed, stripped, packed and delivered; the delivered rows."""
    configure(spark)
    source = write_transcripts(spark, sf_dir)
    forwarder = Forwarder(
        root=shared_dir(spark, "forward"),
        adapter="claude_code",
        capture=Capture(hostname="fleet"),
        clock=lambda: 1_706_745_600_000_000_000,
    )
    forward(spark, source, forwarder, glob="*.txt").awaitTermination()
    delivered = spark.read.parquet(forwarder.table("delivered"))
    events = delivered.select("origin", F.explode("events").alias("e")).select("origin", "e.*")
    return events.select(
        file_key("log"),
        file_key("part"),
        "line_number",
        "byte_offset",
        "byte_end",
        "sha256",
        "payload",
        "origin",
    )


GENERATIONS_SQL = f"""
WITH {LOG_SQL}, counted AS (
  SELECT *, count(*) OVER (PARTITION BY log, part) AS n FROM ranged
),
-- What stands in a file after it was replaced (two of three logs) or has grown.
second AS (
  SELECT log, part, line_number, value FROM counted WHERE log % 3 = 0 AND n > 1 AND line_number = 1
  UNION ALL
  SELECT log, part, line_number, CASE WHEN line_number = 1 THEN value ELSE 'again: ' || value END
  FROM counted WHERE log % 3 = 1 AND n > 1
),
again AS (
  SELECT log, part, line_number, sha256(value) AS sha256, CAST(strlen(value) AS BIGINT) AS byte_length,
         CAST(sum(strlen(value) + 1) OVER (PARTITION BY log, part ORDER BY line_number) AS BIGINT) AS byte_end
  FROM second
)
SELECT log, part, 0 AS generation, line_number, byte_end - byte_length - 1 AS byte_offset, sha256 FROM counted
UNION ALL
SELECT log, part, 1, line_number, byte_end - byte_length - 1, sha256 FROM again
UNION ALL
SELECT log, part, 0, max(line_number) + 1, max(byte_end), sha256('grown') FROM counted WHERE log % 3 = 2 GROUP BY log, part
"""


@query("tail_generations", GENERATIONS_SQL)
def tail_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs followed while a third is cut back to its equal first line, a third replaced by longer files
    with an equal first line, and a third grows: every line of every generation, delivered once."""
    configure(spark)
    source = shared_dir(spark, "generations")
    name = F.format_string("log=%d/part=%d/log.jsonl", "log", "part").alias("name")
    order = ["conv_id", "turn"]
    first = transcript(spark, sf_dir).withColumn("name", name)
    write_logs(first, source, order)
    forwarder = Forwarder(
        root=shared_dir(spark, "forward"),
        adapter="claude_code",
        capture=Capture(hostname="fleet"),
        clock=lambda: 1_706_745_600_000_000_000,
    )
    forward(spark, source, forwarder).awaitTermination()
    place = F.struct(*order)
    start = first.groupBy("name").agg(F.min(place).alias("_first"), F.count("*").alias("_n"), F.max(place).alias("_last"))
    placed = first.join(start, "name")
    is_first = place == F.col("_first")
    kind = F.col("log") % 3
    second = placed.where((kind == 2) | (F.col("_n") == 1) | (kind == 1) | is_first).withColumn(
        "value", F.when((kind == 1) & ~is_first, F.concat(F.lit("again: "), "value")).otherwise(F.col("value"))
    )
    end = placed.where((kind == 2) & (place == F.col("_last"))).withColumns(
        {"value": F.lit("grown"), "turn": F.col("turn") + 1}
    )
    write_logs(second.unionByName(end), source, order)
    forward(spark, source, forwarder).awaitTermination()
    events = spark.read.parquet(forwarder.table("delivered")).select(F.inline("events"))
    return events.select(
        file_key("log"), file_key("part"), "generation", "line_number", "byte_offset", "sha256"
    )


@query("stream_liveness")
def stream_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each endpoint was first heard, fell silent and came back."""
    events = event_stream(spark, sf_dir).withColumn(
        "endpoint", F.coalesce(F.nullif(F.col("endpoint_id"), F.lit("")), F.col("hostname"))
    )
    out = shared_dir(spark, "stream_liveness")
    windows.write_updates(
        liveness(events), f"{out}/table", f"{out}/checkpoint"
    ).awaitTermination()
    return spark.read.option("basePath", f"{out}/table").parquet(f"{out}/table/update=*").drop("update")

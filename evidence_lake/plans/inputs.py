"""The given tables in the shape of the engine's own inputs.

events stands for normalised log events: one host per ten users, one file per user in which
event n takes the 256-byte slot n, and `props` as the raw line. conversations stands for
session transcripts, one line per turn: one log file for 32 conversations, rolled over by turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ticks import floor_div
from ..operators.packing import event_size
from ..schema import CHUNK_BYTES
from ..session import configure, shared_dir
from ..sources.adapters import Capture, to_canonical
from ..sources.byte_ranges import open_file_system

SLOT_BYTES = 256
# A log file holds this many conversations and no more than this many turns of each, so the
# size of a file has a bound.
CONVERSATIONS_PER_LOG = 32
TURNS_PER_FILE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


CAPTURE = Capture(hostname="fleet", os_user="agent", captured_at_ns=1_706_745_600_000_000_000)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log_of(table(spark, sf_dir, "events"))


def event_log_of(events: DataFrame) -> DataFrame:
    """Canonical events of the events table, with tenant, endpoint and file chunk."""
    host = F.concat(F.lit("host-"), (F.col("user_id") % 10).cast("string"))
    lines = events.select(
        "event_id",
        "user_id",
        "event_type",
        "ts",
        "props",
        F.concat(F.lit("/logs/"), host, F.lit("/"), F.col("user_id"), F.lit(".jsonl")).alias(
            "file_path"
        ),
        (F.col("event_id") + 1).alias("line_number"),
        (F.col("event_id") * SLOT_BYTES).alias("byte_offset"),
        (F.col("event_id") * SLOT_BYTES + F.octet_length("props") + 1).alias("byte_end"),
        F.octet_length("props").cast("bigint").alias("byte_length"),
        F.col("props").alias("value"),
    )
    ns = micros(F.col("ts")) * 1000
    canonical = to_canonical(
        lines,
        CAPTURE,
        source="events",
        event_ns=ns,
        captured_at_ns=ns,
        payload=F.col("props"),
        subtype=F.col("event_type"),
        session_id=F.col("user_id").cast("string"),
        hostname=host,
        extra={
            "endpoint_id": F.when(F.col("user_id") % 3 == 1, "").otherwise(
                F.concat(F.lit("ep-"), (F.col("user_id") % 30).cast("string"))
            ),
            "tenant": F.when(F.col("user_id") % 3 == 0, "demo").otherwise("prod"),
            "row_id": F.col("event_id"),
        },
    )
    return canonical.withColumn("chunk", floor_div(F.col("byte_offset"), CHUNK_BYTES))


# The same columns for the SQL side; every oracle that needs them starts with this.
EVENT_LOG_SQL = """
slots AS (
  SELECT event_id AS row_id, ts, user_id, event_type AS subtype, props,
         'host-' || (user_id % 10) AS hostname,
         '/logs/host-' || (user_id % 10) || '/' || user_id || '.jsonl' AS file_path,
         event_id * 256 AS byte_offset,
         CAST(strlen(props) AS BIGINT) AS byte_length,
         sha256(props) AS sha256,
         epoch_us(ts) * 1000 AS ts_ns,
         CAST(epoch_us(ts) // 600000000 AS BIGINT) AS tick_index,
         CASE WHEN user_id % 3 = 1 THEN '' ELSE 'ep-' || (user_id % 30) END AS endpoint_id,
         CASE WHEN user_id % 3 = 0 THEN 'demo' ELSE 'prod' END AS tenant
  FROM events
),
ev AS (
  SELECT *, sha256('events|' || hostname || '|' || file_path || '|' || byte_offset || '|' || sha256)
              AS event_id,
         byte_offset + byte_length + 1 AS byte_end,
         row_id + 1 AS line_number,
         CAST(user_id AS VARCHAR) AS session_id,
         byte_offset // 16777216 AS chunk
  FROM slots
)
"""


def sized_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log with each event's size as compact JSON of its envelope."""
    return event_log(spark, sf_dir).withColumn(
        "event_bytes",
        event_size("event_id", "session_id", "file_path", "byte_offset", "sha256", "ts_ns", "payload"),
    )


SIZED_SQL = (
    EVENT_LOG_SQL
    + """,
sized AS (
  SELECT *, CAST(strlen(CAST(to_json({'event_id': event_id, 'session_id': session_id,
         'file_path': file_path, 'byte_offset': byte_offset, 'sha256': sha256, 'ts_ns': ts_ns,
         'payload': props}) AS VARCHAR)) AS BIGINT) AS event_bytes
  FROM ev
)
"""
)


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as raw lines with their log file (log, part)."""
    text = F.translate("text", "\r\n", "  ")
    return table(spark, sf_dir, "conversations").select(
        floor_div(F.col("conv_id"), CONVERSATIONS_PER_LOG).alias("log"),
        floor_div(F.col("turn"), TURNS_PER_FILE).alias("part"),
        "conv_id",
        "turn",
        F.concat("role", F.lit(": "), text).alias("value"),
    )


def _ranged_sql(file: str, order: str) -> str:
    return f"""
lines AS (
  SELECT conv_id // 32 AS log, turn // 4096 AS part, conv_id, turn,
         role || ': ' || translate(text, chr(13) || chr(10), '  ') AS value
  FROM conversations
),
placed AS (
  SELECT *, CAST(strlen(value) AS BIGINT) AS byte_length,
         row_number() OVER w AS line_number,
         CAST(sum(strlen(value) + 1) OVER w AS BIGINT) AS byte_end,
         sha256(value) AS sha256
  FROM lines
  WINDOW w AS (PARTITION BY {file} ORDER BY {order}
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
ranged AS (SELECT *, byte_end - byte_length - 1 AS byte_offset FROM placed)
"""


# Lines placed in their log file, and in their conversation as if that were the file.
LOG_SQL = _ranged_sql("log, part", "conv_id, turn")
CONVERSATION_SQL = _ranged_sql("conv_id", "turn")


def write_transcripts(spark: SparkSession, sf_dir: str) -> str:
    """The transcripts as text files, one per (log, part), in the shared folder."""
    path = shared_dir(spark, "transcripts")
    (
        transcript(spark, sf_dir)
        .repartition("log", "part")
        .sortWithinPartitions("log", "part", "conv_id", "turn")
        .select("log", "part", "value")
        .write.partitionBy("log", "part")
        .text(path)
    )
    return path


def file_key(name: str) -> Column:
    """Partition value in a transcript's path."""
    return F.regexp_extract("file_path", f"{name}=(\\d+)/", 1).cast("bigint").alias(name)


def write_logs(lines: DataFrame, root: str, order: list[str]) -> None:
    """Lines (name, value and their order) as files of fixed names, as a host writes its logs; a file that
    is there is replaced. Executors write, each its own files."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_system, inner = open_file_system(root)
        name, out = None, None
        for batch in batches:
            for file, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file != name:
                    if out:
                        out.close()
                    path = f"{inner}/{file}"
                    file_system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    name, out = file, file_system.open_output_stream(path)
                out.write(value.encode() + b"\n")
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([], pa.int64())})

    ordered = lines.repartition("name").sortWithinPartitions("name", *order)
    ordered.select("name", "value").mapInArrow(put, "n BIGINT").write.format("noop").mode("overwrite").save()

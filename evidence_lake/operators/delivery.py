"""Delivering batches: idempotent writes, dead letters, offsets and outcomes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ticks import floor_div
from ..schema import (
    ALLOWED_EVENT_TYPES,
    DEAD_LETTER_DDL,
    DEAD_LETTER_STATUS_DDL,
    HEARTBEAT,
    MAX_ATTEMPTS,
    TICK_SECONDS,
)
from ..sources.ledger import latest_offsets, ledger_rows, read_ledger
from ..tables import read_table


# Decisions


def classify_response(status: Column, attempt: Column, replayed: Column | None = None) -> Column:
    """What one answer means for its batch.

    2xx delivered; 429 and 5xx retry until the attempts are used up; 401 and 403 stop the
    run; any other answer rejects: a live batch is parked, a replayed one stays parked. A
    null status is a connection error and counts as a retry.
    """
    last = attempt >= MAX_ATTEMPTS - 1
    replayed = F.lit(False) if replayed is None else replayed
    retryable = status.isNull() | (status == 429) | status.between(500, 599)
    return (
        F.when(status.between(200, 299), "delivered")
        .when(retryable & ~last, "retry")
        .when(retryable & replayed, "kept_parked")
        .when(retryable, "parked_exhausted")
        .when(status.isin(401, 403), "auth_fatal")
        .when(replayed, "kept_parked")
        .otherwise("parked_rejected")
    )


def park_reason(outcome: Column, status: Column) -> Column:
    return F.when(outcome == "parked_exhausted", "retries_exhausted").when(
        outcome == "parked_rejected", F.concat(F.lit("http_"), status.cast("string"))
    )


def delivery_outcomes(attempts: DataFrame, *carry: str, replayed: bool = False) -> DataFrame:
    """Per batch: attempts, retries, last status and what became of it.

    Name in `carry` columns that are the same for all attempts of a batch. A replayed batch that is
    refused again has no new reason: it stays parked.
    """
    judged = attempts.withColumn(
        "outcome", classify_response(F.col("status"), F.col("attempt"), F.lit(replayed))
    )
    final = judged.groupBy("batch_id", *carry).agg(
        F.count("*").alias("attempts"),
        F.count_if(F.col("outcome") == "retry").alias("retries"),
        F.max_by(F.struct("status", "outcome"), "attempt").alias("_last"),
    )
    return final.select(
        "batch_id",
        *carry,
        "attempts",
        "retries",
        F.col("_last.status").alias("last_status"),
        F.col("_last.outcome").alias("outcome"),
        park_reason(F.col("_last.outcome"), F.col("_last.status")).alias("reason"),
    )


def events_with_outcome(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Each event with the outcome of its batch; null while the batch is open."""
    return events.join(outcomes, "batch_id", "left")


# Idempotency


def not_delivered(batches: DataFrame, delivered: DataFrame, *also_on: str) -> DataFrame:
    """Batches whose id was not delivered before."""
    return batches.join(delivered, ["batch_id", *also_on], "left_anti")


def undelivered(sealed: DataFrame, delivered: DataFrame, parked: DataFrame) -> DataFrame:
    """Sealed but neither delivered nor parked."""
    return sealed.join(delivered, "batch_id", "left_anti").join(parked, "batch_id", "left_anti")


def allowed_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(*ALLOWED_EVENT_TYPES))


def accepted_counts(sent: DataFrame) -> DataFrame:
    """Events the receiver accepts per batch: allowed types, each event of a batch once."""
    return (
        allowed_events(sent)
        .dropDuplicates(["batch_id", "event_id"])
        .groupBy("batch_id")
        .agg(F.count("*").alias("accepted"))
    )


# Sinks


def tick_day(tick: Column, tick_seconds: int = TICK_SECONDS) -> Column:
    """Days since the epoch, the partition of the delivered tables."""
    return floor_div(tick, 86400 // tick_seconds).cast("int")


def append_new(
    spark: SparkSession, batches: DataFrame, path: str, *partition: str
) -> None:
    """Append the batches whose id the table does not hold yet."""
    try:
        present = spark.read.parquet(path).select("batch_id", *partition)
    except AnalysisException as error:
        # Nothing was written yet, or only empty batches.
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        if partition:
            # An anti join prunes nothing by itself. The list holds a row per day at most.
            touched = F.broadcast(batches.select(*partition).distinct())
            present = present.join(touched, [*partition], "left_semi")
        # A repeat brings nothing new. Ids say so, without a shuffle of the bodies.
        if not_delivered(batches.select("batch_id", *partition), present, *partition).isEmpty():
            return
        batches = not_delivered(batches, present, *partition)
    if partition:
        # Few files per partition, yet a large partition is still written by many tasks.
        batches = batches.hint("rebalance", *partition)
    batches.write.mode("append").partitionBy(*partition).parquet(path)


def write_batches(spark: SparkSession, batches: DataFrame, path: str) -> None:
    """Deliver batches, partitioned by tick day.

    A batch's content fixes its id and its day, so a repeated delivery after a crash finds
    itself in the same partition and is skipped; older partitions are not read.
    """
    append_new(
        spark, batches.withColumn("tick_day", tick_day(F.col("tick_index"))), path, "tick_day"
    )


def park(
    spark: SparkSession, envelopes: DataFrame, reason: Column, path: str, parked_ns: Column
) -> None:
    """Set batches aside with the reason; the body keeps its batch id and is complete."""
    outcome = ("attempts", "retries", "last_status", "outcome", "reason")
    body = F.to_json(F.struct(*[c for c in envelopes.columns if c not in outcome]))
    letters = envelopes.select(
        parked_ns.cast("bigint").alias("parked_ns"),
        "batch_id",
        reason.alias("reason"),
        body.alias("body"),
    )
    append_new(spark, letters, path)


def unpack_bodies(letters: DataFrame, schema: str) -> DataFrame:
    """Parked bodies as envelopes again."""
    return letters.select(F.from_json("body", schema).alias("_body")).select("_body.*")


def commit_points(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per file the furthest handled event. Heartbeats have no file and are left out."""
    keys = keys or ["file_path"]
    if "event_type" in events.columns:
        events = events.where(F.col("event_type") != HEARTBEAT)
    furthest = F.struct("byte_end", "line_number", "sha256")
    return (
        events.groupBy(*keys)
        .agg(F.max(furthest).alias("_at"))
        .select(
            *keys,
            F.col("_at.byte_end").alias("byte_offset"),
            F.col("_at.line_number").alias("last_line_number"),
            F.col("_at.sha256").alias("last_sha256"),
        )
    )


def append_points(points: DataFrame, path: str, now_ns: int) -> None:
    """Append commit points to a ledger without rounds."""
    ledger_rows(points, now_ns).write.mode("append").parquet(path)


def commit_offsets(handled: DataFrame, path: str, now_ns: int) -> None:
    """Append the commit point of every file in `handled` to the ledger."""
    append_points(commit_points(handled), path, now_ns)


def compact_offsets(spark: SparkSession, path: str, target: str) -> None:
    """Write the newest entry per file to a new table; the caller switches over to it."""
    newest = latest_offsets(read_offsets(spark, path))
    newest.write.mode("errorifexists").parquet(target)


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    return read_ledger(spark, path)


# Dead letters


def read_dead_letter_files(spark: SparkSession, path: str) -> DataFrame:
    """Parked bodies stored as one JSON document per line, `{"reason", "body"}`.

    The time of parking is in the name of a file with one document, else in the document.
    Only files directly under `path` count; what was archived lies in a folder below.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("value"),
    )
    doc = F.try_parse_json("value")
    return lines.select(
        "file_path",
        F.coalesce(
            F.regexp_extract("file_name", r"^(\d+)_", 1).try_cast("bigint"),
            F.try_variant_get(doc, "$.parked_ns", "bigint"),
        ).alias("parked_ns"),
        F.try_variant_get(doc, "$.body.batch_id", "string").alias("batch_id"),
        F.try_variant_get(doc, "$.reason", "string").alias("reason"),
        F.to_json(F.try_variant_get(doc, "$.body", "variant")).alias("body"),
    )


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, DEAD_LETTER_DDL)


def with_event_count(letters: DataFrame) -> DataFrame:
    """Adds events: length of the body's event list, null where there is no such list."""
    listed = F.try_variant_get(F.try_parse_json("body"), "$.events", "array<variant>")
    return letters.withColumn("events", F.size(listed).cast("bigint")).withColumn(
        "events", F.when(F.col("events") >= 0, F.col("events"))
    )


def split_valid(letters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Letters that can be replayed, and those that cannot (kept and reported)."""
    counted = with_event_count(letters)
    valid = F.col("events").isNotNull() & (F.coalesce("batch_id", F.lit("")) != "")
    return counted.where(valid), counted.where(~valid)


def waiting(letters: DataFrame, statuses: DataFrame) -> DataFrame:
    """Parked and not replayed yet."""
    replayed = statuses.where(F.col("status") == "replayed").select("batch_id")
    return letters.join(replayed, "batch_id", "left_anti")


def replay_order(letters: DataFrame) -> DataFrame:
    """Oldest parked first."""
    return letters.orderBy("parked_ns", "batch_id")


def dead_letter_totals(letters: DataFrame) -> DataFrame:
    return letters.agg(
        F.count("*").alias("letters"), F.coalesce(F.sum("events"), F.lit(0)).alias("events")
    )


def archive_replayed(batch_ids: DataFrame, path: str, now_ns: int) -> None:
    """Mark batches as replayed; nothing is deleted."""
    batch_ids.select(
        "batch_id",
        F.lit("replayed").alias("status"),
        F.lit(now_ns).cast("bigint").alias("at_ns"),
    ).write.mode("append").parquet(path)


def read_statuses(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, DEAD_LETTER_STATUS_DDL)


def replayed_and_live(replayed: DataFrame, live: DataFrame) -> DataFrame:
    """Both feed delivery as separate batches, told apart by `origin`."""
    return replayed.withColumn("origin", F.lit("replay")).unionByName(
        live.withColumn("origin", F.lit("live")), allowMissingColumns=True
    )

"""Queries on batching, delivery, dead letters and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ticks import floor_div, tick_index
from ..operators import delivery
from ..operators.letters import UNUSABLE, Mailbox, commit_letters, letters_of, states_before, waiting_before
from ..operators.packing import (
    batch_summary,
    envelopes,
    load_state,
    pack,
    queue_totals,
    with_batch_id,
)
from ..session import shared_dir
from ..sources.ledger import COMPACT_EVERY
from .catalog import query
from .inputs import CAPTURE, SIZED_SQL, sized_events

# Limits of the queries' batches: small, so that both are reached on small tables.
BATCH_EVENTS = 50
BATCH_BYTES = 16 * 1024
STREAM = ["hostname"]
KEYS = ["hostname", "slot_events", "slot_bytes"]
# Rows of the event log whose ids fall in one block are summed in one task.
CHUNK_ROWS = 65_536
NOW_NS = CAPTURE.captured_at_ns


def packed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log cut into batches, one stream per host, in arrival order."""
    events = sized_events(spark, sf_dir).withColumn(
        "id_block", floor_div(F.col("row_id"), CHUNK_ROWS)
    )
    return pack(
        events,
        stream=STREAM,
        chunk=["id_block"],
        order=["row_id"],
        max_events=BATCH_EVENTS,
        max_bytes=BATCH_BYTES,
    )


PACKED_SQL = f"""
{SIZED_SQL},
running AS (
  SELECT *, row_number() OVER w - 1 AS events_before,
         CAST(sum(event_bytes) OVER w - event_bytes AS BIGINT) AS bytes_before
  FROM sized
  WINDOW w AS (PARTITION BY hostname ORDER BY row_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
packed AS (
  SELECT *, events_before // {BATCH_EVENTS} AS slot_events, bytes_before // {BATCH_BYTES} AS slot_bytes
  FROM running
),
batches AS (
  SELECT hostname, slot_events, slot_bytes, count(*) AS events,
         CAST(sum(event_bytes) AS BIGINT) AS bytes,
         sha256(string_agg(event_id, chr(10) ORDER BY event_id) || chr(10)) AS batch_id
  FROM packed GROUP BY hostname, slot_events, slot_bytes
)
"""


@query("pack_batches", f"WITH {PACKED_SQL} SELECT row_id, hostname, slot_events, slot_bytes, event_bytes FROM packed")
def pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_events(spark, sf_dir).select(
        "row_id", "hostname", "slot_events", "slot_bytes", "event_bytes"
    )


@query("batch_ids", f"WITH {PACKED_SQL} SELECT * FROM batches")
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_summary(packed_events(spark, sf_dir), STREAM)


EVENT_FIELDS = [
    "event_id", "event_type", "file_path", "line_number", "byte_offset", "byte_end",
    "byte_length", "sha256", "ts_ns", "payload",
]


def enveloped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes(
        packed_events(spark, sf_dir), STREAM, EVENT_FIELDS, ["file_path", "byte_offset"]
    )


@query(
    "envelopes",
    f"""
WITH {PACKED_SQL}
SELECT sha256(string_agg(event_id, chr(10) ORDER BY event_id) || chr(10)) AS batch_id,
       hostname AS source_id, 'evidence-lake' AS agent_id, hostname AS endpoint_name,
       max(nullif(endpoint_id, '')) AS endpoint_id,
       coalesce(max(nullif(endpoint_id, '')), hostname) AS identity,
       max(ts_ns) AS sealed_at_ns, count(*) AS event_count,
       arg_min(event_id, (file_path, byte_offset)) AS first_event,
       arg_max(event_id, (file_path, byte_offset)) AS last_event
FROM packed GROUP BY hostname, slot_events, slot_bytes
""",
)
def envelope_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    sealed = enveloped(spark, sf_dir)
    return sealed.select(
        "batch_id",
        "source_id",
        "agent_id",
        "endpoint_name",
        "endpoint_id",
        F.coalesce("endpoint_id", "source_id").alias("identity"),
        "sealed_at_ns",
        F.size("events").cast("bigint").alias("event_count"),
        F.element_at("events", 1)["event_id"].alias("first_event"),
        F.element_at("events", -1)["event_id"].alias("last_event"),
    )


@query(
    "load_state",
    f"""
WITH {SIZED_SQL},
totals AS (
  SELECT hostname, ts_ns // 604800000000000 AS tick_index, count(*) AS events,
         CAST(sum(event_bytes) AS BIGINT) AS bytes
  FROM sized GROUP BY ALL
)
SELECT *, CASE WHEN events >= 1000 OR bytes >= 5242880 THEN 'flush'
               WHEN events >= 200 OR bytes >= 1048576 THEN 'loaded' ELSE 'idle' END AS load_state
FROM totals
""",
)
def load_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue load per host and week-long tick."""
    events = sized_events(spark, sf_dir).withColumn(
        "tick_index", tick_index(F.col("ts_ns"), 7 * 86400)
    )
    return load_state(queue_totals(events, ["hostname", "tick_index"]))


@query(
    "accepted_counts",
    f"""
WITH {PACKED_SQL}
SELECT batch_id, count(*) AS accepted
FROM packed JOIN batches USING (hostname, slot_events, slot_bytes)
WHERE subtype <> 'error' GROUP BY batch_id
""",
)
def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch arrives twice and error events carry a type the receiver refuses."""
    typed = packed_events(spark, sf_dir).withColumn(
        "event_type", F.when(F.col("subtype") == "error", "debug").otherwise(F.col("event_type"))
    )
    named = with_batch_id(typed, STREAM, ["event_id", "event_type"])
    twice = named.withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1))))
    return delivery.accepted_counts(twice)


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_summary(packed_events(spark, sf_dir), STREAM)


@query(
    "dedup_delivered",
    f"""
WITH {PACKED_SQL}
SELECT batch_id, events FROM batches
WHERE batch_id NOT IN (SELECT batch_id FROM batches WHERE slot_events % 3 = 0)
  AND batch_id NOT IN (SELECT batch_id FROM batches WHERE slot_events % 5 = 1)
""",
)
def dedup_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third slot was delivered, every fifth parked; what is left to send?"""
    sealed = _batches(spark, sf_dir)
    done = sealed.where(F.col("slot_events") % 3 == 0).select("batch_id")
    parked = sealed.where(F.col("slot_events") % 5 == 1).select("batch_id")
    return delivery.undelivered(sealed.select("batch_id", "events"), done, parked)


def _answers(slot: Column) -> Column:
    """HTTP answers a batch gets, by its slot."""
    plans = [
        [200],
        [500, 503, 200],
        [429] * 6,
        [422],
        [429, 404],
        [401],
        [None, 202],
    ]
    chosen = None
    for index, plan in enumerate(plans):
        answers = F.array(*[F.lit(s).cast("int") for s in plan])
        hit = slot % len(plans) == index
        chosen = F.when(hit, answers) if chosen is None else chosen.when(hit, answers)
    return chosen


ATTEMPTS_SQL = f"""
{PACKED_SQL},
attempts AS (
  SELECT batch_id, events, slot_events,
         CASE slot_events % 7 WHEN 0 THEN [200] WHEN 1 THEN [500, 503, 200]
           WHEN 2 THEN [429, 429, 429, 429, 429, 429] WHEN 3 THEN [422] WHEN 4 THEN [429, 404]
           WHEN 5 THEN [401] ELSE [NULL, 202] END AS answers
  FROM batches
),
outcomes AS (
  SELECT batch_id, events, CAST(len(answers) AS BIGINT) AS attempts,
         CAST(CASE slot_events % 7 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 4 THEN 1 WHEN 6 THEN 1 ELSE 0 END
              AS BIGINT) AS retries,
         answers[-1] AS last_status,
         CASE slot_events % 7 WHEN 2 THEN 'parked_exhausted' WHEN 3 THEN 'parked_rejected'
           WHEN 4 THEN 'parked_rejected' WHEN 5 THEN 'auth_fatal' ELSE 'delivered' END AS outcome,
         CASE slot_events % 7 WHEN 2 THEN 'retries_exhausted' WHEN 3 THEN 'http_422'
           WHEN 4 THEN 'http_404' END AS reason
  FROM attempts
)
"""


def _outcomes(batches: DataFrame, *carry: str) -> DataFrame:
    answers = F.posexplode(_answers(F.col("slot_events"))).alias("attempt", "status")
    return delivery.delivery_outcomes(batches.select("batch_id", *carry, answers), *carry)


@query("delivery_outcomes", f"WITH {ATTEMPTS_SQL} SELECT * FROM outcomes")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(_batches(spark, sf_dir), "events")


def sealed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes stored before delivery, as the forwarder does."""
    path = shared_dir(spark, "sealed")
    enveloped(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


@query(
    "event_outcomes",
    f"""
WITH {ATTEMPTS_SQL}
SELECT p.hostname, o.outcome, count(*) AS events, CAST(sum(p.byte_length) AS BIGINT) AS bytes
FROM packed p JOIN batches b USING (hostname, slot_events, slot_bytes)
JOIN outcomes o ON o.batch_id = b.batch_id GROUP BY ALL
""",
)
def event_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each host's events, over event, batch and answer."""
    sealed = sealed_batches(spark, sf_dir)
    events = sealed.select("batch_id", "source_id", F.inline("events"))
    judged = delivery.events_with_outcome(events, _outcomes(sealed))
    return judged.groupBy(F.col("source_id").alias("hostname"), "outcome").agg(
        F.count("*").alias("events"), F.sum("byte_length").alias("bytes")
    )


@query(
    "dead_letter_queue",
    f"""
WITH {ATTEMPTS_SQL},
letters AS (
  SELECT b.batch_id, o.reason, b.events, b.slot_events,
         CAST(1706745600000000000 + b.slot_events * 1000 + CAST(right(b.hostname, 1) AS BIGINT) AS BIGINT)
           AS parked_ns
  FROM batches b JOIN outcomes o USING (batch_id) WHERE o.reason IS NOT NULL
)
SELECT parked_ns, batch_id, reason, events FROM letters
WHERE slot_events % 4 <> 3 AND slot_events % 7 <> 4
""",
)
def dead_letter_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parked bodies written as JSON documents and read back.

    Every fourth slot was replayed since; bodies of 404 answers lost their event list and
    are set aside.
    """
    sealed = sealed_batches(spark, sf_dir)
    parked = sealed.join(_outcomes(sealed).where("reason IS NOT NULL"), "batch_id")
    whole = F.col("reason") != "http_404"
    parked_ns = (
        F.lit(NOW_NS) + F.col("slot_events") * 1000 + F.substring("source_id", -1, 1).cast("bigint")
    )
    path = shared_dir(spark, "dead_letters")
    parked.select(
        parked_ns.alias("parked_ns"),
        "reason",
        F.to_json(
            F.struct(
                parked_ns.alias("parked_ns"),
                "reason",
                F.struct(
                    "batch_id",
                    "source_id",
                    "slot_events",
                    F.when(whole, F.col("events")).alias("events"),
                ).alias("body"),
            )
        ).alias("value"),
    ).select("value").write.text(path)
    letters, _ = delivery.split_valid(delivery.read_dead_letter_files(spark, path))
    slot = F.try_variant_get(F.try_parse_json("body"), "$.slot_events", "bigint")
    replayed = letters.where(slot % 4 == 3).select(
        "batch_id", F.lit("replayed").alias("status"), F.lit(NOW_NS).alias("at_ns")
    )
    waiting = delivery.waiting(letters, replayed)
    return delivery.replay_order(
        waiting.select("parked_ns", "batch_id", "reason", "events")
    )


@query(
    "letter_states",
    f"""
WITH {ATTEMPTS_SQL},
letters AS (
  SELECT b.batch_id, o.reason, b.events, b.slot_events,
         CAST(1706745600000000000 + b.slot_events * 5400000000000 AS BIGINT) AS parked_ns
  FROM batches b JOIN outcomes o USING (batch_id) WHERE o.reason IS NOT NULL
)
SELECT parked_ns, batch_id, reason, CASE WHEN reason <> 'http_404' THEN events END AS events,
       CASE WHEN reason = 'http_404' THEN 'unusable' ELSE 'waiting' END AS state
FROM letters WHERE reason <> 'retries_exhausted' OR slot_events % 4 = 3
""",
)
def letter_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters that stand after four rounds of parking and replaying with a snapshot among them.

    Each round first replays what had run out of attempts, then parks every fourth slot. Bodies of 404
    answers lost their event list. Events are counted in the bodies that a replay would read.
    """
    root = shared_dir(spark, "letters")
    box = Mailbox(f"{root}/letters", f"{root}/archive", f"{root}/states")
    sealed = sealed_batches(spark, sf_dir)
    stuck = sealed.join(_outcomes(sealed).where("reason IS NOT NULL"), "batch_id")
    whole = F.col("reason") != "http_404"
    stuck.withColumn("events", F.when(whole, F.col("events"))).write.parquet(f"{root}/stuck")
    stuck = spark.read.parquet(f"{root}/stuck")
    first = COMPACT_EVERY - 2
    for number in range(first, first + 4):
        exhausted = waiting_before(spark, box, number).where(F.col("reason") == "retries_exhausted")
        delivery.archive_replayed(exhausted.select("batch_id"), box.replayed(number), NOW_NS)
        parked_ns = F.lit(NOW_NS) + F.col("slot_events") * 5_400_000_000_000
        due = stuck.where(F.col("slot_events") % 4 == number - first)
        delivery.park(spark, due, F.col("reason"), box.parked(number), parked_ns)
        commit_letters(spark, box, number, NOW_NS)
    waits = waiting_before(spark, box, first + 4)
    bodies = delivery.with_event_count(letters_of(spark, box, first + 4, waits))
    unusable = states_before(spark, box, first + 4).where(F.col("state") == UNUSABLE)
    columns = ["parked_ns", "batch_id", "reason", "events"]
    return bodies.select(*columns, F.lit("waiting").alias("state")).unionByName(
        unusable.select(*columns, "state")
    )


@query(
    "replay_flow",
    f"""
WITH {ATTEMPTS_SQL}
SELECT batch_id, events,
       CASE WHEN outcome = 'delivered' THEN 'live' WHEN outcome = 'parked_exhausted' THEN 'replay'
            WHEN outcome = 'parked_rejected' THEN NULL END AS origin,
       CASE WHEN outcome = 'delivered' THEN 'delivered'
            WHEN outcome = 'parked_exhausted' THEN 'replayed'
            WHEN outcome = 'parked_rejected' THEN 'parked' ELSE 'open' END AS status
FROM outcomes
""",
)
def replay_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliver, park, replay and archive over tables in the shared folder.

    Live batches are delivered or parked by their answers. The replay then succeeds for
    batches that had run out of attempts and fails again for rejected ones. All of it is
    done twice, as after a crash: nothing may change.
    """
    root = shared_dir(spark, "replay")
    delivered, parked = f"{root}/delivered", f"{root}/dead_letters"
    archive = f"{root}/archive"
    batches = sealed_batches(spark, sf_dir)
    # Joined and written once: no step below shuffles the bodies of batches it does not send.
    batches.join(_outcomes(batches), "batch_id").write.parquet(f"{root}/judged")
    judged = spark.read.parquet(f"{root}/judged")
    for _ in range(2):
        live = judged.where(F.col("outcome") == "delivered").withColumn("origin", F.lit("live"))
        delivery.write_batches(spark, live, delivered)
        stuck = judged.where("reason IS NOT NULL")
        delivery.park(spark, stuck, F.col("reason"), parked, F.col("sealed_at_ns"))
        letters, _ = delivery.split_valid(delivery.read_dead_letters(spark, parked))
        waiting = delivery.waiting(letters, delivery.read_statuses(spark, archive))
        again = waiting.where(F.col("reason") == "retries_exhausted").select("batch_id")
        exhausted = judged.where(F.col("outcome") == "parked_exhausted").select(*batches.columns)
        replayed = delivery.replayed_and_live(
            exhausted.join(again, "batch_id", "left_semi"), batches.limit(0)
        )
        delivery.write_batches(spark, replayed, delivered)
        done = spark.read.parquet(delivered).where(F.col("origin") == "replay")
        delivery.archive_replayed(again.join(done, "batch_id", "left_semi"), archive, NOW_NS)
    sent = spark.read.parquet(delivered).groupBy("batch_id").agg(
        F.count("*").alias("copies"), F.first("origin").alias("origin")
    )
    statuses = delivery.read_statuses(spark, archive).select("batch_id", "status").distinct()
    held = delivery.read_dead_letters(spark, parked).select("batch_id", F.lit(True).alias("held"))
    final = (
        batches.select("batch_id", F.size("events").cast("bigint").alias("events"))
        .join(sent, "batch_id", "left")
        .join(statuses, "batch_id", "left")
        .join(held, "batch_id", "left")
    )
    return final.select(
        "batch_id",
        "events",
        "origin",
        F.when(F.col("status") == "replayed", "replayed")
        .when(F.col("copies") == 1, "delivered")
        .when(F.col("copies") > 1, "delivered twice")
        .when(F.col("held"), "parked")
        .otherwise("open")
        .alias("status"),
    )

"""Queries on hash-chained audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ticks import floor_div
from ..operators import audit
from ..operators.audit import SEGMENT_RECORDS
from ..schema import AUDIT_DDL
from ..session import shared_dir
from .catalog import query
from .inputs import micros, table

# Audit kinds the event types stand for.
KINDS = {
    "click": "batch_shipped",
    "view": "batch_retry",
    "purchase": "batch_dead_lettered",
    "error": "batch_rejected",
    "signup": "startup",
}


def kind_of(event_type):
    chosen = F.lit(None).cast("string")
    for name, kind in KINDS.items():
        chosen = F.when(event_type == name, kind).otherwise(chosen)
    return chosen


KIND_SQL = " ".join(f"WHEN '{name}' THEN '{kind}'" for name, kind in KINDS.items())

RECORDS_SQL = f"""
records AS (
  SELECT 'host-' || (user_id % 10) || '/' || (event_id // {SEGMENT_RECORDS}) AS log_id,
         row_number() OVER (PARTITION BY user_id % 10, event_id // {SEGMENT_RECORDS}
                            ORDER BY event_id) - 1 AS pos,
         CASE event_type {KIND_SQL} END AS kind,
         '{{"event":' || event_id || '}}' AS payload, epoch_us(ts) * 1000 AS ts_ns, event_id
  FROM events
),
chained AS (
  SELECT log_id, pos, event_id,
         '{{"kind":"' || kind || '","payload":' || payload || ',"prev_hash":"genesis","seq":0,"ts_ns":'
         || ts_ns || '}}' AS line
  FROM records WHERE pos = 0
  UNION ALL
  SELECT r.log_id, r.pos, r.event_id,
         '{{"kind":"' || r.kind || '","payload":' || r.payload || ',"prev_hash":"' || sha256(c.line)
         || '","seq":' || r.pos || ',"ts_ns":' || r.ts_ns || '}}'
  FROM chained c JOIN records r ON r.log_id = c.log_id AND r.pos = c.pos + 1
)
"""


def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit records: one log per host and block of a thousand event ids."""
    segment = floor_div(F.col("event_id"), SEGMENT_RECORDS)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("host-"), F.col("user_id") % 10, F.lit("/"), segment).alias("log_id"),
        "event_id",
        kind_of(F.col("event_type")).alias("kind"),
        F.concat(F.lit('{"event":'), F.col("event_id"), F.lit("}")).alias("payload"),
        (micros(F.col("ts")) * 1000).alias("ts_ns"),
    )


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.build_chains(audit_records(spark, sf_dir), order=["event_id"])


@query(
    "audit_kinds",
    f"""
SELECT 'host-' || (user_id % 10) AS hostname, CASE event_type {KIND_SQL} END AS kind,
       count(*) AS records
FROM events GROUP BY ALL
""",
)
def audit_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.substring_index("log_id", "/", 1).alias("hostname")
    return audit.audit_kinds(audit_records(spark, sf_dir).select(host, "kind"), ["hostname"])


@query("chain_build", f"WITH RECURSIVE {RECORDS_SQL} SELECT log_id, pos, line FROM chained")
def chain_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains(spark, sf_dir)


# Damage done to the chains: every 97th event's record is edited in place, and of every 89th
# only a broken piece is left.
EDITED_SQL = f"""
{RECORDS_SQL},
edited AS (
  SELECT log_id, pos, CASE WHEN event_id % 97 = 5 THEN replace(line, '"event":', '"event":1')
         WHEN event_id % 89 = 7 THEN substr(line, 1, 40) ELSE line END AS line
  FROM chained
),
fields AS (
  SELECT log_id, pos, line, CAST(json_extract_string(line, '$.seq') AS BIGINT) AS seq,
         json_extract_string(line, '$.prev_hash') AS prev_hash, sha256(line) AS line_sha256
  FROM (SELECT * FROM edited WHERE json_valid(line))
),
links AS (
  SELECT *, lag(line_sha256) OVER w AS before_hash, lag(seq) OVER w AS before_seq
  FROM fields WINDOW w AS (PARTITION BY log_id ORDER BY pos)
),
judged AS (
  SELECT *, seq = 0 AND prev_hash = 'genesis' AS restart,
         prev_hash = coalesce(before_hash, 'genesis')
           OR (seq = 0 AND prev_hash = 'genesis' AND before_hash IS NOT NULL) AS link_ok,
         CASE WHEN seq = 0 AND prev_hash = 'genesis' THEN 0
              ELSE seq - coalesce(before_seq, -1) - 1 END AS gap
  FROM links
)
"""


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains as a stored audit table, with the damage."""
    event = F.regexp_extract("line", r'"event":(\d+)', 1).cast("bigint")
    path = shared_dir(spark, "audit")
    chains(spark, sf_dir).withColumn(
        "line",
        F.when(event % 97 == 5, F.replace("line", F.lit('"event":'), F.lit('"event":1')))
        .when(event % 89 == 7, F.substring("line", 1, 40))
        .otherwise(F.col("line")),
    ).write.parquet(path)
    return spark.read.schema(AUDIT_DDL).parquet(path)


@query(
    "chain_verify",
    f"""
WITH RECURSIVE {EDITED_SQL}
SELECT log_id, count(*) AS records, count(*) FILTER (WHERE NOT link_ok) AS broken_links,
       count(*) FILTER (WHERE gap <> 0) AS seq_gaps, count(*) FILTER (WHERE restart) AS chains,
       max(seq) AS head_seq, bool_and(link_ok) AND bool_and(gap = 0) AS valid
FROM judged GROUP BY log_id
""",
)
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.chain_status(audit.verify_links(damaged(spark, sf_dir)))


@query(
    "chain_links",
    f"""
WITH RECURSIVE {EDITED_SQL}
SELECT log_id, pos, seq, link_ok, restart, CAST(gap AS BIGINT) AS gap,
       CAST(sum(CAST(restart AS INTEGER)) OVER (PARTITION BY log_id ORDER BY pos) AS BIGINT) AS segment
FROM judged
""",
)
def chain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.verify_links(damaged(spark, sf_dir)).drop("kind", "line_sha256")


@query(
    "chain_head",
    f"""
WITH RECURSIVE {EDITED_SQL}
SELECT log_id, arg_max(seq, pos) + 1 AS next_seq, arg_max(line_sha256, pos) AS prev_hash
FROM fields GROUP BY log_id
""",
)
def chain_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.chain_heads(damaged(spark, sf_dir))


# The same records arriving in three rounds, in segments of this many.
ROUNDS = 3
ROUND_SEGMENT = 200

ROUNDS_SQL = f"""
numbered AS (
  SELECT 'host-' || (user_id % 10) AS parent, event_id % {ROUNDS} AS round, event_id,
         row_number() OVER (PARTITION BY user_id % 10, event_id % {ROUNDS} ORDER BY event_id) - 1 AS n,
         CASE event_type {KIND_SQL} END AS kind, '{{"event":' || event_id || '}}' AS payload,
         epoch_us(ts) * 1000 AS ts_ns
  FROM events
),
cut AS (
  SELECT *, parent || '/' || lpad(CAST(round AS VARCHAR), 8, '0') || '/'
         || lpad(CAST(n // {ROUND_SEGMENT} AS VARCHAR), 8, '0') AS log_id, n % {ROUND_SEGMENT} AS pos
  FROM numbered
)
"""


def rounds(spark: SparkSession, sf_dir: str) -> str:
    """The audit that three rounds of events leave."""
    records = audit_records(spark, sf_dir).withColumns(
        {"parent": F.substring_index("log_id", "/", 1), "_chunk": floor_div(F.col("event_id"), 65_536)}
    )
    root = shared_dir(spark, "audit-rounds")
    for number in range(ROUNDS):
        of_round = records.where(F.col("event_id") % ROUNDS == number).drop("log_id")
        audit.emit_round(
            spark, of_round, root, number, number, order=["event_id"], chunk=["_chunk"], size=ROUND_SEGMENT
        )
    return root


@query(
    "audit_forward",
    f"""
WITH RECURSIVE {ROUNDS_SQL},
linked AS (
  SELECT log_id, pos, parent, round,
         '{{"kind":"' || kind || '","payload":' || payload || ',"prev_hash":"genesis","seq":0,"ts_ns":'
         || ts_ns || '}}' AS line
  FROM cut WHERE pos = 0
  UNION ALL
  SELECT c.log_id, c.pos, c.parent, c.round,
         '{{"kind":"' || c.kind || '","payload":' || c.payload || ',"prev_hash":"' || sha256(l.line)
         || '","seq":' || c.pos || ',"ts_ns":' || c.ts_ns || '}}'
  FROM linked l JOIN cut c ON c.log_id = l.log_id AND c.pos = l.pos + 1
),
heads AS (
  SELECT parent, round, row_number() OVER (PARTITION BY parent ORDER BY log_id) - 1 AS pos,
         '{{"head":"' || sha256(arg_max(line, linked.pos)) || '","records":' || (max(linked.pos) + 1)
         || ',"segment":"' || log_id || '"}}' AS payload
  FROM linked GROUP BY parent, round, log_id
),
sealed AS (
  SELECT parent AS log_id, pos, '{{"kind":"segment_sealed","payload":' || payload
         || ',"prev_hash":"genesis","seq":0,"ts_ns":' || round || '}}' AS line
  FROM heads WHERE pos = 0
  UNION ALL
  SELECT h.parent, h.pos, '{{"kind":"segment_sealed","payload":' || h.payload || ',"prev_hash":"'
         || sha256(s.line) || '","seq":' || h.pos || ',"ts_ns":' || h.round || '}}'
  FROM sealed s JOIN heads h ON h.parent = s.log_id AND h.pos = s.pos + 1
)
SELECT log_id, pos, line FROM sealed
""",
)
def audit_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parent logs: every segment of every round sealed by its head, in one chain a host."""
    return audit.read_round_table(spark, rounds(spark, sf_dir), "parents")


@query(
    "audit_verify",
    f"""
WITH {ROUNDS_SQL},
segments AS (
  SELECT parent, log_id AS segment, count(*) AS anchored, arg_max(event_id, pos) AS last_event,
         bool_or(event_id % 97 = 5 AND pos < last_pos) AS inner_edit
  FROM (SELECT *, max(pos) OVER (PARTITION BY log_id) AS last_pos FROM cut) GROUP BY parent, log_id
)
SELECT parent, segment, anchored, CASE WHEN last_event % 13 = 4 THEN 0 ELSE anchored END AS records,
       CASE WHEN last_event % 13 = 4 THEN 'missing' WHEN inner_edit THEN 'broken'
            WHEN last_event % 97 = 5 THEN 'edited_end' ELSE 'ok' END AS status
FROM segments
""",
)
def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records edited by rule and whole segments removed by rule, as the anchors show them."""
    root = rounds(spark, sf_dir)
    event = F.regexp_extract("line", r'"event":(\d+)', 1).cast("bigint")
    segments = audit.read_round_table(spark, root, "segments").withColumn("_event", event)
    gone = segments.groupBy("log_id").agg(F.max_by("_event", "pos").alias("_last")).where(F.col("_last") % 13 == 4)
    edited = F.when(event % 97 == 5, F.replace("line", F.lit('"event":'), F.lit('"event":1'))).otherwise(F.col("line"))
    left = segments.join(gone, "log_id", "left_anti").withColumn("line", edited).drop("_event")
    return audit.segment_status(left, audit.read_round_table(spark, root, "parents"))

"""Queries on capture: events, ticks, line scans and parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import line_sha256
from ..functions.redaction import effective_patterns
from ..functions.ticks import floor_div, tick_end_ns, tick_start_ns
from ..functions.timestamps import parse_ts_ns
from ..operators.coverage import coverage, coverage_report, sticky_session
from ..operators.delivery import commit_points
from ..operators.ordered import Prior, with_prior
from ..operators.privacy import exclude_paths, redact_payload, redaction_report, strip_payload
from ..operators.reports import heartbeats
from ..operators.seals import tick_rollup, tick_seal
from ..operators.watches import Watch, match_watches
from ..sources.adapters import adapter_for, to_canonical, union_sources
from ..sources.ledger import cursor_for, latest_offsets, next_cursor, rows_after
from ..sources.lines import scan_lines, scan_new_lines
from .catalog import query
from .inputs import (
    CAPTURE,
    CONVERSATION_SQL,
    EVENT_LOG_SQL,
    LOG_SQL,
    event_log,
    file_key,
    table,
    transcript,
    write_transcripts,
)

CAPTURED_NS = 1_706_745_600_000_000_000


@query(
    "canonical_events",
    f"""
WITH {EVENT_LOG_SQL}
SELECT '1.0' AS event_schema_version, 'tool_event' AS event_type, event_id, subtype, tick_index,
       ts_ns AS captured_at_ns, 'evidence-lake' AS captured_by, '0.1.0' AS capture_version,
       hostname, 'agent' AS os_user, 'events' AS source, CAST(NULL AS VARCHAR) AS source_version,
       session_id, file_path, line_number, byte_offset, byte_end, byte_length,
       'sha256' AS hash_algorithm, sha256, ts_ns, props AS payload
FROM ev
""",
)
def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).drop(
        "project_slug", "payload_stripped", "ts", "endpoint_id", "tenant", "row_id", "chunk"
    )


@query(
    "tick_bounds",
    f"""
WITH {EVENT_LOG_SQL}
SELECT tick_index, tick_index * 600000000000 AS start_ns,
       tick_index * 600000000000 + 599999999999 AS end_ns,
       count(*) AS events, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns
FROM ev GROUP BY tick_index
""",
)
def tick_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = event_log(spark, sf_dir).groupBy("tick_index").agg(
        F.count("*").alias("events"),
        F.min("ts_ns").alias("first_ns"),
        F.max("ts_ns").alias("last_ns"),
    )
    return ticks.withColumns(
        {
            "start_ns": tick_start_ns(F.col("tick_index")),
            "end_ns": tick_end_ns(F.col("tick_index")),
        }
    )


SEAL_SQL = """
leaves AS (
  SELECT {keys}, path, chunk, count(*) AS n, sum(byte_length) AS size,
         sha256(string_agg(sha256, chr(10) ORDER BY position) || chr(10)) AS digest
  FROM sealed GROUP BY {keys}, path, chunk
),
buckets AS (
  SELECT {keys}, substr(sha256(path || '/' || (chunk // 4096)), 1, 3) AS bucket,
         sum(n) AS n, sum(size) AS size,
         sha256(string_agg(digest, chr(10) ORDER BY path, chunk) || chr(10)) AS digest
  FROM leaves GROUP BY {keys}, bucket
),
roots AS (
  SELECT {keys}, CAST(sum(n) AS BIGINT) AS events, CAST(sum(size) AS BIGINT) AS bytes,
         sha256(string_agg(digest, chr(10) ORDER BY bucket) || chr(10)) AS seal
  FROM buckets GROUP BY {keys}
)
"""


@query(
    "tick_rollup",
    f"""
WITH {EVENT_LOG_SQL},
sealed AS (SELECT *, file_path AS path, byte_offset AS position FROM ev),
{SEAL_SQL.format(keys="hostname, tick_index")},
sessions AS (
  SELECT hostname, tick_index, count(DISTINCT session_id) AS sessions,
         count(DISTINCT file_path) AS files FROM ev
  GROUP BY hostname, tick_index
)
SELECT * FROM roots JOIN sessions USING (hostname, tick_index)
""",
)
def events_per_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: events, bytes, files, sessions and seal per host and 10-minute tick."""
    return tick_rollup(event_log(spark, sf_dir), ["hostname", "tick_index"])


@query(
    "tick_seal",
    f"""
WITH {CONVERSATION_SQL},
sealed AS (
  SELECT *, conv_id % 10 AS endpoint, conv_id // 25 AS tick_index, conv_id AS path,
         part AS chunk, turn AS position
  FROM ranged
),
{SEAL_SQL.format(keys="endpoint, tick_index")}
SELECT * FROM roots
""",
)
def sealed_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = transcript(spark, sf_dir).select(
        (F.col("conv_id") % 10).alias("endpoint"),
        floor_div(F.col("conv_id"), 25).alias("tick_index"),
        "conv_id",
        "part",
        "turn",
        line_sha256(F.col("value")).alias("sha256"),
        F.octet_length("value").cast("bigint").alias("byte_length"),
    )
    return tick_seal(
        lines, ["endpoint", "tick_index"], path="conv_id", chunk="part", position="turn"
    )


LINE_COLUMNS_SQL = """
SELECT log, part, line_number, byte_offset, byte_end, byte_length, sha256 FROM ranged
"""


@query("scan_lines", f"WITH {LOG_SQL} {LINE_COLUMNS_SQL}")
def scanned_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts written as files, then scanned with byte ranges."""
    lines = scan_lines(spark, write_transcripts(spark, sf_dir), path_glob="*.txt")
    return lines.select(
        file_key("log"),
        file_key("part"),
        "line_number",
        "byte_offset",
        "byte_end",
        "byte_length",
        line_sha256(F.col("value")).alias("sha256"),
    )


def ranged_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript lines with the place they have in their file."""
    size = F.octet_length("value").cast("bigint")
    placed = with_prior(
        transcript(spark, sf_dir),
        keys=["conv_id"],
        chunk=["part"],
        order=["turn"],
        priors={
            "_lines": Prior("sum", F.lit(1).cast("bigint")),
            "_bytes": Prior("sum", size + 1),
        },
    )
    return placed.select(
        "conv_id",
        "part",
        "turn",
        (F.col("_lines") + 1).alias("line_number"),
        F.col("_bytes").alias("byte_offset"),
        (F.col("_bytes") + size + 1).alias("byte_end"),
        size.alias("byte_length"),
        line_sha256(F.col("value")).alias("sha256"),
    )


@query(
    "line_ranges",
    f"""
WITH {CONVERSATION_SQL}
SELECT conv_id, turn, line_number, byte_offset, byte_end, byte_length, sha256 FROM ranged
""",
)
def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranged_transcript(spark, sf_dir).drop("part")


@query(
    "resume_scan",
    f"""
WITH {LOG_SQL},
half AS (SELECT log, part, max(line_number) // 2 AS done FROM ranged GROUP BY log, part)
SELECT log, part, line_number, byte_offset, byte_end, byte_length, sha256
FROM ranged JOIN half USING (log, part) WHERE line_number > done
""",
)
def resumed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger holds the first half of each file; only the rest is read."""
    path = write_transcripts(spark, sf_dir)
    scanned = scan_lines(spark, path, path_glob="*.txt").withColumn(
        "sha256", line_sha256(F.col("value"))
    )
    half = scanned.groupBy("file_path").agg(
        F.expr("max(line_number) div 2").alias("done")
    )
    handled = scanned.join(half, "file_path").where("line_number <= done")
    ledger = commit_points(handled).select(
        "file_path",
        F.lit(None).cast("string").alias("file_id"),
        "byte_offset",
        "last_line_number",
        "last_sha256",
        F.lit(CAPTURED_NS).alias("last_flushed_ns"),
    )
    new = scan_new_lines(spark, path, latest_offsets(ledger), path_glob="*.txt")
    return new.select(
        file_key("log"),
        file_key("part"),
        "line_number",
        "byte_offset",
        "byte_end",
        "byte_length",
        line_sha256(F.col("value")).alias("sha256"),
    )


@query(
    "subtype_session",
    """
SELECT conv_id, turn, 'role:' || role AS subtype,
       '00000000-0000-4000-8000-' || lpad(CAST(conv_id AS VARCHAR), 12, '0') AS session_id,
       'project-' || (conv_id % 5) AS project_slug,
       CAST(1704067200000000000 + conv_id * 60000000000 + turn * 1000000000 AS BIGINT) AS ts_ns
FROM conversations
""",
)
def subtype_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session lines in the three spellings of the role and of the time."""
    when = F.date_format(
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")),
        "yyyy-MM-dd'T'HH:mm:ss'Z'",
    )
    kind = F.col("conv_id") % 3
    line = F.to_json(
        F.struct(
            F.when(kind == 0, when).alias("timestamp"),
            F.when(kind == 1, when).alias("ts"),
            F.when(kind == 2, when).alias("created_at"),
            F.when(kind == 0, F.col("role")).alias("role"),
            F.when(kind == 1, F.col("role")).alias("type"),
            F.when(kind == 2, F.struct("role")).alias("message"),
            F.col("text"),
        )
    )
    lines = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.format_string(
            "/home/agent/projects/project-%d/00000000-0000-4000-8000-%012d.jsonl",
            F.col("conv_id") % 5,
            F.col("conv_id"),
        ).alias("file_path"),
        (F.col("turn") + 1).alias("line_number"),
        F.lit(0).cast("bigint").alias("byte_offset"),
        F.lit(0).cast("bigint").alias("byte_end"),
        F.octet_length(line).cast("bigint").alias("byte_length"),
        line.alias("value"),
    )
    events = adapter_for("claude_code")(lines, CAPTURE)
    conv = F.regexp_extract("session_id", r"-0*(\d+)$", 1).cast("bigint")
    return events.select(
        conv.alias("conv_id"),
        (F.col("line_number") - 1).alias("turn"),
        "subtype",
        "session_id",
        "project_slug",
        "ts_ns",
    )


def _as_lines(df: DataFrame, path, value) -> DataFrame:
    """Table rows as raw lines of one file each host, keyed by their row id."""
    return df.select(
        path.alias("file_path"),
        F.col("event_id").alias("line_number"),
        (F.col("event_id") * 256).alias("byte_offset"),
        (F.col("event_id") * 256 + 256).alias("byte_end"),
        F.octet_length(value).cast("bigint").alias("byte_length"),
        value.alias("value"),
    )


@query(
    "rollout_parse",
    """
SELECT event_id AS row_id, epoch_us(ts) * 1000 AS ts_ns,
       CASE WHEN event_type = 'signup' THEN 'session_meta' ELSE event_type END AS subtype,
       CASE WHEN event_type = 'signup' THEN 'codex-tui/0.' || user_id END AS source_version,
       '00000000-0000-4000-8000-' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS session_id,
       'codex-cli' AS source, CAST(epoch_us(ts) // 600000000 AS BIGINT) AS tick_index
FROM events
""",
)
def rollout_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    meta = F.col("event_type") == "signup"
    value = F.to_json(
        F.struct(
            F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias(
                "timestamp"
            ),
            F.when(meta, "session_meta").otherwise(F.col("event_type")).alias("type"),
            F.struct(
                F.when(meta, F.concat(F.lit("0."), F.col("user_id"))).alias("cli_version"),
                F.col("props"),
            ).alias("payload"),
        )
    )
    path = F.format_string(
        "/home/agent/sessions/2024/rollout-x-00000000-0000-4000-8000-%012d.jsonl", F.col("user_id")
    )
    parsed = adapter_for("codex")(_as_lines(events, path, value), CAPTURE)
    return parsed.select(
        F.col("line_number").alias("row_id"),
        "ts_ns",
        "subtype",
        "source_version",
        "session_id",
        "source",
        "tick_index",
    )


@query(
    "history_parse",
    f"""
SELECT event_id AS row_id, CAST(user_id AS VARCHAR) AS session_id, 'history_entry' AS subtype,
       CAST(CASE WHEN event_id % 10 IN (0, 1) THEN {CAPTURED_NS}
            ELSE epoch_us(ts) // 1000000 * 1000000000 END AS BIGINT) AS ts_ns
FROM events
""",
)
def history_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts is a float on every tenth line and missing on the one after: capture time applies."""
    events = table(spark, sf_dir, "events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    slot = F.col("event_id") % 10
    ts = (
        F.when(slot == 0, F.concat(F.lit(',"ts":'), seconds, F.lit(".5")))
        .when(slot == 1, "")
        .otherwise(F.concat(F.lit(',"ts":'), seconds))
    )
    value = F.concat(
        F.lit('{"session_id":"'), F.col("user_id"), F.lit('"'), ts, F.lit(',"text":"x"}')
    )
    path = F.lit("/home/agent/history.jsonl")
    parsed = adapter_for("codex")(_as_lines(events, path, value), CAPTURE)
    return parsed.select(F.col("line_number").alias("row_id"), "session_id", "subtype", "ts_ns")


@query(
    "parse_payload",
    """
WITH broken AS (
  SELECT event_id AS row_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN substr(props, 2)
         WHEN 2 THEN '[' || props || ']' WHEN 3 THEN replace(props, '}', ',"note":"a\\"b"}')
         ELSE CAST(event_id AS VARCHAR) END AS line
  FROM events
),
judged AS (
  SELECT *, CASE WHEN json_valid(line) THEN json_type(line) = 'OBJECT' ELSE false END AS ok
  FROM broken
)
SELECT row_id, CASE WHEN ok THEN line
       ELSE CAST(to_json({'_parse_error': true, 'raw': line}) AS VARCHAR) END AS payload,
       NOT ok AS parse_error, sha256(line) AS sha256
FROM judged
""",
)
def parse_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.col("event_id") % 5
    props = F.col("props")
    value = (
        F.when(slot == 0, props)
        .when(slot == 1, F.expr("substring(props, 2)"))
        .when(slot == 2, F.concat(F.lit("["), props, F.lit("]")))
        .when(slot == 3, F.replace(props, F.lit("}"), F.lit(',"note":"a\\"b"}')))
        .otherwise(F.col("event_id").cast("string"))
    )
    path = F.concat(F.lit("/p/"), F.col("user_id"), F.lit(".jsonl"))
    parsed = adapter_for("claude_code")(
        _as_lines(table(spark, sf_dir, "events"), path, value), CAPTURE
    )
    return parsed.select(
        F.col("line_number").alias("row_id"),
        "payload",
        F.col("payload").startswith('{"_parse_error":true').alias("parse_error"),
        "sha256",
    )


@query(
    "parse_ts",
    f"""
SELECT event_id AS row_id, CAST(CASE event_id % 8
         WHEN 0 THEN epoch_us(ts) * 1000
         WHEN 1 THEN epoch_us(ts) * 1000 - 7200000000000
         WHEN 2 THEN epoch_us(ts) // 1000000 * 1000000000
         WHEN 3 THEN epoch_us(ts) // 86400000000 * 86400000000000
         WHEN 4 THEN epoch_us(ts) // 60000000 * 60000000000
         WHEN 5 THEN epoch_us(ts) // 1000000 * 1000000000
         ELSE {CAPTURED_NS} END AS BIGINT) AS ts_ns
FROM events
""",
)
def parse_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")

    def text(pattern: str):
        return F.date_format(ts, pattern)

    slot = F.col("event_id") % 8
    written = (
        F.when(slot == 0, F.concat(text("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
        .when(slot == 1, F.concat(text("yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+02:00")))
        .when(slot == 2, text("yyyy-MM-dd'T'HH:mm:ss"))
        .when(slot == 3, text("yyyy-MM-dd"))
        .when(slot == 4, F.concat(text("yyyy-MM-dd'T'HH:mm"), F.lit("Z")))
        .when(slot == 5, F.concat(text("yyyyMMdd'T'HHmmss"), F.lit("+0000")))
        .when(slot == 6, text("yyyy"))
        .otherwise(F.concat(F.lit("at "), text("yyyy-MM-dd'T'HH:mm:ss")))
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        F.coalesce(parse_ts_ns(written), F.lit(CAPTURED_NS)).alias("ts_ns"),
    )


WATCHES = [
    Watch("blogs", "claude_code", ("https://blog.*/en/*", "http://blog.*/en/*")),
    Watch("mobile", "codex", ("https://m.*", "http://m.*")),
    Watch("secure", "claude_code", ("https://*.jsonl",)),
]


@query(
    "watch_match",
    """
WITH watches(ord, watch, adapter, root) AS (VALUES
  (1, 'blogs', 'claude_code', 'https://blog.'), (1, 'blogs', 'claude_code', 'http://blog.'),
  (2, 'mobile', 'codex', 'https://m.'), (2, 'mobile', 'codex', 'http://m.'),
  (3, 'secure', 'claude_code', 'https://'))
SELECT page_id, url, arg_min(watch, ord) AS watch, arg_min(adapter, ord) AS adapter
FROM pages LEFT JOIN watches ON starts_with(url, root)
GROUP BY page_id, url
""",
)
def watch_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_watches(table(spark, sf_dir, "pages").select("page_id", "url"), WATCHES, "url")


@query(
    "exclude_paths",
    """
SELECT page_id, url FROM pages
WHERE NOT regexp_matches(url, '^https://.*/fr/.*$')
  AND NOT regexp_matches(url, '^.*[?]page=[0-4].*$')
  AND NOT regexp_matches(url, '^http://m[.].*$')
""",
)
def excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    globs = ("https://*/fr/**", "*[?]page=[0-4]*", "http://m.*")
    return exclude_paths(table(spark, sf_dir, "pages").select("page_id", "url"), globs, "url")


@query(
    "strip_payload",
    f"""
WITH {EVENT_LOG_SQL}
SELECT event_id, sha256, byte_offset, byte_end, line_number, CAST(NULL AS VARCHAR) AS payload,
       true AS payload_stripped
FROM ev
""",
)
def stripped_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_payload(event_log(spark, sf_dir)).select(
        "event_id", "sha256", "byte_offset", "byte_end", "line_number", "payload", "payload_stripped"
    )


# User rules of the redaction queries: e-mail addresses, 40-digit hashes, and words that only a reading
# as Python's finds: letters beyond ASCII in either case, a bracket in a class, a named group.
USER_PATTERNS = (
    r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    r"\b[0-9a-f]{40}\b",
    r"(?i)(?P<start>é)aux\w+[\[.,]",
)
PATTERNS = effective_patterns(USER_PATTERNS)
# The last rule as the SQL engine has to be told it.
SQL_PATTERNS = (*PATTERNS[:-1], r"(?i)éaux[\p{L}\p{N}_]+[\[.,]")


def _nested_replace(column: str) -> str:
    out = column
    for index, pattern in enumerate(SQL_PATTERNS):
        out = f"regexp_replace({out}, '{pattern}', '[REDACTED:{index}]', 'g')"
    return out


@query(
    "redact_payload",
    f"""
WITH body AS (
  SELECT doc_id, CAST(to_json({{'text': text, 'source': source}}) AS VARCHAR) AS payload
  FROM documents
),
done AS (SELECT doc_id, payload, {_nested_replace("payload")} AS redacted FROM body)
SELECT doc_id, CASE WHEN redacted = payload THEN payload
       WHEN NOT json_valid(redacted)
         THEN CAST(to_json({{'_redacted_text': redacted}}) AS VARCHAR)
       ELSE redacted END AS payload
FROM done
""",
)
def redacted_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.to_json(F.struct("text", "source")).alias("payload")
    )
    return redact_payload(docs, PATTERNS)


def _report_sql() -> str:
    parts, left = [], "text"
    for index, pattern in enumerate(SQL_PATTERNS):
        parts.append(
            f"SELECT source, {index} AS rule, "
            f"len(regexp_extract_all({left}, '{pattern}')) AS n FROM documents"
        )
        left = f"regexp_replace({left}, '{pattern}', '[REDACTED:{index}]', 'g')"
    union = " UNION ALL ".join(parts)
    return f"""
SELECT source, CAST(rule AS INTEGER) AS rule, CAST(sum(n) AS BIGINT) AS matches,
       count(*) AS rows, '[REDACTED:' || rule || ']' AS marker
FROM ({union}) WHERE n > 0 GROUP BY source, rule
"""


@query("redact_report", _report_sql())
def redact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "text")
    return redaction_report(docs, PATTERNS, "text", ["source"])


@query(
    "commit_points",
    f"""
WITH {CONVERSATION_SQL}
SELECT conv_id, max(byte_end) AS byte_offset, arg_max(line_number, byte_end) AS last_line_number,
       arg_max(sha256, byte_end) AS last_sha256
FROM ranged GROUP BY conv_id
""",
)
def transcript_commit_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit_points(ranged_transcript(spark, sf_dir), ["conv_id"])


@query(
    "row_cursor",
    """
SELECT event_id, user_id, event_type,
       (SELECT max(event_id) FROM events) AS next_cursor
FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)
""",
)
def row_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table source read from its saved row id on, and the cursor to save afterwards."""
    events = table(spark, sf_dir, "events")
    saved = events.agg(F.expr("max(event_id) div 2").alias("last_row_id")).select(
        F.lit("events.db").alias("db_path"),
        F.lit("events").alias("table_name"),
        "last_row_id",
        F.lit(CAPTURED_NS).alias("last_flushed_ns"),
    )
    new = rows_after(events, cursor_for(saved, "events.db"), "event_id")
    upcoming = next_cursor(new, "events.db", "events", "event_id", CAPTURED_NS)
    return new.select(
        "event_id",
        "user_id",
        "event_type",
        upcoming.select("last_row_id").scalar().alias("next_cursor"),
    )


# Every turn 3 was lost on the way and every turn 2 of an even conversation came twice.
DAMAGED_SQL = f"""
{CONVERSATION_SQL},
damaged AS (
  SELECT conv_id, turn, 0 AS copy, byte_offset, byte_end FROM ranged WHERE turn % 4 <> 3
  UNION ALL
  SELECT conv_id, turn, 1, byte_offset, byte_end FROM ranged WHERE turn % 4 = 2 AND conv_id % 2 = 0
),
measured AS (
  SELECT *, coalesce(max(byte_end) OVER w, 0) AS covered
  FROM damaged
  WINDOW w AS (PARTITION BY conv_id ORDER BY byte_offset, copy
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
gaps AS (
  SELECT conv_id, byte_end, CAST(greatest(byte_offset - covered, 0) AS BIGINT) AS gap_bytes,
         CAST(greatest(least(covered, byte_end) - byte_offset, 0) AS BIGINT) AS overlap_bytes
  FROM measured
)
"""


@query(
    "byte_coverage",
    f"""
WITH {DAMAGED_SQL}
SELECT conv_id, count(*) AS ranges, max(byte_end) AS covered_to,
       count(*) FILTER (WHERE gap_bytes > 0) AS gaps, CAST(sum(gap_bytes) AS BIGINT) AS gap_bytes,
       count(*) FILTER (WHERE overlap_bytes > 0) AS overlaps,
       CAST(sum(overlap_bytes) AS BIGINT) AS overlap_bytes,
       sum(gap_bytes) + sum(overlap_bytes) = 0 AS intact
FROM gaps GROUP BY conv_id
""",
)
def byte_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = ranged_transcript(spark, sf_dir).select(
        "conv_id", "part", "turn", "byte_offset", "byte_end"
    )
    copies = F.when(F.col("turn") % 4 == 3, F.array().cast("array<int>"))
    copies = copies.when(
        (F.col("turn") % 4 == 2) & (F.col("conv_id") % 2 == 0), F.array(F.lit(0), F.lit(1))
    ).otherwise(F.array(F.lit(0)))
    damaged = ranges.withColumn("copy", F.explode(copies))
    measured = coverage(damaged, path="conv_id", chunk=["part"], order=["byte_offset", "copy"])
    return coverage_report(measured, "conv_id")


@query(
    "sticky_session",
    """
WITH own AS (
  SELECT event_id AS row_id, user_id % 10 AS log, CASE WHEN event_id % 4 = 0
         THEN CAST(user_id AS VARCHAR) END AS session_id
  FROM events
)
SELECT row_id, log, session_id, first_value(session_id IGNORE NULLS) OVER (
         PARTITION BY log ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         AS first_session
FROM own
""",
)
def sticky_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One history log per host; only every fourth line names its session."""
    lines = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        (F.col("user_id") % 10).alias("log"),
        F.when(F.col("event_id") % 4 == 0, F.col("user_id").cast("string")).alias("session_id"),
        floor_div(F.col("event_id"), 65536).alias("chunk"),
    )
    return sticky_session(lines, path="log", chunk=["chunk"], order=["row_id"]).drop("chunk")


@query(
    "union_sources",
    f"""
WITH {EVENT_LOG_SQL}, {LOG_SQL},
hosts AS (SELECT hostname, max(ts_ns) AS at_ns FROM ev GROUP BY hostname)
SELECT event_id, 'tool_event' AS event_type, subtype, hostname, tick_index, line_number,
       sha256, CAST(NULL AS VARCHAR) AS project_slug FROM ev
UNION ALL
SELECT sha256('transcripts|fleet|/t/' || log || '/' || part || '.jsonl|' || byte_offset
              || '|' || sha256),
       'tool_event', 'role:' || split_part(value, ':', 1), 'fleet', {CAPTURED_NS} // 600000000000,
       line_number, sha256, 'project-' || (conv_id % 5) FROM ranged
UNION ALL
SELECT sha256('heartbeat|' || hostname || '|' || at_ns), 'heartbeat', 'periodic', hostname,
       at_ns // 600000000000, 0, repeat('0', 64), NULL FROM hosts
""",
)
def united_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, transcripts and heartbeats in one table."""
    events = event_log(spark, sf_dir)
    size = F.octet_length("value").cast("bigint")
    # The size of a log file has a bound, so a plain window over it will do.
    earlier = (
        Window.partitionBy("log", "part")
        .orderBy("conv_id", "turn")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = transcript(spark, sf_dir).select(
        "*",
        (F.count("*").over(earlier) + 1).alias("line_number"),
        F.coalesce(F.sum(size + 1).over(earlier), F.lit(0).cast("bigint")).alias("byte_offset"),
    )
    lines = placed.select(
        "conv_id",
        "value",
        F.concat(
            F.lit("/t/"), F.col("log"), F.lit("/"), F.col("part"), F.lit(".jsonl")
        ).alias("file_path"),
        "line_number",
        "byte_offset",
        (F.col("byte_offset") + size + 1).alias("byte_end"),
        size.alias("byte_length"),
    )
    transcripts = to_canonical(
        lines,
        CAPTURE,
        source="transcripts",
        event_ns=F.lit(CAPTURED_NS),
        payload=F.col("value"),
        subtype=F.concat(F.lit("role:"), F.substring_index("value", ":", 1)),
        project_slug=F.concat(F.lit("project-"), F.col("conv_id") % 5),
    )
    hosts = events.groupBy("hostname", "os_user").agg(F.max("ts_ns").alias("at_ns"))
    beats = heartbeats(hosts, F.col("at_ns"), "periodic")
    return union_sources(events, transcripts, beats).select(
        "event_id",
        "event_type",
        "subtype",
        "hostname",
        "tick_index",
        "line_number",
        "sha256",
        "project_slug",
    )

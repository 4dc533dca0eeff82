"""Table schemas and the fixed values that every host and every job agree on."""

from __future__ import annotations

# Fixed values of the event contract.
EVENT_SCHEMA_VERSION = "1.0"
HASH_ALGORITHM = "sha256"
TOOL_EVENT = "tool_event"
HEARTBEAT = "heartbeat"
ALLOWED_EVENT_TYPES = (TOOL_EVENT, HEARTBEAT)
HEARTBEAT_PATH = "<heartbeat>"
HEARTBEAT_SHA256 = "0" * 64
GENESIS = "genesis"
TICK_SECONDS = 600
RETENTION_DAYS = 7
MAX_EVENTS_PER_BATCH = 1000
MAX_BYTES_PER_BATCH = 5 * 1024 * 1024
LOADED_EVENTS = 200
LOADED_BYTES = 1024 * 1024
MAX_ATTEMPTS = 6
ACTIVE_SECONDS = 300
RECENT_EVENTS_CAP = 100
DAILY_QUOTA = 10_000

CAPTURED_BY = "evidence-lake"
CAPTURE_VERSION = "0.1.0"

# Ordered text is cut into chunks of this many file bytes wherever a file could be too
# large for one task; see operators/ordered.py.
CHUNK_BYTES = 16 * 1024 * 1024



EVENT_DDL = """
event_schema_version STRING, event_type STRING, event_id STRING, subtype STRING,
tick_index BIGINT, captured_at_ns BIGINT, captured_by STRING, capture_version STRING,
hostname STRING, os_user STRING, source STRING, source_version STRING, session_id STRING,
file_path STRING, line_number BIGINT, byte_offset BIGINT, byte_end BIGINT, byte_length BIGINT,
hash_algorithm STRING, sha256 STRING, ts_ns BIGINT, payload STRING,
project_slug STRING, payload_stripped BOOLEAN, ts TIMESTAMP, endpoint_id STRING, tenant STRING
"""

EVENT_COLUMNS = [field.split()[0] for field in EVENT_DDL.replace("\n", " ").split(",")]

LEDGER_DDL = """
file_path STRING, file_id STRING, byte_offset BIGINT, last_line_number BIGINT,
last_sha256 STRING, last_flushed_ns BIGINT, generation BIGINT
"""

CURSOR_DDL = "db_path STRING, table_name STRING, last_row_id BIGINT, last_flushed_ns BIGINT"

DEAD_LETTER_DDL = "parked_ns BIGINT, batch_id STRING, reason STRING, body STRING"

DEAD_LETTER_STATUS_DDL = "batch_id STRING, status STRING, at_ns BIGINT"

AUDIT_DDL = "log_id STRING, pos BIGINT, line STRING"

# Audit record kinds (fixed values).
AUDIT_KINDS = (
    "startup",
    "shutdown",
    "batch_shipped",
    "batch_retry",
    "batch_rejected",
    "batch_client_error",
    "batch_dead_lettered",
    "key_revoked_or_unauthorized",
    "daemon_paused_revoked_key",
    "flush_failed",
    "dead_letter_loaded_for_replay",
    "dead_letter_replay_error",
    "dead_letter_reshipped",
    "dead_letter_reship_failed",
    "dead_letter_archive_failed",
    "file_rotated",
)

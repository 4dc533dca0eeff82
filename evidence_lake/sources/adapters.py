"""Session sources: raw lines to canonical events, one function per log format."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonl
from ..functions.globs import normalise_path
from ..functions.hashing import event_key, line_sha256
from ..functions.ticks import tick_index
from ..functions.timestamps import parse_ts_ns
from ..schema import (
    CAPTURE_VERSION,
    CAPTURED_BY,
    EVENT_SCHEMA_VERSION,
    HASH_ALGORITHM,
    TICK_SECONDS,
    TOOL_EVENT,
)

# Patterns of the log formats (fixed values).
UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
ROLLOUT_FILE = rf"(?i)rollout-.+-({UUID})\.jsonl$"
SESSION_SOURCE = "claude-code"
ROLLOUT_SOURCE = "codex-cli"
ROLLOUT_VERSION_PREFIX = "codex-tui/"


@dataclass(frozen=True)
class Capture:
    """Who captured, where and when; one value per run."""

    hostname: str = "unknown"
    os_user: str = "unknown"
    captured_at_ns: int = field(default_factory=time.time_ns)
    captured_by: str = CAPTURED_BY
    capture_version: str = CAPTURE_VERSION
    tick_seconds: int = TICK_SECONDS


def to_canonical(
    lines: DataFrame,
    capture: Capture,
    *,
    source: str,
    event_ns: Column,
    payload: Column,
    subtype: Column | None = None,
    session_id: Column | None = None,
    source_version: Column | None = None,
    project_slug: Column | None = None,
    hostname: Column | None = None,
    captured_at_ns: Column | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """The canonical event of each line: fixed envelope, place in the file, hash, payload.

    Expects file_path, line_number, byte_offset, byte_end, byte_length and value (the raw
    line). Each part is named before the next uses it, so nothing is computed twice. Lines that name
    their host in a column `hostname` are of that host.
    """
    none = F.lit(None).cast("string")
    own = F.col("hostname") if "hostname" in lines.columns else F.lit(capture.hostname)
    host = own if hostname is None else hostname
    captured = F.lit(capture.captured_at_ns).cast("bigint")
    extra = extra or {}
    generation = F.col("generation") if "generation" in lines.columns else None
    if generation is not None:
        extra = {**extra, "generation": generation}
    base = lines.select(
        F.lit(EVENT_SCHEMA_VERSION).alias("event_schema_version"),
        F.lit(TOOL_EVENT).alias("event_type"),
        (none if subtype is None else subtype).alias("subtype"),
        (captured if captured_at_ns is None else captured_at_ns).alias("captured_at_ns"),
        F.lit(capture.captured_by).alias("captured_by"),
        F.lit(capture.capture_version).alias("capture_version"),
        host.alias("hostname"),
        F.lit(capture.os_user).alias("os_user"),
        F.lit(source).alias("source"),
        (none if source_version is None else source_version).alias("source_version"),
        (none if session_id is None else session_id).alias("session_id"),
        normalise_path(F.col("file_path")).alias("file_path"),
        "line_number",
        "byte_offset",
        "byte_end",
        "byte_length",
        F.lit(HASH_ALGORITHM).alias("hash_algorithm"),
        line_sha256(F.col("value")).alias("sha256"),
        event_ns.alias("ts_ns"),
        payload.alias("payload"),
        (none if project_slug is None else project_slug).alias("project_slug"),
        F.lit(None).cast("boolean").alias("payload_stripped"),
        *[value.alias(name) for name, value in extra.items()],
    )
    added = base.withColumns(
        {
            "event_id": event_key(
                F.col("source"),
                F.col("hostname"),
                F.col("file_path"),
                F.col("byte_offset"),
                F.col("sha256"),
                generation,
            ),
            "tick_index": tick_index(F.col("ts_ns"), capture.tick_seconds),
            "ts": F.timestamp_micros(F.expr("ts_ns div 1000")),
        }
    )
    return added.select(
        "event_schema_version",
        "event_type",
        "event_id",
        "subtype",
        "tick_index",
        *[c for c in base.columns if c not in ("event_schema_version", "event_type", "subtype")],
        "ts",
    )


def _parsed(lines: DataFrame) -> DataFrame:
    """Lines with their document, if it may be an object: to find out that a text is none is dearer than to read one."""
    document = F.when(jsonl.opens_object(F.col("value")), F.try_parse_json(F.make_valid_utf8("value")))
    parsed = lines.withColumn("doc", document)
    return parsed.withColumn("readable", jsonl.is_json_object(F.col("value"), F.col("doc")))


def _file_name() -> Column:
    return F.substring_index(normalise_path(F.col("file_path")), "/", -1)


def parse_session(lines: DataFrame, capture: Capture) -> DataFrame:
    """Per-session files in a project folder: `<slug>/<session uuid>.jsonl`.

    Time comes from the first present of timestamp, ts and created_at, the subtype from role,
    type or message.role. A line whose message is no object counts as unreadable, but keeps
    the time already found.
    """
    doc, readable = F.col("doc"), F.col("readable")
    read = _parsed(lines)
    fields = read.withColumns(
        {
            "when": F.when(
                readable,
                F.coalesce(
                    jsonl.time_text(doc, "$.timestamp"),
                    jsonl.time_text(doc, "$.ts"),
                    jsonl.time_text(doc, "$.created_at"),
                ),
            ),
            "role": F.when(
                readable,
                F.coalesce(jsonl.present_text(doc, "$.role"), jsonl.present_text(doc, "$.type")),
            ),
        }
    )
    # Only a line without a role of its own is asked for its message.
    odd = F.col("role").isNull() & jsonl.odd_container(doc, "$.message")
    fields = fields.withColumn("ok", readable & ~odd)
    role = F.coalesce("role", jsonl.present_text(doc, "$.message.role"))
    path = normalise_path(F.col("file_path"))
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    stem = F.regexp_replace(_file_name(), r"(?<=.)\.[^.]*$", "")
    uuid = F.regexp_extract(stem, f"(?i)({UUID})", 1)
    return to_canonical(
        fields,
        capture,
        source=SESSION_SOURCE,
        event_ns=F.coalesce(
            parse_ts_ns(F.col("when")), F.lit(capture.captured_at_ns).cast("bigint")
        ),
        payload=F.when(F.col("ok"), F.col("value")).otherwise(
            jsonl.parse_error_payload(F.col("value"))
        ),
        subtype=F.when(F.col("ok"), F.concat(F.lit("role:"), role)),
        session_id=F.nullif(uuid, F.lit("")),
        project_slug=F.when(path.contains("/"), folder).otherwise(""),
    )


def parse_rollout_or_history(
    lines: DataFrame, capture: Capture, is_rollout: Column | None = None
) -> DataFrame:
    """Two formats of one tool, told apart by the file name and read in one pass.

    Rollout files hold `{"timestamp", "type", "payload"}` lines and the session id in their
    name; a session_meta line carries the tool version, other lines have none. History files
    hold `{"session_id", "ts", "text"}` lines with ts in whole seconds; any other kind of ts
    falls back to the capture time, and each line keeps its own session.
    """
    doc, rollout = F.col("doc"), F.col("rollout")
    named = lines.withColumn("named", F.regexp_extract(_file_name(), ROLLOUT_FILE, 1))
    chosen = F.col("named") != "" if is_rollout is None else is_rollout
    read = _parsed(named.withColumn("rollout", chosen))
    in_rollout = F.col("readable") & rollout
    in_history = F.col("readable") & ~rollout
    fields = read.withColumns(
        {
            "when": F.when(in_rollout, jsonl.time_text(doc, "$.timestamp")),
            "kind": F.when(in_rollout, jsonl.text_at(doc, "$.type")),
            "seconds": F.when(
                in_history & jsonl.is_integer_at(doc, "$.ts"),
                F.try_variant_get(doc, "$.ts", "bigint"),
            ),
        }
    )
    meta = F.coalesce(F.col("kind") == "session_meta", F.lit(False))
    ok = F.col("readable") & ~(meta & jsonl.odd_container(doc, "$.payload"))
    fields = fields.withColumn("ok", ok)
    version = F.when(meta & F.col("ok"), jsonl.present_text(doc, "$.payload.cli_version"))
    ns = F.when(rollout, parse_ts_ns(F.col("when"))).otherwise(
        F.try_multiply(F.col("seconds"), F.lit(1_000_000_000).cast("bigint"))
    )
    return to_canonical(
        fields,
        capture,
        source=ROLLOUT_SOURCE,
        event_ns=F.coalesce(ns, F.lit(capture.captured_at_ns).cast("bigint")),
        payload=F.when(F.col("ok"), F.col("value")).otherwise(
            jsonl.parse_error_payload(F.col("value"))
        ),
        subtype=F.when(rollout, F.col("kind")).when(F.col("readable"), "history_entry"),
        source_version=F.concat(F.lit(ROLLOUT_VERSION_PREFIX), version),
        session_id=F.when(rollout, F.nullif(F.col("named"), F.lit(""))).when(
            F.col("readable"), jsonl.present_text(doc, "$.session_id")
        ),
    )


def parse_rollout(lines: DataFrame, capture: Capture) -> DataFrame:
    return parse_rollout_or_history(lines, capture, F.lit(True))


def parse_history(lines: DataFrame, capture: Capture) -> DataFrame:
    return parse_rollout_or_history(lines, capture, F.lit(False))


Adapter = Callable[[DataFrame, Capture], DataFrame]
_ADAPTERS: dict[str, Adapter] = {}


def register_adapter(name: str, adapter: Adapter) -> None:
    """Add a log format: a function from raw lines to canonical events."""
    _ADAPTERS[name] = adapter


def adapter_for(name: str) -> Adapter:
    try:
        return _ADAPTERS[name]
    except KeyError:
        raise KeyError(f"no adapter {name!r}; known: {', '.join(sorted(_ADAPTERS))}") from None


register_adapter("claude_code", parse_session)
register_adapter("codex", parse_rollout_or_history)


def union_sources(*parts: DataFrame) -> DataFrame:
    """All sources in one event table; a column only one source has is null elsewhere."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out

"""Log formats: fixture lines and what each must become."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evidence_lake.operators.reports import heartbeats
from evidence_lake.operators.watches import Watch, match_watches, resolve_watches
from evidence_lake.schema import EVENT_COLUMNS
from evidence_lake.sources.adapters import (
    Capture,
    adapter_for,
    register_adapter,
    to_canonical,
    union_sources,
)
from evidence_lake.sources.lines import scan_lines

CAPTURED = 1_700_000_000_000_000_000
CAPTURE = Capture(hostname="h1", os_user="u1", captured_at_ns=CAPTURED)
UUID = "123E4567-e89b-42d3-a456-426614174000"
NOON = 1_714_564_800_000_000_000  # 2024-05-01T12:00:00Z


def scan(spark, path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"".join(line + b"\n" for line in lines))
    return scan_lines(spark, str(path))


def by_line(events):
    return {r.line_number: r for r in events.collect()}


SESSION = {
    b'{"timestamp":"2024-05-01T12:00:00Z","role":"user"}': ("role:user", NOON, True),
    b'{"ts":"2024-05-01T14:00:00+02:00","type":"assistant"}': ("role:assistant", NOON, True),
    b'{"created_at":"2024-05-01 12:00:00","message":{"role":"tool"}}': ("role:tool", NOON, True),
    b'{"timestamp":"","ts":"2024-05-01T12:00:00Z","role":"","type":"x"}': ("role:x", NOON, True),
    b'{"timestamp":5,"ts":"2024-05-01T12:00:00Z","role":"u"}': ("role:u", CAPTURED, True),
    b'{"timestamp":"soon","role":"u"}': ("role:u", CAPTURED, True),
    b'{"n":1}': (None, CAPTURED, True),
    b'{"a":1,"a":2,"role":"u"}': ("role:u", CAPTURED, True),
    b'{"timestamp":"2024-05-01T12:00:00Z","message":"s"}': (None, NOON, False),
    b'{"message":null}': (None, CAPTURED, False),
    b'{"role":"u","message":"s"}': ("role:u", CAPTURED, True),
    b'  {"role":7}': ("role:7", CAPTURED, True),
    b"not json": (None, CAPTURED, False),
    b"[1]": (None, CAPTURED, False),
    b"5": (None, CAPTURED, False),
    b'"text"': (None, CAPTURED, False),
    b'{"role":"cut': (None, CAPTURED, False),
    b'{"role":"b\xff"}': (None, CAPTURED, False),
    '{"role":"é漢"}'.encode(): ("role:é漢", CAPTURED, True),
}


def test_session_lines(spark, tmp_path):
    path = tmp_path / "my-slug" / f"{UUID}.jsonl"
    events = by_line(adapter_for("claude_code")(scan(spark, path, list(SESSION)), CAPTURE))
    assert len(events) == len(SESSION)
    for number, (line, (subtype, ns, readable)) in enumerate(SESSION.items(), 1):
        row = events[number]
        assert (row.subtype, row.ts_ns) == (subtype, ns), line
        assert row.sha256 == hashlib.sha256(line).hexdigest()
        assert row.byte_length == len(line)
        if readable:
            assert row.payload == line.decode()
        else:
            assert json.loads(row.payload) == {
                "_parse_error": True,
                "raw": line.decode("utf-8", errors="replace"),
            }
        assert row.session_id == UUID
        assert row.project_slug == "my-slug"
        assert row.tick_index == ns // (600 * 10**9)
        assert (row.source, row.hostname, row.os_user) == ("claude-code", "h1", "u1")
        assert row.source_version is None and row.captured_at_ns == CAPTURED


def test_file_without_uuid_has_no_session(spark, tmp_path):
    lines = scan(spark, tmp_path / "p" / "notes.jsonl", [b"{}"])
    assert by_line(adapter_for("claude_code")(lines, CAPTURE))[1].session_id is None


def test_event_ids_are_stable_and_unique(spark, tmp_path):
    lines = scan(spark, tmp_path / "p" / "x.jsonl", [b"{}", b"{}", b"{}"])
    first = by_line(adapter_for("claude_code")(lines, CAPTURE))
    later = by_line(adapter_for("claude_code")(lines, Capture(hostname="h1", captured_at_ns=1)))
    assert {n: r.event_id for n, r in first.items()} == {n: r.event_id for n, r in later.items()}
    assert len({r.event_id for r in first.values()}) == 3


def test_rollout_lines(spark, tmp_path):
    lines = [
        b'{"timestamp":"2024-05-01T12:00:00Z","type":"session_meta","payload":{"cli_version":"0.9","id":"i"}}',
        b'{"timestamp":"2024-05-01T12:00:00.5Z","type":"event_msg","payload":{"cli_version":"9"}}',
        b'{"type":"session_meta","payload":{}}',
        b'{"type":"session_meta","payload":"s"}',
        b'{"type":"session_meta"}',
        b'{"payload":"s"}',
        b"oops",
    ]
    path = tmp_path / "2024" / f"rollout-2024-05-01-{UUID}.jsonl"
    got = by_line(adapter_for("codex")(scan(spark, path, lines), CAPTURE))
    assert [got[i].source_version for i in range(1, 8)] == ["codex-tui/0.9"] + [None] * 6
    assert [got[i].subtype for i in range(1, 8)] == [
        "session_meta", "event_msg", "session_meta", "session_meta", "session_meta", None, None,
    ]
    assert [got[i].ts_ns for i in (1, 2, 3)] == [NOON, NOON + 500_000_000, CAPTURED]
    wrapped = [i for i in got if got[i].payload.startswith('{"_parse_error":true')]
    assert wrapped == [4, 7] or sorted(wrapped) == [4, 7]
    assert {r.session_id for r in got.values()} == {UUID}
    assert {r.source for r in got.values()} == {"codex-cli"}


def test_history_lines(spark, tmp_path):
    lines = [
        b'{"session_id":"a","ts":1714564800,"text":"x"}',
        b'{"session_id":"b","ts":1714564800.0,"text":"x"}',
        b'{"session_id":"a","text":"x"}',
        b'{"session_id":"b","ts":"1714564800"}',
        b'{"ts":-5}',
        b'{"ts":99999999999999}',
        b"[]",
    ]
    got = by_line(adapter_for("codex")(scan(spark, tmp_path / "history.jsonl", lines), CAPTURE))
    assert [got[i].session_id for i in range(1, 8)] == ["a", "b", "a", "b", None, None, None]
    assert [got[i].ts_ns for i in range(1, 8)] == [
        NOON, CAPTURED, CAPTURED, CAPTURED, -5_000_000_000, CAPTURED, CAPTURED,
    ]
    assert got[5].tick_index == -1
    assert [got[i].subtype for i in (1, 7)] == ["history_entry", None]


def test_register_adapter_and_union(spark, tmp_path):
    def plain(lines, capture):
        return to_canonical(
            lines,
            capture,
            source="plain",
            event_ns=F.lit(capture.captured_at_ns),
            payload=F.to_json(F.struct("value")),
        )

    register_adapter("plain", plain)
    with pytest.raises(KeyError, match="plain"):
        adapter_for("nope")
    lines = scan(spark, tmp_path / "p.log", [b"hello"])
    hosts = spark.createDataFrame([("h1", "u1", CAPTURED)], "hostname STRING, os_user STRING, at BIGINT")
    beats = heartbeats(hosts, F.col("at"), "startup")
    both = union_sources(adapter_for("plain")(lines, CAPTURE), beats)
    kinds = {r.event_type: r for r in both.collect()}
    assert set(kinds) == {"tool_event", "heartbeat"}
    beat = kinds["heartbeat"]
    assert (beat.file_path, beat.sha256, beat.line_number, beat.subtype) == (
        "<heartbeat>", "0" * 64, 0, "startup",
    )
    assert beat.tick_index == CAPTURED // (600 * 10**9)
    assert set(both.columns) == set(EVENT_COLUMNS) - {"endpoint_id", "tenant"}


def test_watches(spark):
    watches = [
        Watch("a", "claude_code", ("/data/projects/*/*.jsonl",)),
        Watch("b", "codex", ("/data/**/*.jsonl", "/other/x-?.jsonl")),
    ]
    paths = ["/data/projects/p/1.jsonl", "/data/z/2.jsonl", "/data/z/2.txt", "/other/x-1.jsonl", "/none"]
    df = spark.createDataFrame([(p,) for p in paths], "file_path STRING")
    tagged = {r.file_path: (r.watch, r.adapter) for r in match_watches(df, watches).collect()}
    assert tagged == {
        paths[0]: ("a", "claude_code"),
        paths[1]: ("b", "codex"),
        paths[2]: ("b", "codex"),
        paths[3]: (None, None),
        paths[4]: (None, None),
    }
    resolved = {r.file_path: r.watch for r in resolve_watches(df, watches).collect()}
    assert resolved == {paths[0]: "a", paths[1]: "b", paths[3]: "b"}

"""Decisions, dead letters, ledgers and reports on small fixtures."""

import json

from pyspark.sql import functions as F

from evidence_lake.operators import delivery, reports
from evidence_lake.operators.packing import load_state
from evidence_lake.schema import CURSOR_DDL, DEAD_LETTER_DDL, LEDGER_DDL
from evidence_lake.sources.ledger import (
    cursor_for,
    latest_offsets,
    next_cursor,
    read_ledger,
    rows_after,
)


def test_classify_response(spark):
    cases = [
        (200, 0, False, "delivered"), (299, 5, True, "delivered"),
        (429, 0, False, "retry"), (500, 4, False, "retry"), (599, 5, False, "parked_exhausted"),
        (503, 5, True, "kept_parked"), (None, 2, False, "retry"), (None, 5, False, "parked_exhausted"),
        (401, 0, False, "auth_fatal"), (403, 5, True, "auth_fatal"),
        (422, 0, False, "parked_rejected"), (404, 0, True, "kept_parked"), (302, 0, False, "parked_rejected"),
    ]
    df = spark.createDataFrame(cases, "status INT, attempt INT, replayed BOOLEAN, want STRING")
    got = df.select(
        "want",
        delivery.classify_response(F.col("status"), F.col("attempt"), F.col("replayed")).alias("got"),
    )
    assert all(r.want == r.got for r in got.collect())


def test_outcomes_and_reasons(spark):
    attempts = (
        [("a", 0, 500), ("a", 1, 200)]
        + [("b", i, 429) for i in range(6)]
        + [("c", 0, None), ("c", 1, 422), ("d", 0, 503)]
    )
    df = spark.createDataFrame(attempts, "batch_id STRING, attempt INT, status INT")
    got = {r.batch_id: tuple(r)[1:] for r in delivery.delivery_outcomes(df).collect()}
    assert got == {
        "a": (2, 1, 200, "delivered", None),
        "b": (6, 5, 429, "parked_exhausted", "retries_exhausted"),
        "c": (2, 1, 422, "parked_rejected", "http_422"),
        "d": (1, 1, 503, "retry", None),
    }


def test_commit_points_take_the_furthest_and_skip_heartbeats(spark):
    rows = [
        ("/a", 10, 1, "x", "tool_event"), ("/a", 30, 3, "z", "tool_event"),
        ("/a", 20, 2, "y", "tool_event"), ("<heartbeat>", 0, 0, "0", "heartbeat"),
    ]
    df = spark.createDataFrame(
        rows, "file_path STRING, byte_end BIGINT, line_number BIGINT, sha256 STRING, event_type STRING"
    )
    assert [tuple(r) for r in delivery.commit_points(df).collect()] == [("/a", 30, 3, "z")]


def test_ledger_newest_wins_and_old_rows_read_as_line_zero(spark, tmp_path):
    path = str(tmp_path / "ledger")
    old = "file_path STRING, file_id STRING, byte_offset BIGINT, last_sha256 STRING, last_flushed_ns BIGINT"
    spark.createDataFrame([("C:\\old.jsonl", None, 12345, "s", 1)], old).write.parquet(path)
    rows = [("/a", None, 10, 1, "x", 5, None), ("/a", None, 7, 9, "y", 6, 0), ("/a", None, 8, 2, "z", 6, 0)]
    spark.createDataFrame(rows, LEDGER_DDL).write.mode("append").parquet(path)
    got = {r.file_path: (r.byte_offset, r.last_line_number) for r in latest_offsets(read_ledger(spark, path)).collect()}
    assert got == {"C:/old.jsonl": (12345, 0), "/a": (8, 2)}
    target = str(tmp_path / "compact")
    delivery.compact_offsets(spark, path, target)
    assert delivery.read_offsets(spark, target).count() == 2


def test_row_cursor(spark):
    cursors = spark.createDataFrame([("/d.db", "t", 3, 1), ("/d.db", "t", 5, 2)], CURSOR_DDL)
    assert (cursor_for(cursors, "\\d.db"), cursor_for(cursors, "/new")) == (5, 0)
    df = spark.range(9)
    new = rows_after(df, 5, "id")
    assert [r.id for r in new.collect()] == [6, 7, 8]
    assert next_cursor(new, "/d.db", "t", "id", 7).first().last_row_id == 8
    assert next_cursor(rows_after(df, 8, "id"), "/d.db", "t", "id", 7).count() == 0


def test_dead_letter_files(spark, tmp_path):
    folder = tmp_path / "dl"
    (folder / "replayed").mkdir(parents=True)
    body = {"batch_id": "b1", "events": [{"event_id": "e"}, {"event_id": "f"}]}
    (folder / "200_b1.json").write_text(json.dumps({"reason": "retries_exhausted", "body": body}))
    (folder / "100_b2.json").write_text(
        json.dumps({"reason": "http_422", "body": {"batch_id": "b2", "events": []}})
    )
    (folder / "300_b3.json").write_text(json.dumps({"reason": "x", "body": {"batch_id": "b3"}}))
    (folder / "301_b4.json").write_text(json.dumps({"reason": "x", "body": {"events": []}}))
    (folder / "302_b5.json").write_text(json.dumps({"reason": "x", "body": {"batch_id": "b5", "events": 3}}))
    (folder / "303_b6.json").write_text("not json")
    (folder / "replayed" / "50_b0.json").write_text(json.dumps({"reason": "x", "body": body}))
    good, bad = delivery.split_valid(delivery.read_dead_letter_files(spark, str(folder)))
    assert [(r.parked_ns, r.batch_id, r.events) for r in delivery.replay_order(good).collect()] == [
        (100, "b2", 0), (200, "b1", 2),
    ]
    assert sorted(r.parked_ns for r in bad.collect()) == [300, 301, 302, 303]
    totals = delivery.dead_letter_totals(good).first()
    assert (totals.letters, totals.events) == (2, 2)
    statuses = spark.createDataFrame([("b1", "replayed", 1)], "batch_id STRING, status STRING, at_ns BIGINT")
    assert [r.batch_id for r in delivery.waiting(good, statuses).collect()] == ["b2"]


def test_missing_tables_read_as_empty(spark, tmp_path):
    empty = delivery.read_table(spark, str(tmp_path / "none"), DEAD_LETTER_DDL)
    assert empty.columns == ["parked_ns", "batch_id", "reason", "body"] and empty.isEmpty()


def test_load_state(spark):
    rows = [(1, 1, "idle"), (200, 1, "loaded"), (5, 1 << 20, "loaded"), (1000, 1, "flush"), (1, 5 << 20, "flush")]
    df = spark.createDataFrame(rows, "events BIGINT, bytes BIGINT, want STRING")
    assert all(r.want == r.load_state for r in load_state(df).collect())


NS = 1_000_000_000


def report_events(spark):
    now = 100_000 * NS
    rows = [
        ("demo", "h1", "", now, "e1"), ("demo", "h1", "", now - 10 * NS, "e2"),
        ("demo", "h2", "ep", now - 299 * NS, "e3"), ("demo", "h3", None, now - 300 * NS, "e4"),
        ("demo", "h4", "", now - 3600 * NS, "e5"), ("prod", "h9", "x", now + 5 * NS, "e6"),
        ("prod", "h9", "y", now, "e7"),
    ]
    return spark.createDataFrame(
        rows, "tenant STRING, hostname STRING, endpoint_id STRING, ts_ns BIGINT, event_id STRING"
    ).withColumn("event_type", F.lit("tool_event"))


def test_reports(spark):
    events = report_events(spark)
    status = reports.tenant_status(events, "demo", F.lit(100_000 * NS)).first()
    assert (status.tenant, status.endpoints_active, status.events_last_hour) == ("demo", 2, 4)
    nobody = reports.tenant_status(events, "none", F.lit(1)).first()
    assert (nobody.endpoints_active, nobody.events_last_hour) == (0, 0)
    listed = {r.endpoint_id: r.events_total for r in reports.endpoint_list(events, "demo").collect()}
    assert listed == {"h1": 2, "ep": 1, "h3": 1, "h4": 1}
    recent = reports.recent_events(events, "demo", 2)
    assert recent.columns == ["ts_ns", "source_id", "endpoint_name", "event_type"]
    assert [r.source_id for r in recent.collect()] == ["h1", "h1"]
    assert reports.recent_events(events, "demo", -1).count() == 0
    assert [tuple(r) for r in reports.identity_collisions(events).collect()] == [("h9", 2)]
    quota = {(r.tenant, r.day): r.over_by for r in reports.over_quota(events, 4).collect()}
    assert quota[("demo", 1)] == 1 and quota[("prod", 1)] == 0

"""What a micro-batch does with its lines: numbers, sizes and documents, each at its price."""

from pyspark.sql import functions as F

from evidence_lake.operators.packing import event_size
from evidence_lake.operators.privacy import Privacy
from evidence_lake.sources.adapters import Capture, parse_session
from evidence_lake.sources.tail import TAIL_DDL
from evidence_lake.streaming import forward as forward_module
from evidence_lake.streaming.forward import ENVELOPE_FIELDS, Forwarder, forward, numbered

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_opening_ranges_are_numbered_without_a_join(spark):
    # Path, generation, lines of each range; b goes on behind 7 lines, c has begun anew.
    files = [("a", 0, {0: 3, 64: 2, 128: 4}), ("b", 0, {90: 2, 154: 1}), ("c", 1, {0: 5}), ("d", 0, {0: 1, 64: 1})]
    rows, want = [], []
    for path, generation, ranges in files:
        number = 7 if path == "b" else 0
        for start, n in sorted(ranges.items()):
            for i in range(1, n + 1):
                number += 1
                rows.append((path, start, i, start + i, start + i + 1, b"x\n", generation, None))
                want.append((path, generation, start + i, number))
    lines = spark.createDataFrame(rows, TAIL_DDL)
    known = [("b", 0, 7), ("c", 0, 9)]
    ledger = spark.createDataFrame(known, "file_path STRING, generation BIGINT, last_line_number BIGINT")
    got = numbered(lines, ledger)
    read = got.select("file_path", "generation", "byte_offset", "line_number").collect()
    assert sorted(map(tuple, read)) == sorted(want)
    plan = plan_of(got)
    assert plan.startswith("Union") and "(range_start#" in plan and " > 0)" in plan


def test_events_are_written_with_their_size(spark, tmp_path, monkeypatch):
    source = tmp_path / "logs"
    source.mkdir()
    (source / "a.jsonl").write_bytes('{"role":"u"}\nplain "text"\n{"cut\n\n[1]\nünï\n'.encode() + b"\xff\xfe\n")
    limits = []

    def deliver(session, *args, original=forward_module.deliver_batch):
        limits.append(session.conf.get(LIMIT))
        original(session, *args)

    monkeypatch.setattr(forward_module, "deliver_batch", deliver)
    before = spark.conf.get(LIMIT)
    for keep in (False, True):
        forwarder = Forwarder(
            root=str(tmp_path / f"lake{keep}"), adapter="claude_code", privacy=Privacy(include_payload=keep)
        )
        forward(spark, str(source), forwarder).awaitTermination()
        events = spark.read.parquet(forwarder.table("events/batch=0"))
        sizes = events.select("event_bytes", event_size(*ENVELOPE_FIELDS).alias("size")).collect()
        assert len(sizes) == 6 and all(r.event_bytes == r.size for r in sizes)
        sent = spark.read.parquet(forwarder.table("delivered")).select(F.inline("events"))
        assert sent.columns == ENVELOPE_FIELDS and sent.count() == 6
    # Only the session of the micro-batch is told.
    assert limits == ["8000"] * 2 and spark.conf.get(LIMIT) == before


def test_only_lines_that_may_be_objects_are_parsed(spark):
    values = ['{"role":"u"}', ' \t{"type":"t"}', "user: text", "[1]", '"x"', "17", "{cut", "null", "﻿{}", "", None]
    schema = "file_path STRING, line_number BIGINT, byte_offset BIGINT, byte_end BIGINT, byte_length BIGINT, value STRING"
    lines = spark.createDataFrame([("p/a.jsonl", i, i, i, 1, v) for i, v in enumerate(values)], schema)
    events = parse_session(lines, Capture(captured_at_ns=5))
    got = [(r.subtype, r.payload) for r in events.orderBy("line_number").collect()]
    assert got[:2] == [("role:u", values[0]), ("role:t", values[1])]
    assert all(subtype is None and "_parse_error" in payload for subtype, payload in got[2:])
    assert "CASE WHEN (StartsWith(value#" in plan_of(events)

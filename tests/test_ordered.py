"""Chunked running values against a plain loop, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from evidence_lake.operators.coverage import coverage, sticky_session
from evidence_lake.operators.ordered import Prior, with_prior
from evidence_lake.operators.packing import batch_keys, batch_summary, envelopes, pack, with_batch_id


def skewed_rows(n, seed=5):
    rnd = random.Random(seed)
    rows, pos = [], {}
    for _ in range(n):
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 9)}"
        pos[key] = pos.get(key, -1) + rnd.randint(1, 3)
        rows.append((key, pos[key], rnd.randint(0, 90), rnd.choice([None, f"s{rnd.randint(0, 3)}"])))
    rnd.shuffle(rows)
    return rows


DDL = "k STRING, pos BIGINT, size BIGINT, session STRING"


@pytest.mark.parametrize("coarse", [None, ["block"]])
def test_priors_equal_loop(spark, coarse):
    rows = skewed_rows(600)
    df = spark.createDataFrame(rows, DDL).withColumn("chunk", F.expr("pos div 37"))
    df = df.withColumn("block", F.expr("pos div 185"))
    got = with_prior(
        df,
        keys=["k"],
        chunk=["chunk"],
        order=["pos"],
        priors={
            "total": Prior("sum", F.col("size")),
            "peak": Prior("max", F.col("size")),
            "before": Prior("last", F.col("session")),
            "opened": Prior("first", F.col("session")),
        },
        coarse=coarse,
    ).collect()
    assert len(got) == len(rows)
    state = {}
    for row in sorted(got, key=lambda r: (r.k, r.pos)):
        total, peak, before, opened = state.get(row.k, (0, None, None, None))
        assert (row.total, row.peak, row.before, row.opened) == (total, peak, before, opened)
        state[row.k] = (
            total + row["size"],
            row["size"] if peak is None else max(peak, row["size"]),
            row.session,
            opened or row.session,
        )


def test_pack_limits_and_ids(spark):
    rows = skewed_rows(600)
    df = spark.createDataFrame(rows, DDL).select(
        F.col("k").alias("hostname"),
        "pos",
        F.expr("pos div 50").alias("chunk"),
        F.col("size").alias("event_bytes"),
        F.concat_ws("-", "k", "pos").alias("event_id"),
        F.lit("").alias("endpoint_id"),
        F.col("pos").alias("ts_ns"),
        F.lit(0).cast("bigint").alias("tick_index"),
    )
    packed = pack(
        df, stream=["hostname"], chunk=["chunk"], order=["pos"], max_events=20, max_bytes=500
    ).cache()
    summary = {tuple(r[c] for c in batch_keys(["hostname"])): r for r in batch_summary(packed, ["hostname"]).collect()}
    seen, before = {}, {}
    for row in sorted(packed.collect(), key=lambda r: (r.hostname, r.pos)):
        n, size = before.get(row.hostname, (0, 0))
        assert (row.slot_events, row.slot_bytes) == (n // 20, size // 500)
        before[row.hostname] = (n + 1, size + row.event_bytes)
        seen.setdefault((row.hostname, row.slot_events, row.slot_bytes), []).append(row.event_id)
    assert set(seen) == set(summary)
    assert max(len(v) for v in seen.values()) <= 20
    assert all(r.bytes < 500 + 90 for r in summary.values())
    named = with_batch_id(packed, ["hostname"], ["event_id", "pos"]).collect()
    by_event = {r.event_id: r.batch_id for r in named}
    for key, ids in seen.items():
        assert {by_event[i] for i in ids} == {summary[key].batch_id}
    sealed = envelopes(packed, ["hostname"], ["event_id"], ["pos"]).collect()
    assert {r.batch_id for r in sealed} == {r.batch_id for r in summary.values()}
    for row in sealed:
        positions = [int(e.event_id.rsplit("-", 1)[1]) for e in row.events]
        assert positions == sorted(positions)
        assert row.endpoint_id is None
    packed.unpersist()


def test_coverage_finds_gaps_and_overlaps(spark):
    ranges = [("a", 0, 10), ("a", 10, 30), ("a", 35, 40), ("a", 20, 38), ("b", 5, 9), ("c", 0, 4)]
    df = spark.createDataFrame(ranges, "path STRING, byte_offset BIGINT, byte_end BIGINT")
    df = df.withColumn("chunk", F.expr("byte_offset div 16"))
    got = coverage(df, path="path", chunk=["chunk"], order=["byte_offset"]).collect()
    found = {(r.path, r.byte_offset): (r.gap_bytes, r.overlap_bytes) for r in got}
    assert found == {
        ("a", 0): (0, 0),
        ("a", 10): (0, 0),
        ("a", 20): (0, 10),
        ("a", 35): (0, 3),
        ("b", 5): (5, 0),
        ("c", 0): (0, 0),
    }


def test_sticky_session(spark):
    rows = [("f", 0, None), ("f", 1, "x"), ("f", 2, "y"), ("f", 3, None), ("g", 0, "z")]
    df = spark.createDataFrame(rows, "path STRING, n BIGINT, session_id STRING")
    df = df.withColumn("chunk", F.expr("n div 2"))
    got = sticky_session(df, path="path", chunk=["chunk"], order=["n"]).collect()
    assert sorted((r.path, r.n, r.first_session) for r in got) == [
        ("f", 0, None), ("f", 1, "x"), ("f", 2, "x"), ("f", 3, "x"), ("g", 0, "z"),
    ]

"""Scalar functions against plain Python."""

import fnmatch
import hashlib
import re
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidence_lake.functions import (
    batch_digest,
    ordered_digest,
    parse_ts_ns,
    tick_end_ns,
    tick_index,
    tick_start_ns,
)
from evidence_lake.functions.globs import glob_regex, glob_root, matches_any
from evidence_lake.functions.redaction import DEFAULT_PATTERNS, effective_patterns, required_text

WIDTH = 600 * 1_000_000_000


def test_ticks(spark):
    start = 2_837_492 * WIDTH
    values = [start, start + WIDTH - 1, start + WIDTH, 0, -1, -WIDTH, -WIDTH - 1, 2**62]
    df = spark.createDataFrame([(v,) for v in values], "ns BIGINT")
    tick = tick_index(F.col("ns"))
    rows = df.select("ns", tick.alias("t"), tick_start_ns(tick).alias("a"), tick_end_ns(tick).alias("b"))
    for row in rows.collect():
        assert row.t == row.ns // WIDTH
        assert row.a <= row.ns <= row.b
        assert row.b - row.a == WIDTH - 1


TIMES = [
    "2026-04-20T01:02:03Z",
    "2026-04-20T01:02:03.123456Z",
    "2026-04-20T01:02:03.5+02:00",
    "2026-04-20 01:02:03,25-0530",
    "2026-04-20T01:02:03.123456789Z",
    "2026-04-20",
    "20260420",
    "20260420T010203Z",
    "2026-04-20T01:02",
    "2026-04-20T01:02+01:00",
    "2026-04-20T01",
    "1969-12-31T23:59:59.5Z",
    "0001-01-02T00:00:00Z",
    "9999-12-31T23:59:59Z",
]
NO_TIMES = ["", "2026", "2026-13-01", "2026-02-30T00:00:00Z", "x", "12:00", "2026-04-20T25:00:00Z",
            "2026-04-20T01:02:03 UTC", "1713571200", "2026-04-20T01:02:03Zx", " 2026-04-20"]


def python_ns(text):
    try:
        moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    moment = moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment
    delta = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    micros = (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds
    return micros * 1000 if abs(micros * 1000) < 2**63 else None


def test_parse_ts(spark):
    df = spark.createDataFrame([(t,) for t in TIMES[:12] + NO_TIMES], "s STRING")
    got = {r.s: r.ns for r in df.select("s", parse_ts_ns(F.col("s")).alias("ns")).collect()}
    for text in TIMES[:12]:
        assert got[text] == python_ns(text) and got[text] is not None, text
    for text in NO_TIMES:
        assert got[text] is None, text


def test_times_out_of_range_are_no_times(spark):
    df = spark.createDataFrame([(t,) for t in TIMES[12:]], "s STRING")
    for row in df.select("s", parse_ts_ns(F.col("s")).alias("ns")).collect():
        assert row.ns == python_ns(row.s)


def test_batch_digest_is_order_independent(spark):
    ids = [f"e{i:04d}" for i in range(50)]
    want = hashlib.sha256("".join(i + "\n" for i in sorted(ids)).encode()).hexdigest()
    df = spark.createDataFrame([(ids,), (ids[::-1],)], "ids ARRAY<STRING>")
    assert {r[0] for r in df.select(batch_digest(F.col("ids"))).collect()} == {want}


def test_ordered_digest_follows_position(spark):
    items = [(2, "b"), (1, "z"), (3, "a")]
    df = spark.createDataFrame([(items,)], "x ARRAY<STRUCT<p: INT, sha256: STRING>>")
    want = hashlib.sha256(b"z\nb\na\n").hexdigest()
    assert df.select(ordered_digest(F.col("x"), "sha256")).first()[0] == want


@settings(max_examples=300, deadline=None)
@given(
    st.text("ab/*?[]!-.(){}^|\\", max_size=8),
    st.text("ab/*?[]!-.(){}^|", max_size=8),
)
def test_glob_regex_equals_fnmatch(glob, path):
    glob = glob.replace("\\", "/")
    regex = glob_regex(glob).replace(r"\z", r"\Z")
    try:
        want = fnmatch.fnmatchcase(path, glob)
        got = re.search(regex, path) is not None
    except re.error:
        return  # ranges that run backwards match nothing anywhere
    assert got == want, (glob, path, regex)


def test_globs_in_spark(spark):
    paths = [
        "E:\\jobs\\closed-room\\one.jsonl",
        "/srv/a/closed-room/.k/two.jsonl",
        "/srv/a/open/three.jsonl",
        "/srv/a/closed-room/new\nline",
    ]
    df = spark.createDataFrame([(p,) for p in paths], "p STRING")
    hit = df.select(matches_any(F.col("p"), ("**/closed-room/**", "no[!a-z]match"))).collect()
    assert [r[0] for r in hit] == [True, True, False, True]
    assert glob_root("/a/b/**/*.jsonl") == "/a/b/"


SAMPLES = {
    DEFAULT_PATTERNS[0]: "sk-" + "a1" * 9,
    DEFAULT_PATTERNS[4]: "ghp_" + "a" * 20,
    DEFAULT_PATTERNS[6]: "AKIA" + "Z" * 16,
    DEFAULT_PATTERNS[7]: "eyJa.b.c",
    DEFAULT_PATTERNS[8]: "Q" * 70 + "==",
    r"ab?c\.d+": "ac.d",
    r"a{2}bc": "aabc",
    r"x|y": "y",
    r"(?i)tok": "TOK",
    r"\x41b": "Ab",
    r"no\+de*f": "no+df",
    r"[]x]yz?w": "]yw",
}


@pytest.mark.parametrize("pattern", SAMPLES)
def test_required_text_is_in_every_match(pattern):
    sample = SAMPLES[pattern]
    assert re.fullmatch(pattern, sample)
    assert required_text(pattern) in sample


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_required_text_on_generated_matches(data):
    atom = st.sampled_from(["a", "b", "-", r"\.", "[ab]", "[^x]", r"\d"])
    count = st.sampled_from(["", "", "+", "*", "?", "{2}", "{0,3}"])
    pattern = "".join(
        a + c for a, c in data.draw(st.lists(st.tuples(atom, count), min_size=1, max_size=6))
    )
    sample = data.draw(st.from_regex(pattern, fullmatch=True))
    assert required_text(pattern) in sample


def test_user_patterns_are_checked():
    assert effective_patterns(("x",))[-1] == "x"
    assert effective_patterns(("x",), include_defaults=False) == ("x",)
    for bad in (r"(a)?(?(1)b|c)", r"(?i)(a)\1", "("):
        with pytest.raises((ValueError, re.error)):
            effective_patterns((bad,))

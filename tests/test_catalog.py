"""Every query against its SQL twin on the smallest tables, and shape checks of the plans."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import check  # noqa: E402
from evidence_lake.plans import all_oracles, all_queries  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, con, name):
    ok, note = check.compare(spark, con, name, SF)
    assert ok, note


def test_only_state_machines_have_no_sql():
    assert set(all_queries()) - set(all_oracles()) == {"stream_liveness"}


def plan(spark, name):
    df = all_queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_narrow_reports_read_few_columns(spark):
    text = plan(spark, "identity_collisions")
    assert "ReadSchema: struct<user_id:bigint>" in text


@pytest.mark.parametrize(
    "name", ["canonical_events", "strip_payload", "watch_match", "redact_payload", "parse_ts"]
)
def test_row_wise_queries_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - {n for n in all_queries() if "stream" in n}))
def test_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text

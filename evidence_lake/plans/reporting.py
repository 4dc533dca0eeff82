"""Fleet report queries. "Now" is the newest event time of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delivery, reports
from .catalog import query
from .inputs import EVENT_LOG_SQL, event_log


@query(
    "tenant_status",
    f"""
WITH {EVENT_LOG_SQL}, clock AS (SELECT max(ts_ns) AS now_ns FROM ev)
SELECT 'demo' AS tenant,
       count(DISTINCT CASE WHEN now_ns - ts_ns < 300000000000
             THEN coalesce(nullif(endpoint_id, ''), hostname) END) AS endpoints_active,
       count(*) FILTER (WHERE now_ns - ts_ns < 3600000000000) AS events_last_hour,
       max(now_ns) AS server_time_ns
FROM ev, clock WHERE tenant = 'demo'
""",
)
def tenant_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_log(spark, sf_dir)
    return reports.tenant_status(events, "demo", reports.newest_ns(events))


@query(
    "endpoint_list",
    f"""
WITH {EVENT_LOG_SQL}
SELECT coalesce(nullif(endpoint_id, ''), hostname) AS endpoint_id, hostname,
       hostname AS endpoint_name, max(ts_ns) AS last_seen_ns, count(*) AS events_total
FROM ev WHERE tenant = 'prod' GROUP BY 1, hostname
""",
)
def endpoint_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.endpoint_list(event_log(spark, sf_dir), "prod")


@query(
    "quota_check",
    f"""
WITH {EVENT_LOG_SQL}
SELECT tenant, CAST(ts_ns // 86400000000000 AS INTEGER) AS day, count(*) AS events,
       CAST(greatest(count(*) - 150, 0) AS BIGINT) AS over_by
FROM ev GROUP BY ALL
""",
)
def quota_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.over_quota(event_log(spark, sf_dir), per_day=150)


@query(
    "identity_collisions",
    f"""
WITH {EVENT_LOG_SQL}
SELECT hostname, count(DISTINCT endpoint_id) AS endpoints FROM ev WHERE endpoint_id <> ''
GROUP BY hostname HAVING count(DISTINCT endpoint_id) > 1
""",
)
def identity_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.identity_collisions(event_log(spark, sf_dir))


@query(
    "recent_events",
    f"""
WITH {EVENT_LOG_SQL}
SELECT ts_ns, hostname AS source_id, hostname AS endpoint_name, 'tool_event' AS event_type
FROM ev WHERE tenant = 'demo' ORDER BY ts_ns DESC, event_id LIMIT 100
""",
)
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 are asked for; 100 is the most anybody gets."""
    return reports.recent_events(event_log(spark, sf_dir), "demo", 500)


@query(
    "retention",
    f"""
WITH {EVENT_LOG_SQL}
SELECT event_id, hostname, tick_index, subtype FROM ev
WHERE tick_index > (SELECT max(tick_index) FROM ev) - 1008 AND subtype <> 'error'
""",
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last seven days, allowed event types only."""
    events = event_log(spark, sf_dir)
    head = events.agg(F.max("tick_index")).scalar()
    typed = reports.retained(events, head).withColumn(
        "event_type", F.when(F.col("subtype") == "error", "debug").otherwise(F.col("event_type"))
    )
    return delivery.allowed_events(typed).select("event_id", "hostname", "tick_index", "subtype")


@query(
    "moving_counts",
    f"""
WITH {EVENT_LOG_SQL}, slides AS (
  SELECT hostname, ts_ns // 300000000000 AS slide, count(*) AS n FROM ev GROUP BY ALL
)
SELECT hostname, CAST((slide - k) * 300 AS BIGINT) AS window_start_s, CAST(sum(n) AS BIGINT) AS events
FROM slides, range(12) steps(k) GROUP BY ALL
""",
)
def moving_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each hour, moved on by five minutes."""
    return reports.moving_counts(event_log(spark, sf_dir), ["hostname"])

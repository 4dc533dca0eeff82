"""Byte coverage: were the bytes of every file delivered once, with nothing between?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Prior, with_prior


def coverage(lines: DataFrame, *, path: str, chunk: list[str], order: list[str]) -> DataFrame:
    """Per range: gap and overlap in bytes against everything delivered before it.

    Use all lines, blank ones too, or a blank line looks like a gap.
    """
    placed = with_prior(
        lines,
        keys=[path],
        chunk=chunk,
        order=order,
        priors={"_covered": Prior("max", F.col("byte_end"))},
    )
    covered = F.coalesce(F.col("_covered"), F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    return placed.select(
        *lines.columns,
        F.greatest(F.col("byte_offset") - covered, zero).alias("gap_bytes"),
        F.greatest(F.least(covered, F.col("byte_end")) - F.col("byte_offset"), zero).alias(
            "overlap_bytes"
        ),
    )


def coverage_report(ranges: DataFrame, path: str) -> DataFrame:
    """Gaps and overlaps per file; a file is intact with neither."""
    return ranges.groupBy(path).agg(
        F.count("*").alias("ranges"),
        F.max("byte_end").alias("covered_to"),
        F.count_if(F.col("gap_bytes") > 0).alias("gaps"),
        F.sum("gap_bytes").alias("gap_bytes"),
        F.count_if(F.col("overlap_bytes") > 0).alias("overlaps"),
        F.sum("overlap_bytes").alias("overlap_bytes"),
        ((F.sum("gap_bytes") + F.sum("overlap_bytes")) == 0).alias("intact"),
    )


def sticky_session(
    events: DataFrame, *, path: str, chunk: list[str], order: list[str], session: str = "session_id"
) -> DataFrame:
    """Column first_session: the first session id seen in the file, for all later lines.

    This is how history files used to be read; parsing now keeps each line's own session.
    """
    placed = with_prior(
        events,
        keys=[path],
        chunk=chunk,
        order=order,
        priors={"_first": Prior("first", F.col(session))},
    )
    return placed.withColumn("first_session", F.coalesce("_first", session)).drop("_first")

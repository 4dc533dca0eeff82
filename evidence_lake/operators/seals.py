"""Tick rollups and tick seals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import ordered_digest
from ..functions.ticks import floor_div

# Runs of file chunks are spread over 16**3 buckets before the last digest.
BUCKET_HEX = 3
CHUNKS_PER_RUN = 4096


def seal_bucket(path: str, chunk: str) -> Column:
    """Bucket of a run of chunks: by file, and for a huge file by part of it as well."""
    run = F.concat_ws("/", F.col(path).cast("string"), floor_div(F.col(chunk), CHUNKS_PER_RUN))
    return F.substring(F.sha2(run, 256), 1, BUCKET_HEX)


def tick_seal(
    events: DataFrame,
    keys: list[str],
    *,
    path: str = "file_path",
    chunk: str = "chunk",
    position: str = "byte_offset",
    size: str = "byte_length",
) -> DataFrame:
    """Events, bytes and one digest over all line hashes in file order, per group.

    The digest is a tree, so that no group is gathered whole, be it one file or a million:
    lines of one file chunk, then a bucket of chunks, then at most 4096 buckets. Any line
    changed, lost or moved changes the seal. `chunk` must not decrease along `position`.
    """
    leaves = events.groupBy(*keys, path, chunk).agg(
        F.count("*").alias("n"),
        F.sum(size).alias("size"),
        ordered_digest(F.collect_list(F.struct(position, "sha256")), "sha256").alias("digest"),
    )
    buckets = leaves.groupBy(*keys, seal_bucket(path, chunk).alias("bucket")).agg(
        F.sum("n").alias("n"),
        F.sum("size").alias("size"),
        ordered_digest(F.collect_list(F.struct(path, chunk, "digest")), "digest").alias("digest"),
    )
    return buckets.groupBy(*keys).agg(
        F.sum("n").alias("events"),
        F.sum("size").alias("bytes"),
        ordered_digest(F.collect_list(F.struct("bucket", "digest")), "digest").alias("seal"),
    )


def tick_rollup(
    events: DataFrame,
    keys: list[str],
    *,
    path: str = "file_path",
    session: str = "session_id",
    **tree: str,
) -> DataFrame:
    """The seal's columns and the numbers of distinct sessions and files.

    One file may hold many sessions and one session many files, so both are counted on their
    own, from values made distinct before the shuffle.
    """
    distinct = events.groupBy(*keys).agg(
        F.count_distinct(session).alias("sessions"), F.count_distinct(path).alias("files")
    )
    return tick_seal(events, keys, path=path, **tree).join(distinct, keys)

"""Exact deduplication by Grace hashing.

A task reads its records into an open-addressing table that compares complete contents. Once the
table is full, records whose content it does not hold go to spill files, dealt by other bits of
their digest; each file is then treated in the same way, one level deeper, until everything fits.
This runs twice: in each input partition before the shuffle, so that a text that makes up a third
of all rows reaches the reducer as one record a partition, and after it.

Defined cases: a null text counts as empty. A null id is the smallest of all; a group of nulls only
keeps id null, and its rows are kept. Rows that repeat both id and text share one decision.
Columns other than id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, byte_rows, partitions, small_batches

FANOUT = 16
TABLE_BYTES = 48 << 20
GROUP_SCHEMA = "bucket BIGINT, digest BINARY, content BINARY, keep_id BIGINT, rows BIGINT"


class ContentTable:
    """Linear probing over slots; equal only if the whole content is equal."""

    def __init__(self, budget: int):
        self.budget, self.used = budget, 0
        self.slots = np.full(1024, -1, np.int64)
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []
        self.keep: list[int | None] = []
        self.rows: list[int] = []

    def _slot(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[:8], "little") & mask
        while (entry := self.slots[at]) >= 0:
            if self.digests[entry] == digest and self.contents[entry] == content:
                break
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self.slots = np.full(len(self.slots) * 2, -1, np.int64)
        mask = len(self.slots) - 1
        for entry, digest in enumerate(self.digests):
            at = int.from_bytes(digest[:8], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry

    def add(self, digest: bytes, content: bytes, keep: int | None, rows: int) -> bool:
        """False if the content is new and the table has no room for it."""
        at = self._slot(digest, content)
        entry = self.slots[at]
        if entry >= 0:
            self.rows[entry] += rows
            if keep is not None and (self.keep[entry] is None or keep > self.keep[entry]):
                self.keep[entry] = keep
            return True
        if self.contents and self.used + len(content) > self.budget:
            return False
        self.slots[at] = len(self.contents)
        self.digests.append(digest)
        self.contents.append(content)
        self.keep.append(keep)
        self.rows.append(rows)
        self.used += len(content) + 200
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return True

    def records(self) -> Iterator[tuple]:
        return zip(self.digests, self.contents, self.keep, self.rows)


def _unpickled(file) -> Iterator[tuple]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def grace(records: Iterator[tuple], budget: int = TABLE_BYTES, level: int = 0) -> Iterator[tuple]:
    """Groups of (digest, content, keep id, rows) records, one for each content.

    A level deals by its own four bits of the digest. Every level takes at least one content into
    its table, so files shrink even where all digests were alike.
    """
    table, files = ContentTable(budget), {}
    for digest, content, keep, rows in records:
        if not table.add(digest, content, keep, rows):
            bits = digest[8 + (level // 2) % 24] >> (4 * (level % 2))
            file = files.get(bits % FANOUT)
            if file is None:
                # Scratch of this task alone, as Spark's own spills are; gone when it is closed.
                file = files[bits % FANOUT] = tempfile.TemporaryFile(buffering=1 << 18)
            pickle.dump((digest, content, keep, rows), file, pickle.HIGHEST_PROTOCOL)
    yield from table.records()
    del table
    for bucket in sorted(files):
        with files.pop(bucket) as file:
            yield from grace(_unpickled(file), budget, level + 1)


def _emit(groups: Iterator[tuple], with_content: bool) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int.from_bytes(r[0][24:], "little", signed=True) for r in rows], pa.int64()),
                pa.array([r[0] for r in rows], pa.binary()),
                pa.array([r[1] if with_content else None for r in rows], pa.binary()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.int64()),
            ],
            names=["bucket", "digest", "content", "keep_id", "rows"],
        )

    rows, size = [], 0
    for group in groups:
        rows.append(group)
        size += len(group[1])
        if len(rows) >= 2000 or size >= 8 << 20:
            yield batch(rows)
            rows, size = [], 0
    if rows:
        yield batch(rows)


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each different text: digest, keep_id (largest id) and rows."""
    small_batches(docs.sparkSession)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for doc_id, content in zip(ids, byte_rows(batch.column(1), lower=True)):
                    yield hashlib.sha256(content).digest(), content, doc_id, 1

        return _emit(grace(records()), True)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                columns = [batch.column(i).to_pylist() for i in range(1, 5)]
                yield from zip(*columns)

        def checked():
            seen = set()
            for group in grace(records()):
                # Digests only serve as join keys from here on, which two contents must not share.
                if group[0] in seen:
                    raise ValueError("two different texts have one SHA-256 digest")
                seen.add(group[0])
                yield group

        return _emit(checked(), False)

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return (
        read.mapInArrow(local, GROUP_SCHEMA)
        .repartition(partitions(docs.sparkSession), "bucket")
        .mapInArrow(merged, GROUP_SCHEMA)
        .select("digest", "keep_id", "rows")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    The join back carries ids and digests only. Its left side may be skewed; both sides are plain
    shuffles, so that adaptive execution splits a hot digest over tasks.
    """
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")
    )
    groups = content_groups(docs, id_col, text_col)
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        F.col("rows").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

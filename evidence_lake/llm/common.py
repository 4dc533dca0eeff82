"""What the operators of this subpackage share: tables that cut lineage, Arrow batches, hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.session import shared_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

# Texts are long: few rows make a large Arrow batch, and a batch must fit a small Python worker.
BATCH_ROWS = "2000"
BATCH_BYTES = str(16 << 20)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def small_batches(spark: SparkSession, size: str = BATCH_BYTES) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, written once to the shared folder: later steps do not compute them again,
    and a lost executor costs no more than the tasks it ran."""
    spark = df.sparkSession
    path = shared_dir(spark, f"llm-{purpose}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. `lower` does so for pure ASCII, far faster than translate."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from; the others are held out."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


def column_texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings; null counts as empty."""
    return pc.fill_null(column, "").to_pylist()


def byte_rows(column: pa.Array, lower: bool = False) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    column = pc.fill_null(column, "")
    if lower:
        column = pc.ascii_lower(column)
    return (value.as_buffer().to_pybytes() for value in column)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

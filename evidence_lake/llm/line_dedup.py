"""Line deduplication with DataFrame functions only.

Hashes of lines are range-partitioned by (hash, document) and sorted by (hash, document, position),
so a line that stands in a third of all documents spreads over many ranges. A stream over each
range marks first occurrences; their partial sums give the number of documents a line stands in.
The result is a bitmap of kept lines for each document, compressed by leaving out the words of 64
lines that are kept whole. Texts are only touched where a bitmap is applied.

Defined cases: a null or empty text is one empty line. Empty keys are never dropped. A row is known
by its id and text, so rows that repeat an id with other texts get bitmaps of their own; for the
count, one id is one document, and so are all null ids together. Other columns pass through
`apply_bitmaps` as they are; names that start with `_ld_` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, partitions, stored

MIN_DOCS = 10
SPACE = " \t\n\x0b\x0c\r"


def _row_key(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("_ld_id"), F.xxhash64(text).alias("_ld_text")]


def _lines(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, id, text, pos, first) sorted within ranges; 128 bits of hash tell lines apart.

    first is 1 on the first occurrence of a line in a document.
    """
    spark = docs.sparkSession
    key = ascii_lower(F.btrim(F.col("_ld_line"), F.lit(SPACE)))
    rows = (
        docs.select(*_row_key(id_col, text_col), F.posexplode(_lines(text_col)).alias("pos", "_ld_line"))
        .withColumn("_ld_line", key)
        .where(F.col("_ld_line") != "")
        .select(
            F.xxhash64("_ld_line").alias("h1"),
            F.xxhash64(F.lit(1), "_ld_line").alias("h2"),
            "_ld_id",
            "_ld_text",
            "pos",
        )
        .repartitionByRange(partitions(spark), "h1", "h2", "_ld_id")
        .sortWithinPartitions("h1", "h2", "_ld_id", "_ld_text", "pos")
    )
    # The ranges already hold each (line, document) together and in order: no further shuffle.
    one_document = Window.partitionBy("h1", "h2", "_ld_id").orderBy("_ld_text", "pos")
    first = F.when(F.row_number().over(one_document) == 1, 1).otherwise(0)
    return stored(rows.withColumn("first", first), "line-hashes")


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    keep: str = "none",
) -> DataFrame:
    """_ld_id, _ld_text and _ld_keep, the bitmap, of every row that loses a line.

    A line in at least `min_docs` documents is dropped: every time with keep="none", every time
    but its first (by document and position) with keep="first". _ld_keep lists (word, bits) in
    order for words with a dropped line; bit i of word w is line 64 w + i. Absent words are all
    ones.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is none or first, not {keep!r}")
    rows = line_hashes(docs, id_col, text_col)
    place = F.struct("_ld_id", "_ld_text", "pos")
    frequent = stored(
        rows.groupBy("h1", "h2")
        .agg(F.sum("first").alias("n_docs"), F.min(place).alias("_ld_first"))
        .where(F.col("n_docs") >= min_docs),
        "frequent-lines",
    )
    dropped = rows.join(frequent, ["h1", "h2"])
    if keep == "first":
        dropped = dropped.where(~place.eqNullSafe(F.col("_ld_first")))
    word = F.expr("cast(pos div 64 as int)").alias("word")
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    return (
        dropped.groupBy("_ld_id", "_ld_text", word)
        .agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
        .groupBy("_ld_id", "_ld_text")
        .agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("_ld_keep"))
    )


DROPPED_POSITIONS = """
flatten(transform(coalesce(_ld_keep, array()), w ->
    transform(filter(sequence(0, 63), b -> (shiftright(w.bits, b) & 1L) = 0L), b -> w.word * 64 + b)))
"""


def apply_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with the kept lines as text, plus _ld_keep, _ld_n_lines and _ld_n_dropped.

    A null text stays null. Lines are split below the join, so that no expression above it splits
    a text again for every line.
    """
    was_null = F.col(text_col).isNull().alias("_ld_null")
    others = [F.col(c) for c in docs.columns if c != text_col]
    left = docs.select(*others, *_row_key(id_col, text_col), was_null, _lines(text_col).alias("_ld_lines"))
    right = bitmaps.select(F.col("_ld_id").alias("_ld_i"), F.col("_ld_text").alias("_ld_t"), "_ld_keep")
    same = F.col("_ld_id").eqNullSafe(F.col("_ld_i")) & (F.col("_ld_text") == F.col("_ld_t"))
    joined = left.join(right, same, "left").withColumn("_ld_gone", F.expr(DROPPED_POSITIONS))
    kept = F.expr("array_except(sequence(0, size(_ld_lines) - 1), _ld_gone)")
    text = F.array_join(F.transform(kept, lambda p: F.col("_ld_lines")[p]), "\n")
    text = F.when(F.col("_ld_keep").isNull(), F.array_join("_ld_lines", "\n")).otherwise(text)
    return joined.select(
        *(
            F.when(~F.col("_ld_null"), text).alias(c) if c == text_col else F.col(c)
            for c in docs.columns
        ),
        "_ld_keep",
        F.size("_ld_lines").cast("long").alias("_ld_n_lines"),
        F.size("_ld_gone").cast("long").alias("_ld_n_dropped"),
    )


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """docs with repeated lines gone, in the columns of docs."""
    return apply_bitmaps(docs, keep_bitmaps(docs, **options)).select(*docs.columns)

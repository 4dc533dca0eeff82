"""Queries of the operators on whole tables, and SQL for those that SQL can say."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .common import benchmark, documents, labels, learnable
from .decontamination import contaminated
from .exact_dedup import exact_dedup
from .line_dedup import apply_bitmaps, keep_bitmaps
from .license_sql import SQL as OP13_SQL
from .licenses import license_report
from .near_dedup import near_duplicates
from .piece_dropout import decode, encode
from .quality import score_quality, train_quality
from .secrets import secret_scan
from .spelling import spelling_groups
from .token_counts import token_counts
from .token_files import read_ids, scratch_path, write_ids
from .toxicity import score_toxicity, train_toxicity

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
END_ID = 2
PIECES = "piece_bpe_32k.model"
DROPOUT_SEED = 17


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text and the test items it holds; texts that hold none are not listed."""
    return contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir)).drop("text_key")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, train_toxicity(docs, labels(spark, sf_dir)))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP3_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(k) AS text_sha256
FROM t WINDOW w AS (PARTITION BY k)
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return apply_bitmaps(docs, keep_bitmaps(docs)).select(
        "doc_id",
        F.col("_ld_n_lines").alias("n_lines"),
        F.col("_ld_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


OP4_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM l),
f AS (SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (k) GROUP BY doc_id
"""


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark)
    write_ids(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), END_ID, path)
    return read_ids(spark, path, with_ids=False).drop("ids")


def op6_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Varied segmentations of every text, and the digest of what they decode to."""
    model = public_tokenizers.path(PIECES)
    coded = encode(documents(spark, sf_dir).select("doc_id", "text"), model, seed=DROPOUT_SEED)
    summed = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, b: a + b)
    return decode(coded, model).select(
        "doc_id",
        F.size("pieces").cast("long").alias("n_pieces"),
        summed.alias("pieces_sum"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_quality(docs, train_quality(docs, labels(spark, sf_dir))).select(
        "doc_id",
        F.coalesce(~learnable(F.col("doc_id")), F.lit(True)).alias("held_out"),
        F.col("_q_score").alias("score"),
        F.col("_q_predicted").alias("predicted"),
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=2)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES)
    return align(documents(spark, sf_dir), a, b).drop("groups")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(documents(spark, sf_dir))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_toxicity,
        op3_exact_dedup,
        op4_line_dedup,
        op5_token_files,
        op6_piece_dropout,
        op7_quality,
        op8_near_dedup,
        op9_secrets,
        op10_token_counts,
        op11_alignment,
        op12_spelling,
        op13_licenses,
    )
}
ORACLES = {"op3_exact_dedup": OP3_SQL, "op4_line_dedup": OP4_SQL, "op13_licenses": OP13_SQL}

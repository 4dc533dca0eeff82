"""From raw documents to encoded training text: STAGES in order, each over all its predecessor kept.

1. quality: documents that the quality classifier rejects go.
2. lines: lines that stand in ten documents or more lose all their occurrences.
3. near_duplicates: of each group of near-duplicates (shingles of five words, similarity 0.8 or
   more) one document stays, the one with the smallest id.
4. decontamination: documents that hold a benchmark item go.
5. pieces: texts are encoded with seeded merge-dropout; `text` is what the pieces decode to.

All stages but the last return the columns they were given. Defined cases are those of the
operators: null texts count as empty, a row without id is never a duplicate, and rows that repeat
an id stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.llm import common
from evidence_lake.llm.decontamination import drop_contaminated
from evidence_lake.llm.line_dedup import line_dedup
from evidence_lake.llm.near_dedup import near_duplicates
from evidence_lake.llm.piece_dropout import decode, encode
from evidence_lake.llm.quality import score_quality, train_quality

MODEL = "piece_bpe_32k.model"
SEED = 17


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the documents at hand, then keeps those scored as good.

    Scores are written before they are filtered by: a filter on computed scores would be pushed into
    the statistics and write each of them out again in every rule.
    """
    model = train_quality(docs, common.labels(spark, sf_dir))
    scored = common.stored(score_quality(docs, model, keep=docs.columns), "pipeline-scores")
    return scored.where("_q_predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_nd_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_nd_id"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, common.benchmark(spark, sf_dir))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path(MODEL)
    coded = decode(encode(docs, model, seed=SEED), model)
    return coded.select(*docs.columns, "pieces", F.size("pieces").cast("long").alias("n_pieces"))


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("pieces", pieces),
]

# Learnt scores, sketches, tilings and keyed merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

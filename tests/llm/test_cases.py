"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidence_lake.llm import queries
from evidence_lake.llm.decontamination import contaminated, drop_contaminated
from evidence_lake.llm.exact_dedup import exact_dedup
from evidence_lake.llm.line_dedup import apply_bitmaps, keep_bitmaps, line_dedup
from evidence_lake.llm.near_dedup import near_duplicates
from evidence_lake.llm.piece_dropout import decode, encode
from evidence_lake.llm.quality import RuleModel, labelled_sample, score_quality, train_quality
from evidence_lake.llm.secrets import secret_scan
from evidence_lake.llm.token_counts import token_counts
from evidence_lake.llm.token_files import read_ids, scratch_path, write_ids
from evidence_lake.llm.toxicity import fit_toxicity, score_toxicity, train_toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = "lorem ipsum dolor " * 20_000
ROWS = [
    (None, "A line\nof text"),
    (None, None),
    (1, None),
    (2, ""),
    (3, "  \n\t"),
    (4, "x" * 150_000),
    (5, LONG),
    (6, LONG.upper()),
    (7, "Twice here and now"),
    (7, "Twice here and now"),
    (8, "twice here and NOW"),
    (9, "éİ▁ ok\n\nok"),
]
CLASHES = ("label", "rep", "n", "band", "rows", "digest", "score", "item_id", "kept", "_q", "id", "text_key", "bucket")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in ROWS], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES)).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def item(spark):
    return spark.createDataFrame([(1, "twice here and now again"), (2, None), (3, "a"), (4, "lorem ipsum dolor lorem ipsum dolor")], "item_id LONG, text STRING")


def by_id(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_exact_dedup(odd, none):
    got = exact_dedup(odd).where("doc_id >= 7").select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got)) == [(7, 8, 3, False), (7, 8, 3, False), (8, 8, 3, True), (9, 9, 1, True)]
    rows = exact_dedup(odd).collect()
    assert len(rows) == len(ROWS)
    blank = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {(r.doc_id, r.keep_id, r.group_size) for r in blank} == {(None, 2, 3), (1, 2, 3), (2, 2, 3)}
    assert exact_dedup(none).count() == 0


def test_line_dedup(odd, none):
    for keep in ("none", "first"):
        bitmaps = keep_bitmaps(odd, min_docs=2, keep=keep)
        out = apply_bitmaps(odd, bitmaps)
        assert out.count() == len(ROWS) and set(odd.columns) < set(out.columns)
        texts = {r.doc_id: r.text for r in out.where("doc_id IS NOT NULL").collect()}
        assert texts[1] is None and texts[2] == "" and texts[3] == "  \n\t"
        assert texts[6] == texts[8] == "" and texts[4] == "x" * 150_000
        assert texts[5] == (LONG if keep == "first" else "")
        assert texts[9] == "éİ▁ ok\n\nok"
    assert line_dedup(none).columns == none.columns and line_dedup(none).count() == 0


def test_line_positions(spark):
    lines = [f"line {i}" for i in range(200)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[63:66] + ["own"])), (3, " LINE 63\t")], "doc_id LONG, text STRING")
    out = {r.doc_id: r for r in apply_bitmaps(docs, keep_bitmaps(docs, min_docs=2)).collect()}
    assert out[1].text == "\n".join(lines[:63] + lines[66:]) and out[1]._ld_n_dropped == 3
    assert [(w.word, w.bits) for w in out[1]._ld_keep] == [(0, (1 << 63) - 1), (1, ~3)]
    assert out[2].text == "own" and out[3].text == ""
    first = {r.doc_id: r.text for r in line_dedup(docs, min_docs=2, keep="first").collect()}
    assert first == {1: docs.first().text, 2: "own", 3: ""}


def test_near_duplicates(odd, none):
    rows = near_duplicates(odd, words=2).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is not None}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[4] == (1, 4, True) and got[5] == (3, 5, True) and got[6] == (3, 5, False)
    assert got[7] == (3, 7, True) and got[8] == (3, 7, False)
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert near_duplicates(none).count() == 0


def test_decontamination(odd, none, item):
    got = by_id(contaminated(odd, item), "doc_id", "item_id", "coverage")
    assert got == [(5, "4", 1.0), (6, "4", 1.0)]
    left = drop_contaminated(odd, item)
    assert left.columns == odd.columns and left.count() == len(ROWS) - 2
    assert contaminated(none, item).count() == 0
    assert contaminated(odd, item.where("false")).count() == 0


def test_tokens(spark, odd, none):
    rows = token_counts(odd, WORD_BPE).collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows if r.doc_id is not None}
    assert len(rows) == len(ROWS) and got[1] == got[2] == (0, 0) and got[3] == (4, 0)
    assert token_counts(none, WORD_BPE).count() == 0
    path = scratch_path(spark)
    write_ids(odd, WORD_BPE, 2, path)
    files = read_ids(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in files] == sorted((r[0] for r in ROWS), key=lambda i: -1 if i is None else i)
    assert all(got[r.doc_id][1] + 1 == r.n_tokens for r in files if r.doc_id is not None)
    path = scratch_path(spark)
    write_ids(none, WORD_BPE, 2, path)
    assert read_ids(spark, path).count() == 0


def test_pieces(odd, none):
    coded = encode(odd, PIECES, seed=3)
    assert coded.columns == [*odd.columns, "pieces"]
    out = decode(coded, PIECES)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(ROWS, key=repr)
    assert decode(encode(none, PIECES), PIECES).count() == 0


def test_secrets(odd, none):
    rows = secret_scan(odd).collect()
    assert len(rows) == len(ROWS) and all(r.n_assign == r.n_access == r.n_hex == 0 for r in rows)
    assert secret_scan(none).count() == 0


def test_classifiers(spark, odd, none):
    model = fit_toxicity(["you idiot", "fine day", "idiot again", "a good day"] * 10, [1, 0, 1, 0] * 10)
    rows = score_toxicity(odd, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert score_toxicity(none, model).count() == 0
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None)], "doc_id LONG, quality INT, toxic INT")
    for l in (labels, labels.where("false")):
        rows = score_quality(odd, train_quality(odd, l), keep=odd.columns).collect()
        assert len(rows) == len(ROWS) and all(0 <= r._q_score <= 1 for r in rows)
        assert all(0 <= r.score <= 1 for r in score_toxicity(odd, train_toxicity(odd, l)).collect())
    assert train_quality(odd, labels.where("false")) == RuleModel((), (), 30.0)
    assert labelled_sample(odd, labels, "quality", 0).count() == 0
    assert score_quality(none, RuleModel((), (), 0.0)).count() == 0


def test_pipeline_stages(spark, odd, none, item, tmp_path):
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id LONG, quality INT, toxic INT")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    item.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs, rows in ((odd, len(ROWS)), (none, 0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns[: len(docs.columns)] == docs.columns
            assert out.count() <= rows and (i < 4) == (out.columns == docs.columns)
            docs = out


def test_queries_are_named_by_number():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)

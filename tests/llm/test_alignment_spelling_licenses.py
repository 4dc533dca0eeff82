"""Cross-tokenizer alignment, spelling variants and license scans against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidence_lake.llm import alignment, licenses, spelling
from evidence_lake.llm.token_counts import byte_symbols

SF = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = "lorem ipsum dolor " * 20_000
ROWS = [
    (None, "A line of text"), (None, None), (1, None), (2, ""), (3, "  \n\t"), (4, "x" * 150_000), (5, LONG),
    (6, "Hello  world, <|endoftext|> naïve <s> 漢字🙂 İ"), (6, "Hello  world, <|endoftext|> naïve <s> 漢字🙂 İ"),
    (7, "has ▁ sign"), (8, "tab\tnul\x00 don't"), (8, "another text of that id"), (9, " leading and trailing "),
]
CLASHES = ("chunk", "pairs", "n", "word", "near", "t", "d", "label", "k", "candidate", "_ls_id", "words", "runs", "best")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id LONG, text STRING")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES)).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_alignment(rows):
    tok_a = Tokenizer.from_file(BYTE_BPE)
    tok_a.encode_special_tokens = True
    tok_b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte_of = {s: b for b, s in byte_symbols().items()}

    def piece(i):
        p = tok_b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if tok_b.is_byte(i) else p.replace("▁", " ").encode()

    linked, holders = [], Counter()
    for _, text in rows:
        text = text or ""
        ids_a = tok_a.encode(" " + text, add_special_tokens=False).ids
        ids_b = tok_b.encode(text)
        raw_a = [bytes(byte_of[c] for c in tok_a.id_to_token(i)) for i in ids_a]
        raw_b = [piece(i) for i in ids_b]
        want = (" " + text).encode()
        if not text or b"".join(raw_a) != want or b"".join(raw_b) != want:
            ids_a, ids_b, raw_a, raw_b = [], [], [], []
        ends = []
        for raw in (raw_a, raw_b):
            at, stops = 0, {}
            for n, r in enumerate(raw):
                at += len(r)
                stops[at] = n + 1
            ends.append(stops)
        groups, a, b, links = [], 0, 0, Counter()
        for end in sorted(ends[0].keys() & ends[1].keys()):
            left, right = ids_a[a : ends[0][end]], ids_b[b : ends[1][end]]
            groups.append((left, right))
            for x in left:
                for y in right:
                    links[x, y] += 1
            a, b = ends[0][end], ends[1][end]
        linked.append((len(ids_a), len(ids_b), groups, links))
        holders.update(links.keys())
    most = defaultdict(int)
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    out = []
    for (doc_id, _), (n_a, n_b, groups, links) in zip(rows, linked):
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append(
            (
                doc_id, n_a, n_b, len(groups), sum(links.values()),
                sum(n for p, n in links.items() if holders[p] == most[p[0]]),
                sum(n * holders[p] for p, n in links.items()),
                hashlib.sha256(text.encode()).hexdigest() if groups else "", text,
            )
        )
    return sorted(out, key=repr)


@pytest.mark.parametrize("source", ["docs", "odd"])
@pytest.mark.parametrize("chunk_bytes", [alignment.CHUNK_BYTES, 20_000])
def test_alignment_equals_brute_force(request, monkeypatch, source, chunk_bytes):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk_bytes)
    df = request.getfixturevalue(source)
    got = alignment.align(df, BYTE_BPE, PIECES, with_groups=True).collect()
    want = brute_alignment([(r.doc_id, r.text) for r in df.collect()])
    assert sorted((tuple(r[:-1]) + (r.groups or "",) for r in got), key=repr) == want


def test_alignment_forgets_and_takes_none(monkeypatch, odd, docs):
    monkeypatch.setattr(alignment, "MEMORY_WINDOWS", 5)
    aligner = alignment.Aligner(BYTE_BPE, PIECES)
    texts = [r.text for r in docs.limit(30).collect()]
    alone = [aligner.align([t])[1][0] for t in texts]
    assert alone == aligner.align(texts)[1]
    assert alignment.align(odd.where("false"), BYTE_BPE, PIECES).count() == 0


def brute_spelling(rows, min_length=6, min_count=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    near = defaultdict(set)
    gaps = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            gaps[w[:i] + "\0" + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in n:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, c in n.items():
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 5 * c:
            form[w] = best
    out = []
    for w, c in n.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, c, len(near[w]), n.get(form.get(w))))
    return sorted(out)


def spelling_rows(df, **options):
    return sorted(tuple(r) for r in spelling.spelling_groups(df, **options).collect())


def test_spelling_equals_brute_force(spark, docs, odd):
    for df in (docs, odd):
        want = brute_spelling([(r.doc_id, r.text) for r in df.collect()])
        assert spelling_rows(df) == want
    assert spelling.spelling_groups(odd.where("false")).count() == 0


@pytest.mark.parametrize("size", [spelling.FILTER_BYTES, 64])
def test_spelling_chains_and_long_words(spark, monkeypatch, size):
    """Chains of forms, accents, runs of one letter, words beyond the last length; small filters only cost time."""
    monkeypatch.setattr(spelling, "FILTER_BYTES", size)
    long = "abcdefghij" * 12
    words = {
        "collor": 5, "colorr": 5, "coloor": 6, "colour": 40, "colours": 230, "colourss": 5, "cölour": 7, "aaaaaa": 9, "aaaaaaa": 50,
        "aaaaaaaa": 50, "ÿbcdef": 5, "ybcdef": 30, long: 30, long[:-1]: 5, "z" + long[1:]: 6, "same1": 5, "sixsix": 5, "sixsiy": 5,
        "b" * 64: 5, "b" * 63: 30, "b" * 65: 150,
    }
    rows = [(i, f"{w} ") for w, n in words.items() for i in range(n)] + [(10_000, "Sixsix SIXSIY")]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4)
    got = spelling_rows(df)
    assert got == brute_spelling(rows)
    found = {r[0]: r for r in got}
    assert found["aaaaaa"][1] == "aaaaaaa" and found["b" * 64][1] == "b" * 65 and sum(r[2] != r[0] for r in got) >= 6


def brute_licenses(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        places = []
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            want = phrase.split()
            places += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
        starts = [i for i, _ in places]
        labels = ",".join(sorted({label for _, label in places}))
        out.append((doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), labels))
    return sorted(out, key=repr)


BASE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
MIT = licenses.NOTICES[1][1]


@pytest.mark.parametrize("source", ["docs", "odd"])
def test_license_base_equals_brute_force(request, spark, source):
    df = request.getfixturevalue(source)
    got = licenses.license_report(df).select(*BASE).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_licenses([(r.doc_id, r.text) for r in df.collect()])


def test_license_labels(spark, odd):
    changed = MIT.replace("free of charge", "wholly free of charge").replace("merge, ", "")
    rows = [
        (1, "MIT License, mit\nLICENSE and General Public License apache license"),
        (2, f"intro {MIT} outro"),
        (3, f"some words {changed} more"),
        (4, "Permission is hereby granted, free of charge, to any person"),
        (5, "Licensed under CC BY-NC 4.0."),
        (6, "general license, public licence; the mit of licenses"),
        (7, f"{MIT} between {MIT}"),
        (7, f"{MIT} between {MIT}"),
        (8, "mit license " * 3000),
        (9, None),
    ]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = {r.doc_id: r for r in licenses.license_report(df).collect()}
    assert sorted((tuple(r[c] for c in BASE) for r in licenses.license_report(df).collect()), key=repr) == brute_licenses(rows)
    assert got[1].labels == got[1].base_labels == "apache,gpl,mit" and got[1].score == 1.0
    assert got[2].labels == "mit" and got[2].base_labels == "" and got[2].score == 1.0
    assert got[3].labels == "mit" and 0.75 <= got[3].score < 1.0
    assert got[4].labels == got[6].labels == got[9].labels == "" and got[4].score == 0.0
    assert got[5].labels == "cc-by-nc" and got[8].n_base == 3000
    _, found = licenses.license_scan(df)
    spans = sorted((r._ls_id, r.first_word, r.last_word) for r in found.where("_ls_id IN (2, 7)").collect())
    n = len(re.findall("[a-z]+", MIT.lower()))
    assert spans == [(2, 1, n), (7, 0, n - 1), (7, n + 1, 2 * n)]
    assert licenses.license_report(odd.where("false")).count() == 0


def test_license_grams_without_broadcast(spark, docs, monkeypatch):
    want = sorted(map(tuple, licenses.license_report(docs).collect()), key=repr)
    monkeypatch.setattr(licenses, "MAX_BROADCAST_GRAMS", 0)
    assert sorted(map(tuple, licenses.license_report(docs).collect()), key=repr) == want

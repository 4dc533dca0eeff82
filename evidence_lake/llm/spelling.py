"""Spelling variants by Bloom-guided neighbourhoods.

Words are counted over all texts; those frequent enough are the vocabulary. For every word all edits
are generated that delete one code point or replace one by a greater one: each pair of words at one
edit is so generated exactly once. Edits are probed against Bloom filters of the vocabulary, one for
each word length, made of blocks of 512 bits. Only edits that a filter knows are shuffled to a join with
the vocabulary, which removes what the filters got wrong: results are exact whatever their size.

Filters are broadcast. All filters of one pass take FILTER_BYTES at most; a larger vocabulary
takes more passes over its lengths, and a single length beyond that a fuller filter.

Defined cases: a null or empty text has no words; a null id counts as empty where words are altered;
rows that repeat are counted each; other columns are not read; an empty table has no words. Of
forms with equal counts the smallest in code-point order is taken.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, partitions, small_batches, stored

MIN_LENGTH = 6
MIN_COUNT = 5
FORM_RATIO = 5
ALTER_EVERY = 199
HELD_WORDS = 200_000
# Lengths from here on share one filter.
LONG = 64
BLOCK_BITS = 512
WORD_BITS, WORD_HASHES = 16, 6
LONG_BITS, LONG_HASHES = 48, 14
FILTER_BYTES = 64 << 20
PROBES = 1 << 20
POSITIVES = 100_000
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint32)
FACTOR = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(FACTOR, -1, 1 << 64)
SCRAMBLE = np.uint64(0x5851F42D4C957F2D)


def altered(run: str, raw: bytes, prefix: int) -> str:
    """The run, without one code point where its keyed hash says so."""
    h = zlib.crc32(raw, prefix)
    if h % ALTER_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT
) -> DataFrame:
    """word and n of every frequent word. Counts are added up in each task before they are shuffled."""
    small_batches(docs.sparkSession)
    # Altering only shortens, so shorter runs cannot become words.
    runs = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())}
            )

        for batch in batches:
            texts = pc.ascii_lower(pc.fill_null(batch.column(1), ""))
            for doc_id, text in zip(batch.column(0).to_pylist(), texts.to_pylist()):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(runs(text)).items():
                    word = altered(run, run.encode(), prefix)
                    if len(word) >= min_length:
                        total[word] += n
                if len(total) > HELD_WORDS:
                    yield flushed()
                    total.clear()
        yield flushed()

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = read.mapInArrow(count, "word STRING, n BIGINT")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letter_values(codes: np.ndarray) -> np.ndarray:
    return mix64(codes.astype(np.uint64) + np.uint64(1))


def powers(length: int) -> np.ndarray:
    factors = np.full(length, FACTOR, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors)


def code_points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length)


def text_of(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le")


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the words of each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(sizes).tolist():
        yield length, np.flatnonzero(sizes == length)


def hashes(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (letter_values(codes) * powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


class Shard:
    """A blocked Bloom filter of the words of one length, or its shape."""

    def __init__(self, words: int, is_long: bool):
        self.k = LONG_HASHES if is_long else WORD_HASHES
        bits = min(words * (LONG_BITS if is_long else WORD_BITS), FILTER_BYTES * 8)
        self.blocks = max(1, -(-bits // BLOCK_BITS))
        self.table = np.zeros(0, np.uint64)

    def place(self, h: np.ndarray) -> np.ndarray:
        """Block of each hash, by its high half."""
        return ((mix64(h) >> np.uint64(32)) * np.uint64(self.blocks)) >> np.uint64(32)

    def bit(self, h: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Word and place in it of the i-th bit of each hash within its block; seven bits from one scramble."""
        bit = (h >> np.uint64(9 * (i % 7))) & np.uint64(BLOCK_BITS - 1)
        return bit >> np.uint64(6), bit & np.uint64(63)

    def masks(self, h: np.ndarray) -> np.ndarray:
        rows = np.zeros((len(h), BLOCK_BITS // 64), np.uint64)
        for i in range(self.k):
            h = mix64(h + SCRAMBLE) if i % 7 == 0 else h
            word, place = self.bit(h, i)
            rows[np.arange(len(h)), word.astype(np.int64)] |= np.uint64(1) << place
        return rows

    def known(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be in the filter."""
        at = np.arange(len(h))
        block = self.place(h) * np.uint64(BLOCK_BITS // 64)
        for i in range(self.k):
            h = mix64(h + SCRAMBLE) if i % 7 == 0 else h
            word, place = self.bit(h, i)
            stay = (self.table[(block + word).astype(np.int64)] >> place) & np.uint64(1) == 1
            at, h, block = at[stay], h[stay], block[stay]
        return at


MASKS = [f"m{i}" for i in range(BLOCK_BITS // 64)]
BLOCK_SCHEMA = "shard INT, block BIGINT, " + ", ".join(f"{m} BIGINT" for m in MASKS)


def shard_of(length: int) -> int:
    return min(length, LONG)


def passes(sizes: dict[int, int]) -> Iterator[dict[int, Shard]]:
    """Shards in groups that fit FILTER_BYTES together."""
    group: dict[int, Shard] = {}
    held = 0
    for length, words in sorted(sizes.items()):
        shard = Shard(words, length == LONG)
        size = shard.blocks * BLOCK_BITS // 8
        if group and held + size > FILTER_BYTES:
            yield group
            group, held = {}, 0
        group[length] = shard
        held += size
    if group:
        yield group


def filled(vocabulary: DataFrame, shards: dict[int, Shard]) -> dict[int, Shard]:
    """Filters of the given lengths. Blocks are put together by Spark; the driver gets whole filters,
    FILTER_BYTES at most."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, at in by_length(words):
                number = shard_of(length)
                h = hashes(code_points([words[i] for i in at.tolist()], length))
                masks = shards[number].masks(h).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), number, np.int32)),
                        pa.array(shards[number].place(h).astype(np.int64)),
                        *(pa.array(np.ascontiguousarray(masks[:, i])) for i in range(len(MASKS))),
                    ],
                    names=["shard", "block", *MASKS],
                )

    lengths = F.least(F.char_length("word"), F.lit(LONG))
    rows = vocabulary.where(lengths.isin([int(s) for s in shards])).select("word").mapInArrow(blocks, BLOCK_SCHEMA)
    table = rows.groupBy("shard", "block").agg(*(F.bit_or(m).alias(m) for m in MASKS)).toArrow()
    number, block = (table.column(c).to_numpy() for c in ("shard", "block"))
    masks = np.stack([table.column(m).to_numpy() for m in MASKS], axis=1) if len(number) else np.zeros((0, len(MASKS)), np.int64)
    for key, shard in shards.items():
        bits = np.zeros((shard.blocks, len(MASKS)), np.int64)
        bits[block[number == key]] = masks[number == key]
        shard.table = bits.view(np.uint64).ravel()
    return shards


def edits(codes: np.ndarray, shards: dict[int, Shard]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int | None]]:
    """Edits of words of one length that a filter knows: rows, places, and the letter put there, or
    None where the letter is deleted."""
    length = codes.shape[1]
    values, power = letter_values(codes), powers(length)
    terms = values * power
    whole = terms.sum(axis=1, dtype=np.uint64)[:, None]
    shorter, same = shards.get(shard_of(length - 1)), shards.get(shard_of(length))
    if shorter is not None:
        upto = np.cumsum(terms, axis=1, dtype=np.uint64)
        h = (upto - terms) + (whole - upto) * np.uint64(INVERSE)
        # Of a run of one letter only the last is deleted, as all give the same word.
        last = np.ones(codes.shape, bool)
        last[:, :-1] = codes[:, 1:] != codes[:, :-1]
        row, place = np.nonzero(last)
        hit = shorter.known(h[row, place])
        yield row[hit], place[hit], codes[row[hit], place[hit]], None
    if same is not None:
        for letter in LETTERS.tolist():
            row, place = np.nonzero(codes < letter)
            change = (letter_values(np.array([letter])) - values[row, place]) * power[place]
            hit = same.known(whole[row, 0] + change)
            if len(hit):
                yield row[hit], place[hit], np.full(len(hit), letter, np.uint32), letter


def candidates(vocabulary: DataFrame, shards: dict[int, Shard]) -> DataFrame:
    """word, n and candidate: the edits of each word that the filters know."""
    spark = vocabulary.sparkSession
    shared = spark.sparkContext.broadcast(shards)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for length, places in by_length(words):
                step = max(1, PROBES // length)
                for first in range(0, len(places), step):
                    at = places[first : first + step].tolist()
                    codes = code_points([words[i] for i in at], length)
                    rows, found, held = [], [], 0
                    for row, place, put, letter in edits(codes, shared.value):
                        for r, p, c in zip(row.tolist(), place.tolist(), put.tolist()):
                            word = words[at[r]]
                            rows.append(at[r])
                            found.append(word[:p] + ("" if letter is None else chr(c)) + word[p + 1 :])
                            held += length
                            if held > POSITIVES * MIN_LENGTH:
                                yield chosen(words, counts, rows, found)
                                rows, found, held = [], [], 0
                    if rows:
                        yield chosen(words, counts, rows, found)

    lengths = sorted({n for s in shards for n in (s, s + 1)})
    wanted = F.least(F.char_length("word"), F.lit(LONG)).isin(lengths)
    return vocabulary.where(wanted).select("word", "n").mapInArrow(probe, "word STRING, n BIGINT, candidate STRING")


def chosen(words: list[str], counts: list[int], rows: list[int], found: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "word": pa.array([words[i] for i in rows], pa.string()),
            "n": pa.array([counts[i] for i in rows], pa.int64()),
            "candidate": pa.array(found, pa.string()),
        }
    )


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, near, near_n: all words at one edit, in both directions."""
    length = F.least(F.char_length("word"), F.lit(LONG)).cast("int")
    # At most LONG rows.
    sizes = {r[0]: r[1] for r in vocabulary.groupBy(length).agg(F.count("*")).collect()}
    vocab = vocabulary.select(F.col("word").alias("candidate"), F.col("n").alias("m"))
    both = F.array(
        F.struct("word", F.col("candidate").alias("near"), F.col("m").alias("near_n")),
        F.struct(F.col("candidate").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    spread = vocabulary.repartition(partitions(vocabulary.sparkSession), "word")
    result = None
    for group in passes(sizes):
        pairs = candidates(spread, filled(vocabulary, group)).join(vocab, "candidate").select(F.inline(both))
        result = pairs if result is None else result.unionByName(pairs)
    if result is None:
        return vocabulary.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).where("false")
    return stored(result, "near-words")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of every word with a form, by doubling the steps until no word moves.

    A form has FORM_RATIO times the count of its word, so a chain is as short as a logarithm.
    """
    steps = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.join(further, "root", "left")
        moved = stored(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        steps = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return steps


def spelling_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = FORM_RATIO,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every frequent word."""
    vocabulary = stored(word_counts(docs, id_col, text_col, min_length, min_count), "vocabulary")
    best = (
        near_words(vocabulary)
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    )
    is_form = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    joined = stored(
        vocabulary.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best.near")).alias("form"),
            F.when(is_form, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    root = roots(joined.where("form IS NOT NULL"))
    return joined.join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

"""Benchmark decontamination by greedy string tiling.

Texts and test items become lists of words. Windows of MIN_TILE words that a text shares with an
item are seeds; joining seeds gives the (text, item) pairs worth tiling. Tiling marks the longest
common runs first, never marking a word twice, found by running Karp-Rabin hashes over shorter and
shorter windows, down to MIN_TILE words. Tiles count wherever they lie, so a passage whose parts
were put in another order is covered like one in order. An item whose words are covered to
MIN_COVERAGE is in the text.

Which texts hold a seed is found in one scan. While the test set has at most MAX_SEEDS seeds they
go along with that scan; a larger one is joined by shuffling the distinct windows of each text.

Defined cases: words are runs of letters and digits, lower-cased. A null or empty text holds
nothing. Items without text or of fewer than MIN_TILE words are not searched, being no evidence.
Rows are told apart by id and text (null is an id like any other); repeated rows are reported once.
Other columns are not read, and pass through `drop_contaminated`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_texts, mix64, partitions, small_batches, stored

MIN_TILE = 5
MIN_COVERAGE = 0.5
MAX_SEEDS = 2_000_000
MEMORY_WORDS = 400_000
SEED_BITS = 22
# In UTF-8, ASCII that is no letter or digit becomes a space, and A-Z small.
PLAIN = bytes(i if i > 127 else ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)


def spaced(text: str) -> bytes:
    """The words of a text, lower-cased, with spaces between."""
    if not text.isascii():
        text = text.lower()
        for character in set(text):
            if character > "\x7f" and not character.isalnum():
                text = text.replace(character, " ")
    return text.encode().translate(PLAIN).strip()


class WordHasher(dict):
    """64-bit hashes of words; forgotten as a whole once there are too many."""

    def __missing__(self, word: str) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def hashes(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Word hashes of each text. Arrow splits the texts and numbers the distinct words."""
        if len(self) > MEMORY_WORDS:
            self.clear()
        words = pc.ascii_split_whitespace(pa.array([spaced(t) for t in texts], pa.large_string()))
        coded = words.values.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = np.fromiter(map(self.__getitem__, distinct), np.uint64, len(distinct))
        hashes = known[coded.indices.to_numpy()]
        ends = words.offsets.to_numpy()
        for text, start, end in zip(texts, ends[:-1], ends[1:]):
            own = hashes[start:end]
            # A text without words is split into one empty word.
            yield own if len(own) != 1 or spaced(text) else own[:0]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every window: a polynomial in BASE modulo 2^64, scrambled."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    for i in range(size):
        total = total * BASE + hashes[i : i + len(total)]
    return mix64(total)


class Seeds:
    """A sorted set of window hashes. A window is looked for only where its last bits are those of a seed,
    so the cost of a text does not depend on how many seeds there are."""

    def __init__(self, known: np.ndarray):
        self.known = np.unique(known)
        self.maybe = np.zeros(1 << SEED_BITS, bool)
        self.maybe[self._last(self.known)] = True

    def _last(self, found: np.ndarray) -> np.ndarray:
        return (found & np.uint64((1 << SEED_BITS) - 1)).astype(np.int64)

    def held(self, found: np.ndarray) -> np.ndarray:
        """Those of `found` that are seeds, in their order."""
        found = found[self.maybe[self._last(found)]]
        if not len(found):
            return found
        at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        return found[self.known[at] == found]


def tile(item: np.ndarray, text: np.ndarray, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, words), longest first."""
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    size = max(min_tile, len(item))
    while True:
        longest = _scan(item, text, free_item, free_text, size, tiles)
        if longest > 2 * size:
            size = longest
        elif size > 2 * min_tile:
            size = max(min_tile, size // 2)
        elif size > min_tile:
            size = min_tile
        else:
            return tiles


def _open(free: np.ndarray, size: int) -> np.ndarray:
    """Places where `size` words from here on are all unmarked."""
    blocked = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(blocked[size:] == blocked[:-size]) if len(free) >= size else np.zeros(0, np.int64)


def _scan(item, text, free_item, free_text, size: int, tiles: list) -> int:
    """Find and mark runs of at least `size` words; or return the length of one over twice that."""
    at_item, at_text = _open(free_item, size), _open(free_text, size)
    if not len(at_item) or not len(at_text):
        return 0
    item_hash, text_hash = windows(item, size)[at_item], windows(text, size)[at_text]
    shared = np.isin(text_hash, item_hash)
    places = defaultdict(list)
    for place, value in zip(at_text[shared].tolist(), text_hash[shared].tolist()):
        places[value].append(place)
    found = []
    for p, value in zip(at_item.tolist(), item_hash.tolist()):
        for t in places.get(value, ()):
            n = 0
            while (
                p + n < len(item) and t + n < len(text)
                and free_item[p + n] and free_text[t + n] and item[p + n] == text[t + n]
            ):
                n += 1
            if n > 2 * size:
                return n
            if n >= size:
                found.append((n, p, t))
    for n, p, t in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
        # What another tile took in the meantime leaves a shorter run, for a later scan.
        if free_item[p : p + n].all() and free_text[t : t + n].all():
            free_item[p : p + n] = free_text[t : t + n] = False
            tiles.append((p, t, n))
    return 0


def item_words(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_id, words (their hashes) and distinct seeds of every item that can be searched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            hashes = list(hasher.hashes(column_texts(batch.column(1))))
            seeds = [np.unique(windows(h, MIN_TILE)).view(np.int64).tolist() for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h.tobytes() for h in hashes], pa.binary()), pa.array(seeds, pa.list_(pa.int64()))],
                names=["item_id", "words", "seeds"],
            )

    rows = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    items = rows.distinct().mapInArrow(run, "item_id STRING, words BINARY, seeds ARRAY<BIGINT>")
    return stored(items.where(F.size("seeds") > 0), "benchmark-words")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    min_coverage: float = MIN_COVERAGE,
    max_seeds: int = MAX_SEEDS,
) -> DataFrame:
    """doc_id, text_key, item_id, item_words, covered_words, coverage, tiles and longest_tile of every
    text and the items it holds."""
    spark = docs.sparkSession
    small_batches(spark)
    items = item_words(benchmark, item_col, "text")
    seeds = items.select(F.explode("seeds").alias("seed"), "item_id")
    known = None
    if seeds.select("seed").distinct().count() <= max_seeds:
        found = seeds.select("seed").distinct().toPandas()["seed"].to_numpy(np.int64)
        known = found.view(np.uint64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        known_seeds = None if known is None else Seeds(known)
        for batch in batches:
            hits = []
            for hashes in hasher.hashes(column_texts(batch.column(2))):
                own = windows(hashes, MIN_TILE)
                if known_seeds is not None:
                    own = known_seeds.held(own)
                hits.append(np.unique(own).view(np.int64).tolist() if len(own) else [])
            held = pa.array([len(h) > 0 for h in hits], pa.bool_())
            texts = batch.column(2) if known is not None else pa.nulls(len(hits), pa.string())
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), texts, pa.array(hits, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "text", "hits"],
            )
            yield out.filter(held)

    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_key"),
        F.col(text_col).alias("text"),
    )
    schema = "doc_id BIGINT, text_key BIGINT, text STRING, hits ARRAY<BIGINT>"
    holders = stored(keyed.mapInArrow(scan, schema), "seed-holders")
    pairs = (
        holders.select("doc_id", "text_key", F.explode("hits").alias("seed"))
        .join(seeds, "seed")
        .select("doc_id", "text_key", "item_id")
        .distinct()
    )
    if known is None:
        texts = keyed.where(F.col("text").isNotNull()).dropDuplicates(["doc_id", "text_key"])
    else:
        texts = holders.select("doc_id", "text_key", "text").dropDuplicates(["doc_id", "text_key"])
    own = pairs.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "item_id")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))
    work = (
        own.join(texts, same)
        .join(items.select("item_id", "words"), "item_id")
        .select("doc_id", "text_key", "item_id", "text", "words")
        .repartition(partitions(spark))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            rows = []
            texts = hasher.hashes(column_texts(batch.column(3)))
            for text, words in zip(texts, batch.column(4).to_pylist()):
                item = np.frombuffer(words, np.uint64)
                tiles = tile(item, text)
                covered = sum(n for _, _, n in tiles)
                rows.append((len(item), covered, covered / len(item), len(tiles), max((n for _, _, n in tiles), default=0)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "text_key", "item_id", "item_words", "covered_words", "coverage", "tiles", "longest_tile"],
            )

    out = (
        "doc_id BIGINT, text_key BIGINT, item_id STRING, item_words BIGINT, covered_words BIGINT, "
        "coverage DOUBLE, tiles BIGINT, longest_tile BIGINT"
    )
    return work.mapInArrow(run, out).where(F.col("coverage") >= min_coverage)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows whose text holds a test item, in the columns of docs."""
    found = contaminated(docs, benchmark, id_col, text_col, **options)
    gone = found.select(F.col("doc_id").alias("_dc_id"), F.col("text_key").alias("_dc_key")).distinct()
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    same = F.col(id_col).eqNullSafe(F.col("_dc_id")) & (key == F.col("_dc_key"))
    return docs.join(gone, same, "left_anti")

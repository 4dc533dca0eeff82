"""Token counts by rank-synchronous merging.

The pre-tokens of a batch of texts are held as ragged numpy arrays of symbols. Each round merges
every sequence's lowest-ranked pair, all sequences at once; what survives is counted. Equal words
of a batch are merged once, and a bounded table keeps counts of words seen before. Words end at
blanks and line feeds, which no token of such a vocabulary spans.

Reads byte-level BPE files with word ends (`end_of_word_suffix`), composed and lower-cased text and
a pattern of word pieces. Special strings inside a text count as one token, as the library's
default has it.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a null id stays null; rows that
repeat are counted each; other columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_texts, small_batches
from .ragged import PairTable, merge

TOKEN_LIMIT = 2048
MEMORY_WORDS = 500_000
MERGE_SYMBOLS = 1_000_000
COUNT_SCHEMA = "doc_id BIGINT, n_bytes BIGINT, n_tokens BIGINT"


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeVocabulary:
    """Splits words into pre-tokens and counts the symbols that merging leaves."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or model["unk_token"]:
            raise ValueError(f"{path}: not a byte-level BPE of composed, lower-cased words")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_split = regex.compile("|".join(map(regex.escape, self.special)))
        suffix = model["end_of_word_suffix"]
        ids: dict[str, int] = {}
        symbol = lambda text: ids.setdefault(text, len(ids))
        names = byte_symbols()
        self.inner = np.array([symbol(names[b]) for b in range(256)])
        self.last = np.array([symbol(names[b] + suffix) for b in range(256)])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([symbol(p[i]) for p in pairs]) for i in (0, 1))
        merged = np.array([symbol(a + b) for a, b in pairs])
        self.table = PairTable(left, right, np.arange(len(pairs)), merged)

    def pre_tokens(self, word: str) -> tuple[int, list[bytes]]:
        """Number of special strings in a word, and its other pieces."""
        if word.isascii() and "<|" not in word:
            return 0, [p.encode() for p in self.pieces(word.lower())]
        parts = self.special_split.split(word)
        # Lower-casing goes by single characters: no rule looks at a character's neighbours.
        lowered = ("".join(map(str.lower, unicodedata.normalize("NFC", part))) for part in parts)
        return len(parts) - 1, [p.encode() for part in lowered for p in self.pieces(part)]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word."""
        result = np.zeros(len(words), np.int64)
        owner, held, size = [], [], 0
        for i, word in enumerate(words):
            special, pieces = self.pre_tokens(word)
            result[i] += special
            owner += [i] * len(pieces)
            held += pieces
            size += len(word)
            if size >= MERGE_SYMBOLS:
                result += np.bincount(owner, self._survivors(held), len(words)).astype(np.int64)
                owner, held, size = [], [], 0
        if held:
            result += np.bincount(owner, self._survivors(held), len(words)).astype(np.int64)
        return result

    def _survivors(self, pieces: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[raw[ends]]
        return merge(symbols, lengths, self.table)[1]


def vocabulary_pattern(path: str) -> Callable[[str], list[str]]:
    """Splits composed, lower-cased text into pre-tokens."""
    with open(path, encoding="utf-8") as file:
        split = json.load(file)["pre_tokenizer"]["pretokenizers"][0]
    return regex.compile(split["pattern"]["Regex"]).findall


@lru_cache(maxsize=2)
def vocabulary(path: str) -> MergeVocabulary:
    """Once in a Python worker."""
    return MergeVocabulary(path)


class CountingWords(dict):
    """Counts of words seen before; forgotten as a whole once there are too many."""

    def learn(self, vocab: MergeVocabulary, words: Iterable[str]) -> None:
        if len(self) > MEMORY_WORDS:
            self.clear()
        new = [w for w in words if w not in self]
        self.update(zip(new, vocab.counts(new).tolist()))


@lru_cache(maxsize=2)
def known_words(path: str) -> CountingWords:
    return CountingWords()


def words_of(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def token_counts(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; no shuffle."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known = vocabulary(tokenizer), known_words(tokenizer)
        for batch in batches:
            texts = column_texts(batch.column(1))
            split = [words_of(t) for t in texts]
            known.learn(vocab, set().union(*split))
            tokens = [sum(map(known.__getitem__, words)) for words in split]
            n_bytes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(count, COUNT_SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)

"""Token ids in bit planes.

Ids stand in order of their documents. A chunk holds whole documents; its ids are cut into blocks
of a fixed number, each block is transposed into one plane for every bit of an id (or, as an
option, for every byte), and each plane is compressed by zstandard. The chunk index (shard, chunk,
ids before it in the shard, ids, documents, sizes of all planes) stands beside the payload.

A file set is a folder of chunk rows that Spark's own writer commits: a lost executor leaves no
half-written shard, any file system Spark knows will do, and a reader prunes by the index columns.

Defined cases: a null or empty text has only the end id; rows with a null id come first; rows that
repeat an id stand next to each other. Other columns are not read. An empty table makes an empty
file set.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidence_lake.session import shared_dir

from .common import column_texts, partitions, small_batches
from .token_counts import MEMORY_WORDS, vocabulary_pattern, words_of

BLOCK_IDS = 1 << 14
CHUNK_IDS = 1 << 18
ID_BITS = 32
CHUNK_SCHEMA = (
    "shard INT, chunk INT, ids_before BIGINT, n_ids BIGINT, n_docs BIGINT, planes STRING, "
    "block_ids INT, plane_bytes ARRAY<INT>, doc_ids BINARY, doc_nulls BINARY, doc_lengths BINARY, payload BINARY"
)
DOC_SCHEMA = "shard INT, in_shard BIGINT, doc_id BIGINT, n_tokens BIGINT, ids_crc32 BIGINT, ids BINARY"


# The pattern of pre-tokens that `WordIds.pre_tokens` takes apart for whole arrays.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
GROUP_CHARS = 1 << 22
SPACE, LETTER, DIGIT, OTHER, UNSEEN = range(5)
KINDS = [
    (kind, regex.compile(sign).fullmatch)
    for kind, sign in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (OTHER, r"[^\s\p{L}\p{N}]"))
]


class WordIds(dict):
    """Little-endian ids of words, made by the tokenizers library; forgotten once too many.

    The library gets many different pre-tokens in one text, as a call costs more than a word does.
    Its ids are told apart by the tokens that end a pre-token. Texts are taken apart many at once, and
    only pre-tokens are remembered. Texts that are not plain (special strings, text that is not composed)
    are split into words; words that are not plain go to the library one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces: dict[str, bytes] = {}
        self.split = vocabulary_pattern(path)
        self.plain_pattern = self.split.__self__.pattern == PATTERN
        self.kind = np.full(0x110000, UNSEEN, np.uint8)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, word: str) -> str | None:
        if word.isascii():
            return None if "<|" in word else word.lower()
        if "<|" in word or "\u0130" in word or not unicodedata.is_normalized("NFC", word):
            return None
        return "".join(map(str.lower, word))

    def _learn_pieces(self, pieces: list[str], together: int = 500) -> None:
        groups = [pieces[i : i + together] for i in range(0, len(pieces), together)]
        for group, code in zip(
            groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        ):
            ids = np.array(code.ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(group) or (len(ids) and stops[-1] != 4 * len(ids)):
                self.pieces.update((p, self._alone(p)) for p in group)
                continue
            raw, start = ids.tobytes(), 0
            for piece, stop in zip(group, stops.tolist()):
                self.pieces[piece] = raw[start:stop]
                start = stop

    def learn(self, words: set[str]) -> None:
        if len(self) > MEMORY_WORDS:
            self.clear()
        # Pre-tokens are fewer than words and dearer to make: they stay for longer.
        if len(self.pieces) > 2 * MEMORY_WORDS:
            self.pieces.clear()
        parts: dict[str, list[str]] = {}
        for word in words - self.keys():
            plain = self._plain(word)
            if plain is None:
                self[word] = self._alone(word)
            else:
                # Letters alone are one pre-token.
                parts[word] = [plain] if plain.isalpha() else self.split(plain)
        known = self.pieces
        self._learn_pieces(list(set().union(*parts.values()) - known.keys()))
        for word, pieces in parts.items():
            self[word] = known[pieces[0]] if len(pieces) == 1 else b"".join([known[p] for p in pieces])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text. Plain texts are split and laid out many at once, the others word by word."""
        at, held = 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= GROUP_CHARS or i + 1 == len(texts):
                yield from self._encode(texts[at : i + 1])
                at, held = i + 1, 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        small = [lowered(t) if self.plain_pattern else None for t in texts]
        coded = iter(self._encode_plain([t for t in small if t is not None]))
        split = [words_of(t) for t, s in zip(texts, small) if s is None]
        self.learn(set().union(*split))
        odd = (b"".join(map(self.__getitem__, words)) for words in split)
        return [next(odd if s is None else coded) for s in small]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > 2 * MEMORY_WORDS:
            self.pieces.clear()
        pieces, counts = self.pre_tokens(texts)
        coded = pieces.dictionary_encode()
        distinct, places = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        known = self.pieces
        self._learn_pieces([p for p in distinct if p not in known])
        raw = [known[p] for p in distinct]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) >> 2
        flat, starts = np.frombuffer(b"".join(raw), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[places]
        stop = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(stop[-1]) + np.repeat(starts[places] - stop[:-1], n)].tobytes()
        ends = (4 * stop[np.cumsum(counts)]).tolist()
        return [ids[s:e] for s, e in zip([0, *ends], ends)]

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        found = self.kind[points]
        for point in np.unique(points[found == UNSEEN]).tolist():
            self.kind[point] = next(k for k, is_kind in KINDS if is_kind(chr(point)))
            found[points == point] = self.kind[point]
        return found

    def pre_tokens(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The pre-tokens of lower-cased texts one after the other, and how many each text has: runs of
        letters, single digits, runs of other signs, and the endings that stand behind an apostrophe."""
        points = np.frombuffer("\n".join([*texts, "\n\n"]).encode("utf-32-le"), "<u4")
        kind = self._kinds(points)
        begins = kind == DIGIT
        begins[0] |= kind[0] != SPACE
        begins[1:] |= kind[1:] != kind[:-1]
        begins &= kind != SPACE
        quote = np.flatnonzero(begins[:-3] & (points[:-3] == ord("'")))
        first, second = points[quote + 1], points[quote + 2]
        for ending in ENDINGS:
            fits = first == ord(ending[0])
            if len(ending) > 1:
                fits &= second == ord(ending[1])
            own = quote[fits]
            begins[own + 1] = False
            behind = own + 1 + len(ending)
            begins[behind] = kind[behind] != SPACE
        keep = kind != SPACE
        begun = begins[keep]
        kept = points[keep]
        width = np.ones(len(kept), np.int64)
        for limit in (0x80, 0x800, 0x10000):
            width += kept >= limit
        offsets = np.append((np.cumsum(width) - width)[begun], width.sum())
        data = kept.tobytes().decode("utf-32-le").encode()
        pieces = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        before = np.concatenate([[0], np.cumsum(begins)])[ends]
        return pieces, np.diff(before, prepend=0)


def lowered(text: str) -> str | None:
    """A text in small letters, all at once. None where case depends on what stands beside a letter, and
    where the text is not composed or may hold special strings."""
    if "<|" in text:
        return None
    if text.isascii() or not ("\u0130" in text or "\u03a3" in text) and unicodedata.is_normalized("NFC", text):
        return text.lower()
    return None


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """Once in a Python worker. Words end at blanks and line feeds, which no token spans."""
    return WordIds(path)


def to_planes(ids: np.ndarray, planes: str = "bit") -> list[bytes]:
    """Planes of one block, compressed, lowest first; planes above the highest set bit are left out."""
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        rows = np.ascontiguousarray(raw.T)
        rows = rows[: 1 + max((i for i in range(4) if rows[i].any()), default=0)]
    else:
        top = max(1, int(ids.max()).bit_length() if len(ids) else 0)
        # Bytes that are zero in every id have no planes.
        bits = np.unpackbits(raw[:, : -(-top // 8)], axis=1, bitorder="little").T
        rows = np.packbits(bits[:top], axis=1, bitorder="little")
    pack = zstandard.ZstdCompressor(level=3).compress
    return [pack(row.tobytes()) for row in rows]


def from_planes(parts: list[bytes], count: int, planes: str = "bit") -> np.ndarray:
    unpack = zstandard.ZstdDecompressor().decompress
    rows = [np.frombuffer(unpack(p), np.uint8) for p in parts]
    if planes == "byte":
        raw = np.zeros((count, 4), np.uint8)
        for i, row in enumerate(rows):
            raw[:, i] = row[:count]
        return raw.view("<u4").ravel()
    # Eight planes are one byte of the ids.
    raw = np.zeros((count, ID_BITS // 8), np.uint8)
    for at in range(0, len(rows), 8):
        held = np.zeros(count, np.uint8)
        for i, row in enumerate(rows[at : at + 8]):
            held |= np.unpackbits(row, count=count, bitorder="little") << np.uint8(i)
        raw[:, at // 8] = held
    return raw.view("<u4").ravel()


def pack_chunk(ids: np.ndarray, planes: str, block_ids: int) -> tuple[list[int], bytes]:
    """Sizes of all planes, each block's list led by its number of planes, and the payload."""
    sizes, payload = [], []
    for at in range(0, len(ids), block_ids):
        parts = to_planes(ids[at : at + block_ids], planes)
        sizes += [len(parts), *map(len, parts)]
        payload += parts
    return sizes, b"".join(payload)


def unpack_chunk(sizes: list[int], payload: bytes, count: int, planes: str, block_ids: int) -> np.ndarray:
    out, at, offset = [], 0, 0
    for first in range(0, count, block_ids):
        parts = []
        for size in sizes[at + 1 : at + 1 + sizes[at]]:
            parts.append(payload[offset : offset + size])
            offset += size
        at += 1 + sizes[at]
        out.append(from_planes(parts, min(block_ids, count - first), planes))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def write_ids(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    planes: str = "bit",
    block_ids: int = BLOCK_IDS,
    chunk_ids: int = CHUNK_IDS,
) -> None:
    """Encode every text, append end_id, and write the ids in ascending order of document ids."""
    if planes not in ("bit", "byte"):
        raise ValueError(f"planes is bit or byte, not {planes!r}")
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shard = word_ids(tokenizer), TaskContext.get().partitionId()
        chunk = before = held = 0
        ids: list[int | None] = []
        parts: list[bytes] = []

        def closed() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(parts), "<u4")
            sizes, payload = pack_chunk(flat, planes, block_ids)
            lengths = np.fromiter((len(p) // 4 for p in parts), "<i8", len(parts))
            row = {
                "shard": shard, "chunk": chunk, "ids_before": before, "n_ids": len(flat),
                "n_docs": len(parts), "planes": planes, "block_ids": block_ids, "plane_bytes": sizes,
                "doc_ids": np.array([i or 0 for i in ids], "<i8").tobytes(),
                "doc_nulls": np.array([i is None for i in ids], np.uint8).tobytes(),
                "doc_lengths": lengths.tobytes(), "payload": payload,
            }
            return pa.RecordBatch.from_pylist([row], schema=CHUNK_ARROW)

        for batch in batches:
            for doc_id, coded in zip(batch.column(0).to_pylist(), known.encode(column_texts(batch.column(1)))):
                ids.append(doc_id)
                parts.append(coded + end)
                held += len(parts[-1]) // 4
                if held >= chunk_ids:
                    yield closed()
                    chunk, before, held, ids, parts = chunk + 1, before + held, 0, [], []
        if parts:
            yield closed()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    chunks = ordered.mapInArrow(encode, CHUNK_SCHEMA)
    chunks.write.option("compression", "uncompressed").parquet(path)


CHUNK_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("chunk", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()),
        ("n_docs", pa.int64()), ("planes", pa.string()), ("block_ids", pa.int32()),
        ("plane_bytes", pa.list_(pa.int32())), ("doc_ids", pa.binary()), ("doc_nulls", pa.binary()),
        ("doc_lengths", pa.binary()), ("payload", pa.binary()),
    ]
)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (little-endian, 32 bits) of each document.

    Where a shard starts follows from the index: one row a shard, summed in order. That is as many
    rows as the writer had partitions, whatever the number of documents.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flat = unpack_chunk(
                    row["plane_bytes"], row["payload"], row["n_ids"], row["planes"], row["block_ids"]
                ).tobytes()
                lengths = np.frombuffer(row["doc_lengths"], "<i8")
                ends = np.cumsum(lengths)
                texts = [flat[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                nulls = np.frombuffer(row["doc_nulls"], np.uint8).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(texts), row["shard"], np.int32)),
                        pa.array(row["ids_before"] + ends - lengths),
                        pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=nulls),
                        pa.array(lengths),
                        pa.array([zlib.crc32(t) for t in texts], pa.int64()),
                        pa.array(texts if with_ids else [None] * len(texts), pa.binary()),
                    ],
                    names=["shard", "in_shard", "doc_id", "n_tokens", "ids_crc32", "ids"],
                )

    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    base = shards.select(F.col("shard").alias("base_shard"), F.coalesce(before, F.lit(0)).alias("base"))
    docs = chunks.mapInArrow(decode, DOC_SCHEMA)
    return docs.join(base, F.col("shard") == F.col("base_shard")).select(
        "doc_id", (F.col("base") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )


def scratch_path(spark: SparkSession) -> str:
    return shared_dir(spark, "llm-token-files")

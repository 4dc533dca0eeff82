"""SentencePiece encoding with seeded merge-dropout, and decoding.

A word is segmented by an agenda of candidate merges, best score first, then leftmost. Candidates are
numbered as they are popped; each occurrence of a word has bits of its own, drawn by a keyed hash of
(seed, document, place in the document), and a candidate whose bit is set is thrown away. The rate is
the share of set bits, to 2**-16. So every occurrence may be segmented in its own way, and none depends
on where or how often a task runs. At rate 0 the result is the library's.

Segmentations of a word form a tree: a node is the list of candidates thrown away so far. Nodes are
remembered, not outcomes: an occurrence walks from node to node by its own bits, and only nodes met for
the first time are worked out, all of a batch together. Words of more than LONG_WORD characters, and those
that pop more candidates than a node can number, are segmented one by one with a heap.

No piece reaches over the start of a run of blanks or over a line feed, so words are independent.
U+2581 in a text, which the library cannot tell from a blank, is written as its three bytes;
characters without a piece are bytes as well. Decoding gives back every text exactly.

Defined cases: a null text stays null (no pieces); an empty text has an empty list; a null id draws
the bits of id 0; repeated rows get equal pieces; other columns pass through `encode` unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import mix64, small_batches
from .ragged import PairTable, merge

RATE = 0.1
RATE_BITS = 16
MEMORY_NODES = 100_000
GROUP_CHARS = 1 << 19
# Ids take more room than their texts, and a worker keeps what it once took.
PIECE_BATCH_BYTES = str(4 << 20)
LONG_WORD = 64
DECODE_PIECES = 1 << 18
BLANK = "▁"
FIRST_PIECE = 0x110000
UNITS = re.compile(f" *[^ \n{BLANK}]+| +|\n|{BLANK}").findall
MERGE_WORDS = 100_000


def units_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """What UNITS finds in the texts, one after the other, each text behind a blank of its own; and how many
    units each text has. An empty text has none."""
    texts = [" " + t if t else "" for t in texts]
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    stop = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    blank, sign = points == ord(" "), (points == ord("\n")) | (points == ord(BLANK))
    # A blank begins a unit unless it stands behind another, any other character only behind a sign.
    begins = sign | blank
    begins[1:] &= sign[1:] | ~blank[:-1]
    begins[1:] |= sign[:-1]
    # Every text that is not empty begins with a blank, and blanks that end the text before are no part of it.
    starts = np.concatenate([[0], stop[:-1]])[np.fromiter(map(len, texts), np.int64, len(texts)) > 0]
    begins[starts] = True
    width = np.ones(len(points), np.int64)
    for limit in (0x80, 0x800, 0x10000):
        width += points >= limit
    offsets = np.append((np.cumsum(width) - width)[begins], width.sum())
    units = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(whole.encode()))
    before = np.concatenate([[0], np.cumsum(begins)])[stop]
    return units, np.diff(before, prepend=0)


def keyed(seed: int, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One hash for each (document, place)."""
    start = mix64(np.array([seed & 0xFFFFFFFFFFFFFFFF], np.uint64) + np.uint64(1))
    return mix64(mix64(ids.astype(np.uint64) + start) + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def drop_bits(keys: np.ndarray, rate: float, block: int = 0) -> np.ndarray:
    """64 bits for each key, each set with probability `rate`; `block` counts further 64 bits."""
    level = round(rate * (1 << RATE_BITS))
    bits = np.zeros(len(keys), np.uint64)
    if level >= 1 << RATE_BITS:
        return ~bits
    # From the last digit of the rate on: a set digit halves the distance to 1, another to 0.
    for digit in range((level & -level).bit_length() - 1 if level else RATE_BITS, RATE_BITS):
        fresh = mix64(keys + np.uint64((block * RATE_BITS + digit + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        bits = bits | fresh if (level >> digit) & 1 else bits & fresh
    return bits


class PieceModel:
    """Pieces of a BPE model with byte fallback. Symbols: code points, and FIRST_PIECE + id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.library = model
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i) for i in plain}
        self.byte_ids = np.zeros(256, np.int64)
        self.is_byte = np.array([model.is_byte(i) for i in ids])
        self.raw: list[bytes] = [b""] * len(ids)
        for i in ids:
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.raw[i] = i, bytes([value])
            elif i in text:
                self.raw[i] = text[i].replace(BLANK, " ").encode()
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_size = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.id_of_point = {ord(t): i for i, t in text.items() if len(t) == 1}
        symbol = {t: ord(t) if len(t) == 1 else FIRST_PIECE + i for i, t in text.items()}
        ranks = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        pairs = []
        for i, piece in text.items():
            if any(c == BLANK for c in piece.lstrip(BLANK)) or "\n" in piece:
                raise ValueError(f"{path}: a piece reaches over a word's start")
            for at in range(1, len(piece)):
                left, right = piece[:at], piece[at:]
                if all(len(p) == 1 or p in symbol for p in (left, right)):
                    both = (symbol.get(p, ord(p[0])) for p in (left, right))
                    pairs.append((*both, ranks[model.get_score(i)], symbol[piece]))
        self.table = PairTable(*np.array(pairs, np.int64).T)
        self.pairs = {(left, right): (rank, merged) for left, right, rank, merged in pairs}

    def _finish(self, symbols: np.ndarray) -> bytes:
        """Ids of merged symbols, little-endian."""
        out = []
        for s in symbols.tolist():
            if s >= FIRST_PIECE:
                out.append(s - FIRST_PIECE)
            elif s in self.id_of_point:
                out.append(self.id_of_point[s])
            else:
                out += self.byte_ids[list(chr(s).encode())].tolist()
        return np.array(out, "<i4").tobytes()

    def segment_whole(self, words: list[str]) -> tuple[list[bytes | None], np.ndarray]:
        """As `segment` where nothing is thrown away: the library's own ids, for words that begin with a
        blank, as it adds one itself. Every candidate popped is then a merge. None for words with bytes."""
        coded = self.library.encode([w[1:] for w in words], num_threads=1)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), "<i4", int(sizes.sum()))
        stop = np.cumsum(sizes)
        bytes_before = np.concatenate([[0], np.cumsum(self.is_byte[flat])])
        raw, plain = flat.tobytes(), bytes_before[stop] == bytes_before[stop - sizes]
        spans = zip((stop - sizes).tolist(), stop.tolist(), plain.tolist())
        return [raw[4 * s : 4 * e] if ok else None for s, e, ok in spans], np.fromiter(map(len, words), np.int64, len(words)) - sizes

    def segment(self, words: list[str], thrown: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Ids of each word where the candidates of the set bits of `thrown` are thrown away, and how many
        candidates were popped."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        points[points == 32] = ord(BLANK)
        popped = np.zeros(len(words), np.int64)

        def skip(word: np.ndarray, left: np.ndarray, right: np.ndarray, pair: np.ndarray) -> np.ndarray:
            # Every unfinished word pops one candidate a round.
            number = popped[word]
            popped[word] += 1
            return (number < 64) & ((thrown[word] >> np.minimum(number, 63).astype(np.uint64)) & np.uint64(1) == 1)

        symbols, counts = merge(points, lengths, self.table, every=False, skip=skip)
        return self._ids(words, lengths, symbols, counts), popped

    def _ids(self, words: list[str], lengths: np.ndarray, symbols: np.ndarray, counts: np.ndarray) -> list[bytes]:
        # The literal blank sign is a unit of its own and must not become a blank.
        single = np.flatnonzero(lengths == 1)
        literal = {i for i in single.tolist() if words[i] == BLANK}
        ids = np.where(symbols >= FIRST_PIECE, symbols - FIRST_PIECE, -1)
        low = symbols < FIRST_PIECE
        if low.any():
            found, back = np.unique(symbols[low], return_inverse=True)
            ids[low] = np.array([self.id_of_point.get(p, -1) for p in found.tolist()])[back]
        ends = np.cumsum(counts)
        raw, whole = ids.astype("<i4").tobytes(), np.concatenate([[0], np.cumsum(ids < 0)])
        out = []
        for i, (end, count) in enumerate(zip(ends.tolist(), counts.tolist())):
            if i in literal:
                out.append(self.byte_ids[list(BLANK.encode())].astype("<i4").tobytes())
            elif whole[end] == whole[end - count]:
                out.append(raw[4 * (end - count) : 4 * end])
            else:
                out.append(self._finish(symbols[end - count : end]))
        return out

    def segment_alone(self, word: str, key: int, rate: float) -> bytes:
        """Ids of one word, however long."""
        symbols: list[int | None] = [ord(BLANK) if c == " " else ord(c) for c in word]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple] = []

        def add(left: int, right: int) -> None:
            if left >= 0 and right < len(symbols) and (found := self.pairs.get((symbols[left], symbols[right]))):
                heappush(heap, (found[0], left, right, symbols[left], symbols[right], found[1]))

        for i in range(len(word) - 1):
            add(i, i + 1)
        number, bits = 0, 0
        while heap:
            _, left, right, a, b, merged = heappop(heap)
            if symbols[left] != a or after[left] != right or symbols[right] != b:
                continue
            if number % 64 == 0:
                bits = int(drop_bits(np.array([key], np.uint64), rate, number // 64)[0])
            number += 1
            if bits >> (number - 1) % 64 & 1:
                continue
            symbols[left], symbols[right] = merged, None
            after[left] = after[right]
            if after[right] < len(symbols):
                before[after[right]] = left
            add(before[left], left)
            add(left, after[left])
        return self._finish(np.array([s for s in symbols if s is not None]))

    def decode(self, ids: list[int]) -> str:
        """The text whose pieces these are, without the blank put before it."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]

    def decode_all(self, pieces: pa.ListArray) -> list[str | None]:
        """The texts of many lists of pieces; null where there is no list."""
        at = pieces.offsets.to_numpy().astype(np.int64)
        flat = pieces.values.to_numpy()[at[0] : at[-1]]
        raw, stop = [], np.concatenate([[0], np.cumsum(self.raw_size[flat])])
        # A bounded number of pieces at once: the places of their bytes take eight times their size.
        for low in range(0, len(flat), DECODE_PIECES):
            part = flat[low : low + DECODE_PIECES]
            sizes, begin = self.raw_size[part], stop[low : low + len(part)] - stop[low]
            where = np.arange(stop[low + len(part)] - stop[low]) + np.repeat(self.raw_start[part] - begin, sizes)
            raw.append(self.raw_bytes[where].tobytes())
        whole, ends = b"".join(raw), stop[at - at[0]].tolist()
        return [
            whole[s:e].decode("utf-8", "replace")[1:] if ok else None
            for s, e, ok in zip(ends, ends[1:], pieces.is_valid().to_pylist())
        ]


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """Once in a Python worker."""
    return PieceModel(path)


class Encoder:
    """Encodes texts, remembering the nodes of the words seen before."""

    def __init__(self, path: str, seed: int, rate: float):
        self.model, self.seed, self.rate = piece_model(path), seed, rate
        self.first: dict[str, int] = {}
        self.child: dict[int, int] = {}
        self.word: list[str] = []
        self.ids: list[bytes] = []
        # Candidates thrown away, the number of the next one, and how many there are if no other is thrown.
        self.thrown, self.begin, self.total = (np.zeros(0, kind) for kind in (np.uint64, np.int64, np.int64))
        self.parent, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keep the nodes that were met most, half as many as fit at most; a node goes with its parent."""
        base = self.parent < 0
        # A node is met as often as its children are.
        for _ in range(4):
            np.maximum.at(self.met, self.parent[~base], self.met[~base])
        keep, often = self.met > 1, 2
        while keep.sum() > MEMORY_NODES // 2:
            keep, often = self.met > often, 2 * often
        while (lost := keep & ~base & ~keep[self.parent]).any():
            keep &= ~lost
        number = np.where(keep, np.cumsum(keep) - 1, -1)
        at = number.tolist()
        self.first = {w: at[n] for w, n in self.first.items() if n >= 0 and at[n] >= 0}
        self.child = {at[k >> 6] << 6 | k & 63: at[n] for k, n in self.child.items() if at[n] >= 0}
        kept = np.flatnonzero(keep)
        self.word, self.ids = ([held[n] for n in kept.tolist()] for held in (self.word, self.ids))
        self.thrown, self.begin, self.total = self.thrown[kept], self.begin[kept], self.total[kept]
        self.parent = np.where(self.parent[kept] < 0, -1, number[self.parent[kept]])
        self.met = np.zeros(len(kept), np.int64)

    def _add(self, words: list[str], thrown: np.ndarray, begin: np.ndarray, parent: np.ndarray) -> range:
        ids, popped = [], []
        for at in range(0, len(words), MERGE_WORDS):
            part = self.model.segment(words[at : at + MERGE_WORDS], thrown[at : at + MERGE_WORDS])
            ids += part[0]
            popped.append(part[1])
        return self._hold(words, ids, thrown, begin, np.concatenate(popped), parent)

    def _hold(
        self, words: list[str], ids: list[bytes], thrown: np.ndarray, begin: np.ndarray, total: np.ndarray, parent: np.ndarray
    ) -> range:
        new = range(len(self.ids), len(self.ids) + len(words))
        self.word += words
        self.ids += ids
        self.thrown = np.append(self.thrown, thrown)
        self.begin = np.append(self.begin, begin)
        self.total = np.append(self.total, total)
        self.parent = np.append(self.parent, parent)
        self.met = np.append(self.met, np.zeros(len(words), np.int64))
        return new

    def _first_nodes(self, words: list[str]) -> np.ndarray:
        """Nodes where nothing is thrown away; -1 for long words."""
        unknown = set(words).difference(self.first)
        whole = [w for w in unknown if len(w) <= LONG_WORD and w[0] == " " and w[-1] != " "]
        if whole:
            coded, total = self.model.segment_whole(whole)
            plain = np.flatnonzero([c is not None for c in coded])
            held, none = [whole[i] for i in plain.tolist()], np.zeros(len(plain), np.int64)
            ids = [c for c in coded if c is not None]
            self.first.update(zip(held, self._hold(held, ids, none.astype(np.uint64), none, total[plain], none - 1)))
            unknown.difference_update(held)
        new = [w for w in unknown if len(w) <= LONG_WORD]
        if new:
            none = np.zeros(len(new), np.int64)
            self.first.update(zip(new, self._add(new, none.astype(np.uint64), none, none - 1)))
        self.first.update((w, -1) for w in unknown if len(w) > LONG_WORD)
        return np.fromiter(map(self.first.__getitem__, words), np.int64, len(words))

    def _walk(self, node: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Where each occurrence ends up by its bits; -1 where candidates are beyond the bits."""
        node, active = node.copy(), np.flatnonzero(node >= 0)
        while len(active):
            at = node[active]
            beyond = self.total[at] > 64
            node[active[beyond]] = -1
            active, at = active[~beyond], at[~beyond]
            begin, total = self.begin[at], self.total[at]
            begun = bits[active] >> np.minimum(begin, 63).astype(np.uint64)
            width = np.where(begin < 64, total - begin, 0)
            within = np.where(width >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(width, 63).astype(np.uint64)) - np.uint64(1))
            left = begun & within
            go = left != 0
            active, at, left, begin = active[go], at[go], left[go], begin[go]
            if not len(active):
                break
            lowest = left & (~left + np.uint64(1))
            number = begin + np.log2(lowest.astype(np.float64)).astype(np.int64)
            step, which = np.unique((at << 6) | number, return_inverse=True)
            new = [s for s in step.tolist() if s not in self.child]
            if new:
                parent, place = np.array(new) >> 6, np.array(new) & 63
                thrown = self.thrown[parent] | (np.uint64(1) << place.astype(np.uint64))
                self.child.update(zip(new, self._add([self.word[p] for p in parent.tolist()], thrown, place + 1, parent)))
            node[active] = np.fromiter(map(self.child.__getitem__, step.tolist()), np.int64, len(step))[which]
        return node

    def _encode(self, texts: list[str], ids: list[int | None]) -> list[bytes]:
        if len(self.ids) > MEMORY_NODES:
            self.forget()
        units, sizes = units_of(texts)
        coded = units.dictionary_encode()
        words, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        stop = np.cumsum(sizes)
        places = np.arange(len(which)) - np.repeat(stop - sizes, sizes)
        documents = np.repeat(np.array([i or 0 for i in ids], np.int64), sizes)
        keys = keyed(self.seed, documents, places)
        node = self._first_nodes(words)[which]
        if self.rate > 0:
            node = self._walk(node, drop_bits(keys, self.rate))
        alone = {
            i: self.model.segment_alone(words[which[i]], int(keys[i]), self.rate) for i in np.flatnonzero(node < 0).tolist()
        }
        self.met += np.bincount(node[node >= 0], minlength=len(self.met))
        held = self.ids
        found = [held[n] if n >= 0 else alone[i] for i, n in enumerate(node.tolist())] if alone else list(map(held.__getitem__, node.tolist()))
        return [b"".join(found[s:e]) for s, e in zip((stop - sizes).tolist(), stop.tolist())]

    def encode(self, texts: list[str], ids: list[int | None]) -> list[bytes]:
        out, at, held = [], 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= GROUP_CHARS or i + 1 == len(texts):
                out += self._encode(texts[at : i + 1], ids[at : i + 1])
                at, held = i + 1, 0
        return out


@lru_cache(maxsize=2)
def encoder(path: str, seed: int, rate: float) -> Encoder:
    """Once in a Python worker, so that words stay known from task to task."""
    return Encoder(path, seed, rate)


def encode(
    docs: DataFrame,
    model: str,
    seed: int = 0,
    rate: float = RATE,
    id_col: str = "doc_id",
    text_col: str = "text",
    pieces_col: str = "pieces",
) -> DataFrame:
    """docs with the ids of each text's pieces in `pieces_col`, which replaces a column of that name."""
    if not 0 <= rate <= 1:
        raise ValueError(f"rate lies from 0 to 1, not {rate}")
    small_batches(docs.sparkSession, PIECE_BATCH_BYTES)
    rest = [f for f in docs.schema.fields if f.name != pieces_col]
    schema = StructType([*rest, StructField(pieces_col, ArrayType(IntegerType()))])
    at_id, at_text = ([f.name for f in rest].index(c) for c in (id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(model, seed, rate)
        for batch in batches:
            texts = batch.column(at_text)
            coded = encoding.encode([t or "" for t in texts.to_pylist()], batch.column(at_id).to_pylist())
            sizes = np.fromiter((len(c) // 4 for c in coded), np.int64, len(coded))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(coded), "<i4"))
            pieces = pa.ListArray.from_arrays(pa.array(offsets), values, mask=texts.is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces], names=[*batch.schema.names, pieces_col])

    return docs.select(*(F.col(f"`{f.name}`") for f in rest)).mapInArrow(run, schema)


def decode(coded: DataFrame, model: str, pieces_col: str = "pieces", text_col: str = "text") -> DataFrame:
    """coded with the text its pieces stand for in `text_col`, which replaces a column of that name."""
    small_batches(coded.sparkSession, PIECE_BATCH_BYTES)
    rest = [f for f in coded.schema.fields if f.name != text_col]
    schema = StructType([*rest, StructField(text_col, StringType())])
    at = [f.name for f in rest].index(pieces_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoding = piece_model(model)
        for batch in batches:
            texts = pa.array(decoding.decode_all(batch.column(at)), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, texts], names=[*batch.schema.names, text_col]
            )

    return coded.select(*(F.col(f"`{f.name}`") for f in rest)).mapInArrow(run, schema)

"""Which tokens of one tokenizer stand for which tokens of another, by white-space anchors.

Each text is tokenised whole by both. Places where a token that starts with a blank begins in both
tokenisations at the same byte are anchors: the ends before them are shared, which the byte offsets
verify, so they cut a text into small windows. What a window aligns to depends on its token ids
alone and is remembered by them. A group is a shortest stretch whose ends both tokenisations share;
all tokens of its two sides are linked.

How many documents hold a linked id pair is counted over the whole corpus: chunks of documents carry
their distinct pairs and how many of their documents hold each, so hot pairs are added up before
they are shuffled, and every chunk looks its pairs up once. No pair of a single document is shuffled.

Side A is a byte-level BPE file of the tokenizers library and reads a blank before each text; it is
encoded by tiktoken from the file's own vocabulary, five times faster and with the same ids, as that
vocabulary ascends in the order of its merges. Side B is a sentencepiece model, which adds that blank
itself. Special strings in texts are plain text.

Defined cases: texts that are null or empty, or whose tokens do not spell the blank and the text
(side B cannot tell U+2581 from a blank), have no tokens: zeros, and '' for the digest. A null id
stays null. Every row is a document, repeated rows too. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_texts, mix64, small_batches, stored
from .token_counts import byte_symbols

PIECE_BYTES = 1 << 20
CHUNK_BYTES = 8 << 20
MEMORY_WINDOWS = 300_000
MEMORY_TOKENS = 5_000_000
MANY_LINKS = 4096
# No id: stands between the two sides of a window's key.
BETWEEN = -1
# The words of byte-level BPE files (fixed value of that format), with runs that are never taken back.
BYTE_LEVEL_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
CHUNK_ARROW = pa.schema(
    [
        ("chunk", pa.int64()), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64())),
        ("doc_ids", pa.list_(pa.int64())), *((c, pa.list_(pa.int64())) for c in COUNTS),
        ("digests", pa.list_(pa.string())), ("groups", pa.list_(pa.string())),
        ("n_pairs", pa.list_(pa.int64())), ("steps", pa.binary()), ("times", pa.binary()),
    ]
)
CHUNK_SCHEMA = (
    "chunk BIGINT, pairs ARRAY<BIGINT>, holders ARRAY<BIGINT>, doc_ids ARRAY<BIGINT>, "
    + ", ".join(f"{c} ARRAY<BIGINT>" for c in COUNTS)
    + ", digests ARRAY<STRING>, groups ARRAY<STRING>, n_pairs ARRAY<BIGINT>, steps BINARY, times BINARY"
)
DOC_SCHEMA = (
    "doc_id BIGINT, n_a BIGINT, n_b BIGINT, n_groups BIGINT, n_links BIGINT, n_best BIGINT, "
    "count_sum BIGINT, groups_sha256 STRING, groups STRING"
)


class Side:
    """Bytes of each id of a vocabulary, their number, and whether they start with a blank."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw
        self.length = np.array([len(r) for r in raw], np.int64)
        self.names = list(map(str, range(len(raw))))
        self.marked = np.array([r[:1] == b" " for r in raw])


def byte_level_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level BPE file whose ids ascend in the order of its merges. Only then
    do ranks of whole tokens merge as the file's list of merges does."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"]
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    plain = model["type"] == "BPE" and not spec["normalizer"] and not model["end_of_word_suffix"]
    if not plain or split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"]:
        raise ValueError(f"{path}: not a plain byte-level BPE")
    vocab = model["vocab"]
    if any(vocab[m] != 256 + i for i, m in enumerate(merges)):
        raise ValueError(f"{path}: ids do not follow the merges")
    byte_of = {symbol: byte for byte, symbol in byte_symbols().items()}
    names = sorted((i, name) for name, i in vocab.items() if i < 256 + len(merges))
    return [bytes(byte_of[c] for c in name) for _, name in names]


class Aligner:
    """Tokenises texts by both files and aligns their windows, which it remembers by their ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        raw = byte_level_tokens(path_a)
        self.a = Side(raw)
        ranks = {r: i for i, r in enumerate(raw)}
        # With no special string at all the library would look for an empty one at every byte. One is
        # named, and stays plain text, as it is never allowed.
        self.tok_a = tiktoken.Encoding(
            path_a, pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(raw)}
        )
        self.tok_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.b = Side([self._piece(i) for i in range(self.tok_b.get_piece_size())])
        self.text, self.pairs, self.times = [], [], []
        self.met = np.zeros(0, np.int64)
        self.forget()

    def _piece(self, i: int) -> bytes:
        piece = self.tok_b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.tok_b.is_byte(i) else piece.replace("▁", " ").encode()

    def forget(self, kept: int = 0) -> None:
        """Keep the windows met in most calls, at most `kept` of them."""
        keys = list(self.number) if kept else []
        most = np.sort(np.argsort(-self.met[: len(keys)], kind="stable")[:kept]).tolist()
        self.number: dict[bytes, int] = {keys[k]: i for i, k in enumerate(most)}
        for name in ("text", "pairs", "times"):
            setattr(self, name, list(map(getattr(self, name).__getitem__, most)))
        for name in ("n_groups", "n_links"):
            setattr(self, name, array("q", map(getattr(self, name).__getitem__, most) if most else ()))
        self.met = np.zeros(len(most), np.int64)
        self.held = sum(map(len, self.pairs)) // 8

    def _learn(self, keys: list[bytes], a: np.ndarray, b: np.ndarray, size_a: np.ndarray) -> None:
        """Groups and linked pairs of new windows, all windows at once; size_a: their ids of side A."""
        ends_a, ends_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        # Both sides of a window spell the same bytes, so ends stay comparable from window to window.
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        n_a, n_b = (np.bincount(g, minlength=len(shared)) for g in (group_a, group_b))
        from_b = np.cumsum(n_b) - n_b
        last = np.cumsum(size_a) - 1
        stop = group_a[last] + 1
        # Links of a group with very many tokens are counted by distinct ids, others token by token.
        many = n_a * n_b > MANY_LINKS
        reps = np.where(many, 0, n_b)[group_a]
        at = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        pairs = (np.repeat(a, reps) << 32) | b[np.repeat(from_b[group_a], reps) + at]
        times = np.ones(len(pairs), np.int64)
        where = np.repeat(group_a, reps)
        for g in np.flatnonzero(many).tolist():
            left, times_a = np.unique(a[group_a == g], return_counts=True)
            right, times_b = np.unique(b[group_b == g], return_counts=True)
            pairs = np.append(pairs, ((left << 32)[:, None] | right).ravel())
            times = np.append(times, (times_a[:, None] * times_b).ravel())
            where = np.append(where, np.full(len(left) * len(right), g))
        order = np.argsort(where, kind="stable") if many.any() else slice(None)
        raw_pairs, raw_times = pairs[order].astype("<i8").tobytes(), times[order].astype("<i8").tobytes()
        pair_stop = 8 * np.searchsorted(where[order], stop)
        words = [f"{x}|{y}" for x, y in zip(listed(self.a, a, n_a), listed(self.b, b, n_b))]
        links = np.concatenate([[0], np.cumsum(n_a * n_b)])
        first = np.concatenate([[0], stop[:-1]])
        self.n_groups.extend((stop - first).tolist())
        self.n_links.extend((links[stop] - links[first]).tolist())
        self.number.update(zip(keys, range(len(self.text), len(self.text) + len(keys))))
        self.text += [";".join(words[g:h]) for g, h in pairwise([0, *stop.tolist()])]
        self.pairs += [raw_pairs[p:q] for p, q in pairwise([0, *pair_stop.tolist()])]
        # Equal bytes are held once: nearly all links of a window are single.
        ones = [b"\1\0\0\0\0\0\0\0" * i for i in range(64)]
        for raw in (raw_times[p:q] for p, q in pairwise([0, *pair_stop.tolist()])):
            short = ones[len(raw) // 8] if len(raw) < 512 else raw
            self.times.append(short if raw == short else raw)
        self.held += len(a) + len(b) + len(pairs)

    def align(self, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Counts and group texts of each text; its distinct pairs in order, and their number of links."""
        if len(self.number) > MEMORY_WINDOWS:
            self.forget(MEMORY_WINDOWS // 2)
        if self.held > MEMORY_TOKENS:
            self.forget()
        # Merging bytes loses none, so side A always spells its text.
        coded_a = [self.tok_a.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        coded_b = self.tok_b.encode(texts, num_threads=1)
        raw_b = self.b.raw.__getitem__
        for i, text in enumerate(texts):
            if not text or b"".join(map(raw_b, coded_b[i])) != b" " + text.encode():
                coded_a[i], coded_b[i] = coded_a[i][:0], []
        n_a, n_b = (np.fromiter(map(len, coded), np.int64, len(texts)) for coded in (coded_a, coded_b))
        flat_a = np.concatenate(coded_a).astype("<i4")
        flat_b = np.fromiter(chain.from_iterable(coded_b), "<i4", int(n_b.sum()))
        start_a, start_b = (
            np.cumsum(side.length[flat]) - side.length[flat] for side, flat in ((self.a, flat_a), (self.b, flat_b))
        )
        # Valid texts start with a blank on both sides, so every text starts with an anchor.
        anchors = np.intersect1d(
            start_a[self.a.marked[flat_a]], start_b[self.b.marked[flat_b]], assume_unique=True
        )
        cut_a = np.append(np.searchsorted(start_a, anchors), len(flat_a))
        cut_b = np.append(np.searchsorted(start_b, anchors), len(flat_b))
        some, which = distinct_windows((flat_a, cut_a), (flat_b, cut_b))
        keys = window_keys((flat_a, cut_a), (flat_b, cut_b), some)
        if new := {key: i for i, key in enumerate(keys) if key not in self.number}:
            at = some[np.fromiter(new.values(), np.int64, len(new))]
            size_a, size_b = (cut[at + 1] - cut[at] for cut in (cut_a, cut_b))
            part_a, part_b = (
                flat[places(cut[at], size)].astype(np.int64)
                for flat, cut, size in ((flat_a, cut_a, size_a), (flat_b, cut_b, size_b))
            )
            self._learn(list(new), part_a, part_b, size_a)
            self.met = np.append(self.met, np.zeros(len(new), np.int64))
        found = np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))
        np.add.at(self.met, found, 1)
        windows = found[which]
        numbers = windows.tolist()
        window_stop = np.searchsorted(cut_a[:-1], np.cumsum(n_a))
        owner = np.repeat(np.arange(len(texts)), np.diff(window_stop, prepend=0))
        group_texts, at = [], 0
        for stop in window_stop.tolist():
            group_texts.append(";".join(map(self.text.__getitem__, numbers[at:stop])))
            at = stop
        n_groups, n_links = (
            np.bincount(owner, np.frombuffer(held, "<i8")[windows], len(texts)).astype(np.int64)
            if len(windows)
            else np.zeros(len(texts), np.int64)
            for held in (self.n_groups.tobytes(), self.n_links.tobytes())
        )
        pairs, n_pairs, times = self._pairs(windows, owner, len(texts))
        counts = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links}
        return counts, group_texts, pairs, n_pairs, times

    def _pairs(self, windows: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each text in ascending order, their number, and the links of each."""
        if not len(windows):
            return np.zeros(0, np.int64), np.zeros(n, np.int64), np.zeros(0, np.int64)
        kinds, kind = np.unique(windows, return_inverse=True)
        once, often = np.unique(owner * len(kinds) + kind, return_counts=True)
        owner, kind = once // len(kinds), once % len(kinds)
        held = [self.pairs[k] for k in kinds.tolist()]
        pairs = np.frombuffer(b"".join(held), "<i8")
        times = np.frombuffer(b"".join([self.times[k] for k in kinds.tolist()]), "<i8")
        size = np.fromiter(map(len, held), np.int64, len(held)) // 8
        begin = np.cumsum(size) - size
        reps = size[kind]
        index = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(begin[kind], reps)
        names, name = np.unique(pairs, return_inverse=True)
        order_key = np.repeat(owner, reps) * len(names) + name[index]
        order = np.argsort(order_key)
        order_key, links = order_key[order], (times[index] * np.repeat(often, reps))[order]
        first = np.flatnonzero(np.diff(order_key, prepend=-1))
        distinct = order_key[first]
        return names[distinct % len(names)], np.bincount(distinct // len(names), minlength=n), np.add.reduceat(links, first)


def listed(side: Side, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Decimal ids of each group, joined by commas."""
    names = list(map(side.names.__getitem__, ids.tolist()))
    stop = np.cumsum(sizes)
    return [names[s] if e - s == 1 else ",".join(names[s:e]) for s, e in zip((stop - sizes).tolist(), stop.tolist())]


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all stretches, one stretch after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def window_keys(
    side_a: tuple[np.ndarray, np.ndarray], side_b: tuple[np.ndarray, np.ndarray], some: np.ndarray
) -> list[bytes]:
    """The ids of each window, side A, BETWEEN, side B."""
    (flat_a, cut_a), (flat_b, cut_b) = side_a, side_b
    size_a, size_b = cut_a[some + 1] - cut_a[some], cut_b[some + 1] - cut_b[some]
    stop = np.cumsum(size_a + 1 + size_b)
    start = stop - (size_a + 1 + size_b)
    ids = np.full(stop[-1] if len(stop) else 0, BETWEEN, "<i4")
    ids[places(start, size_a)] = flat_a[places(cut_a[some], size_a)]
    ids[places(start + size_a + 1, size_b)] = flat_b[places(cut_b[some], size_b)]
    raw = ids.tobytes()
    return [raw[s:e] for s, e in zip((4 * start).tolist(), (4 * stop).tolist())]


def distinct_windows(*sides: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One window of each kind, and which of them each window is. Kinds are told apart by a hash, and
    where any window differs from the one that stands for it, all windows are taken as they are."""
    n = len(sides[0][1]) - 1
    if not n:
        return np.arange(0), np.arange(0)
    key = np.zeros(n, np.uint64)
    for ids, cuts in sides:
        size = np.diff(cuts)
        place = np.arange(len(ids)) - np.repeat(cuts[:-1], size)
        mixed = mix64((ids.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + np.uint64(1))
        key = mix64(key + np.add.reduceat(mixed, cuts[:-1]))
    kinds, which = np.unique(key, return_inverse=True)
    some = np.zeros(len(kinds), np.int64)
    some[which] = np.arange(n)
    for ids, cuts in sides:
        size, stands = np.diff(cuts), some[which]
        if (size != size[stands]).any():
            return np.arange(n), np.arange(n)
        twin = np.arange(len(ids)) + np.repeat(cuts[stands] - cuts[:-1], size)
        if (ids != ids[twin]).any():
            return np.arange(n), np.arange(n)
    return some, which


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """Once in a Python worker, so that windows stay known from task to task."""
    return Aligner(path_a, path_b)


def squeezed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<i4").tobytes())


def unsqueezed(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i4").astype(np.int64)


class Chunk:
    """Aligned documents until there are enough of them for one row."""

    def __init__(self, with_groups: bool):
        self.with_groups = with_groups
        self.size = 0
        self.ids: list[int | None] = []
        self.columns: dict[str, list[np.ndarray]] = {c: [] for c in (*COUNTS, "pairs", "n_pairs", "times")}
        self.digests: list[str] = []
        self.groups: list[str | None] = []

    def add(self, aligning: Aligner, ids: list[int | None], texts: list[str]) -> None:
        counts, groups, pairs, n_pairs, times = aligning.align(texts)
        for name, values in {**counts, "pairs": pairs, "n_pairs": n_pairs, "times": times}.items():
            self.columns[name].append(values)
        self.ids += ids
        self.digests += [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        self.groups += groups if self.with_groups else [None] * len(groups)
        self.size += sum(map(len, texts))

    def row(self, chunk: int) -> pa.RecordBatch:
        flat = {name: np.concatenate(parts) for name, parts in self.columns.items()}
        # Pairs of a document ascend and differ, so a pair's number here is its number of holders.
        pairs, place, holders = np.unique(flat["pairs"], return_inverse=True, return_counts=True)
        steps = np.diff(place, prepend=0)
        values = {
            "chunk": chunk, "pairs": pairs, "holders": holders, "doc_ids": self.ids,
            **{c: flat[c] for c in COUNTS}, "digests": self.digests, "groups": self.groups,
            "n_pairs": flat["n_pairs"], "steps": squeezed(steps), "times": squeezed(flat["times"]),
        }
        return pa.RecordBatch.from_pylist([values], schema=CHUNK_ARROW)


def aligned_chunks(
    docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False
) -> DataFrame:
    """The corpus tokenised and aligned, many documents a row, written once."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligning, number = aligner(a, b), TaskContext.get().partitionId() << 32
        chunk = Chunk(with_groups)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), column_texts(batch.column(1))
            at = size = 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= PIECE_BYTES or i + 1 == len(texts):
                    chunk.add(aligning, ids[at : i + 1], texts[at : i + 1])
                    at, size = i + 1, 0
                if chunk.size >= CHUNK_BYTES:
                    yield chunk.row(number)
                    number, chunk = number + 1, Chunk(with_groups)
        if chunk.ids:
            yield chunk.row(number)

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(read.mapInArrow(run, CHUNK_SCHEMA), "aligned-chunks")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair (A id * 2**32 + B id), n (documents that hold it linked) and best (no other pair of its
    A id has more)."""
    held = chunks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p"))
    counts = held.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.holders").alias("n"))
    counts = stored(counts.withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    # One row an A id: never more than the vocabulary has.
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(
    docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False
) -> DataFrame:
    """Columns of DOC_SCHEMA for every row; `groups` (`a1,a2|b1;a3|b2,b3`) is null unless asked for."""
    chunks = aligned_chunks(docs, a, b, id_col, text_col, with_groups)
    wanted = chunks.select("chunk", F.explode("pairs").alias("pair"))
    # A chunk's pairs come back in the order it has them; a chunk is bounded by its texts.
    found = (
        wanted.join(pair_counts(chunks), "pair")
        .groupBy("chunk")
        .agg(F.sort_array(F.collect_list(F.struct("pair", "n", "best"))).alias("found"))
        .select("chunk", F.transform("found", lambda f: f["n"]).alias("n"), F.transform("found", lambda f: f["best"]).alias("best"))
    )
    rows = chunks.drop("pairs", "holders").join(found, "chunk", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield finished(batch.slice(i, 1))

    return rows.select("doc_ids", *COUNTS, "digests", "groups", "n_pairs", "steps", "times", "n", "best").mapInArrow(
        finish, DOC_SCHEMA
    )


def finished(row: pa.RecordBatch) -> pa.RecordBatch:
    """The documents of one chunk."""
    values = {name: row.column(name).flatten() for name in ("doc_ids", *COUNTS, "digests", "groups", "n_pairs", "n", "best")}
    n_pairs = values["n_pairs"].to_numpy(zero_copy_only=False)
    place = np.cumsum(unsqueezed(row.column("steps")[0].as_py()))
    times = unsqueezed(row.column("times")[0].as_py())
    owner = np.repeat(np.arange(len(n_pairs)), n_pairs)
    n, best = (values[c].to_numpy(zero_copy_only=False) for c in ("n", "best"))
    n_best, count_sum = np.zeros(len(n_pairs), np.int64), np.zeros(len(n_pairs), np.int64)
    if len(place):
        np.add.at(n_best, owner, times * best[place])
        np.add.at(count_sum, owner, times * n[place])
    return pa.RecordBatch.from_arrays(
        [
            values["doc_ids"], *(values[c] for c in COUNTS), pa.array(n_best), pa.array(count_sum),
            values["digests"], values["groups"],
        ],
        names=["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256", "groups"],
    )

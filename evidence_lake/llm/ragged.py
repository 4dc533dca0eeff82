"""Pair merging over ragged numpy arrays: many sequences, one round of merges at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

NO_PAIR = np.int64(1) << np.int64(40)


class PairTable:
    """(left, right) -> (rank, merged symbol), looked up for whole arrays by linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NO_PAIR, np.int64)
        self.merged = np.zeros(1 << self.bits, np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == -1
            _, one_each = np.unique(at[todo[free]], return_index=True)
            put = todo[free][one_each]
            self.keys[at[put]], self.rank[at[put]], self.merged[at[put]] = keys[put], rank[put], merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        scrambled = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (scrambled >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NO_PAIR if none) and slot of each pair; `merged[slot]` is what a pair becomes."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._slot(keys)
        seen = self.keys[at]
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            seen = self.keys[at[open_]]
            open_ = open_[(seen != keys[open_]) & (seen != -1)]
        return self.rank[at], at


def merge(
    symbols: np.ndarray,
    lengths: np.ndarray,
    table: PairTable,
    every: bool = True,
    skip: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Merge all sequences until none has a pair left; returns their symbols and lengths.

    Each round takes every sequence's lowest-ranked pair at once. every=True merges all its
    occurrences, left to right; every=False only the leftmost, as an agenda would pop it.
    skip(sequence, left start, right start, slot) says which popped candidates are thrown away
    instead; positions count first-round symbols from the start of the sequence.
    """
    lengths = lengths.astype(np.int64)
    done_symbols: list[np.ndarray] = []
    done_owner: list[np.ndarray] = []
    owner_ids = np.flatnonzero(lengths > 0)
    sym, size = symbols.astype(np.int64), lengths[owner_ids]
    seq = np.repeat(np.arange(len(size)), size)
    start = np.cumsum(size) - size
    pos = np.arange(len(sym)) - start[seq]
    rank, slot = _pairs(sym, seq, table)
    while len(sym):
        best = np.minimum.reduceat(rank, start)
        finished = best >= NO_PAIR
        if finished.any():
            out = finished[seq]
            done_symbols.append(sym[out])
            done_owner.append(owner_ids[seq[out]])
            stay = ~out
            sym, pos, rank, slot = sym[stay], pos[stay], rank[stay], slot[stay]
            size, owner_ids, best = size[~finished], owner_ids[~finished], best[~finished]
            seq = np.repeat(np.arange(len(size)), size)
            start = np.cumsum(size) - size
            if not len(sym):
                break
        hits = np.flatnonzero(rank == best[seq])
        if every:
            hits = _without_overlap(hits)
        else:
            first = np.ones(len(hits), bool)
            first[1:] = seq[hits[1:]] != seq[hits[:-1]]
            hits = hits[first]
        if skip is not None:
            thrown = skip(owner_ids[seq[hits]], pos[hits], pos[hits + 1], slot[hits])
            rank[hits[thrown]] = NO_PAIR
            hits = hits[~thrown]
            if not len(hits):
                continue
        sym[hits] = table.merged[slot[hits]]
        stay = np.ones(len(sym), bool)
        stay[hits + 1] = False
        size = size - np.bincount(seq[hits], minlength=len(size))
        before = np.flatnonzero(stay)
        index = np.cumsum(stay) - 1
        sym, pos, seq, rank, slot = sym[before], pos[before], seq[before], rank[before], slot[before]
        at = index[hits]
        start = np.cumsum(size) - size
        # Pairs change where a merge stands and to the left of it.
        stale = np.zeros(len(sym), bool)
        stale[at] = True
        stale[at[at > 0] - 1] = True
        redo = np.flatnonzero(stale)
        inner = redo[(redo + 1 < len(sym))]
        inner = inner[seq[inner] == seq[inner + 1]]
        rank[redo] = NO_PAIR
        rank[inner], slot[inner] = table.find(sym[inner], sym[inner + 1])
    result_lengths = np.zeros(len(lengths), np.int64)
    if not done_symbols:
        return np.zeros(0, np.int64), result_lengths
    owners, out = np.concatenate(done_owner), np.concatenate(done_symbols)
    order = np.argsort(owners, kind="stable")
    return out[order], np.bincount(owners, minlength=len(lengths))


def _pairs(sym: np.ndarray, seq: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    rank = np.full(len(sym), NO_PAIR, np.int64)
    slot = np.zeros(len(sym), np.int64)
    inner = np.flatnonzero(seq[:-1] == seq[1:])
    rank[inner], slot[inner] = table.find(sym[inner], sym[inner + 1])
    return rank, slot


def _without_overlap(hits: np.ndarray) -> np.ndarray:
    """Of candidates at neighbouring places, as in a run of one symbol, every other one."""
    if len(hits) < 2:
        return hits
    begins = np.ones(len(hits), bool)
    begins[1:] = hits[1:] != hits[:-1] + 1
    run = np.maximum.accumulate(np.where(begins, np.arange(len(hits)), 0))
    return hits[(np.arange(len(hits)) - run) % 2 == 0]

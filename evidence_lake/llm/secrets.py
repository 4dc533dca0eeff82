"""Secret scan by grammar inference.

Fixed patterns find credentials; their values are the labelled examples. For each kind the prefix
tree of a sample is folded into a probabilistic automaton: states whose outgoing frequencies agree
within a Hoeffding bound, and whose successors do, become one (red-blue merging). An automaton of
ordinary words is inferred in the same way. Every other candidate of a text, a run of credential
characters, is scored by how much likelier a credential's format makes it than an ordinary word's,
and those beyond a limit are added as spans of kind `format`.

One scan of the texts writes spans and candidates to a table; inference and scoring read only that.
Inference uses a bounded sample: of each kind the SAMPLE different values, and of ordinary words
BACKGROUND ones with a digit and as many of all, of the smallest hashes, up to MAX_VALUE characters long. Scoring covers all
candidates, whatever their length.

Defined cases: a null or empty text has no spans; a null id stays null; repeated rows are scanned
each; other columns are not read. Without any example of a kind nothing is added for it.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log2, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_texts, small_batches, stored

KINDS = ("assign", "access", "hex", "format")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of hexadecimal digits is matched as a whole, so shorter runs need not be found first.
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
MIN_ASSIGN, MIN_ACCESS = 8, 16

SAMPLE, BACKGROUND, MAX_VALUE = 300, 1000, 128
ALPHA = 0.05
MIN_BITS, MIN_BITS_A_CHARACTER = 24.0, 2.0
UNSEEN = 1e-4
UNSEEN_BITS = -log2(UNSEEN)
MIXED = 0.1

SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(SPAN)), ("others", pa.list_(SPAN))])
FOUND_SCHEMA = (
    "doc_id BIGINT, base ARRAY<STRUCT<kind: INT, start: INT, end: INT, value: STRING>>, "
    "others ARRAY<STRUCT<kind: INT, start: INT, end: INT, value: STRING>>"
)
RESULT_SCHEMA = (
    "doc_id BIGINT, n_assign BIGINT, n_access BIGINT, n_hex BIGINT, base_sha256 STRING, "
    "spans STRING, n_format BIGINT"
)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the fixed patterns, by start, then kind."""
    found = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= MIN_ASSIGN:
                found.append((0, m.start(), m.end(), m[2]))
    for m in ACCESS.finditer(text):
        if len(m[0]) >= MIN_ACCESS:
            found.append((1, m.start(), m.end(), m[0]))
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def other_candidates(text: str, base: list[tuple]) -> list[tuple[int, int, int, str]]:
    """Runs of credential characters that overlap no span of `base`."""
    found, ahead, until = [], 0, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while ahead < len(base) and base[ahead][1] < end:
            until = max(until, base[ahead][2])
            ahead += 1
        if start >= until:
            found.append((3, start, end, m[0]))
    return found


def _rows(spans: list[tuple]) -> list[dict]:
    return [{"kind": k, "start": s, "end": e, "value": v} for k, s, e, v in spans]


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base spans and other candidates of every row."""
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column_texts(batch.column(1))
            base = [base_spans(t) for t in texts]
            others = [other_candidates(t, b) for t, b in zip(texts, base)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(map(_rows, base), FOUND_ARROW.field("base").type),
                    pa.array(map(_rows, others), FOUND_ARROW.field("others").type),
                ],
                schema=FOUND_ARROW,
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(scan, FOUND_SCHEMA), "secret-candidates")


@dataclass(frozen=True)
class Automaton:
    """Probabilistic automaton: state -> character -> (next state, bits), and bits to stop."""

    moves: tuple[dict[str, tuple[int, float]], ...]
    stops: tuple[float, ...]
    anywhere: dict[str, float]

    def bits(self, text: str) -> float:
        """Minus log2 of the likelihood. A character not seen in a state costs what it costs
        anywhere, or UNSEEN, and leaves the state as it is."""
        state, total = 0, 0.0
        for character in text:
            if character in self.moves[state]:
                state, cost = self.moves[state][character]
            else:
                cost = self.anywhere.get(character, UNSEEN_BITS)
            total += cost
        return total + self.stops[state]


class PrefixTree:
    """Counts of a sample's prefixes, merged in place until no two compatible states are left."""

    def __init__(self, values: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.arrive, self.stop = [0], [0]
        for value in values:
            at = 0
            self.arrive[0] += 1
            for character in value:
                if character not in self.next[at]:
                    self.next[at][character] = len(self.next)
                    self.next.append({})
                    self.arrive.append(0)
                    self.stop.append(0)
                at = self.next[at][character]
                self.arrive[at] += 1
            self.stop[at] += 1

    @staticmethod
    def differ(hits: int, of: int, others: int, of_others: int) -> bool:
        bound = sqrt(0.5 * log(2 / ALPHA)) * (1 / sqrt(of) + 1 / sqrt(of_others))
        return abs(hits / of - others / of_others) > bound

    def compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.arrive[a], self.arrive[b]
            if not n or not m:
                continue
            if self.differ(self.stop[a], n, self.stop[b], m):
                return False
            for character in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(character), self.next[b].get(character)
                if self.differ(self.arrive[x] if x is not None else 0, n, self.arrive[y] if y is not None else 0, m):
                    return False
                # A state that stands on both sides agrees with itself.
                if x is not None and y is not None and x != y:
                    todo.append((x, y))
        return True

    def fold(self, into: int, state: int) -> None:
        todo = [(into, state)]
        while todo:
            into, state = todo.pop()
            self.arrive[into] += self.arrive[state]
            self.stop[into] += self.stop[state]
            for character, child in self.next[state].items():
                there = self.next[into].get(character)
                if there is None:
                    self.next[into][character] = child
                elif there != child:
                    todo.append((there, child))

    def merged(self) -> list[dict[str, int]]:
        """States that are left, each with its successors; the first is the start."""
        red, blue = [0], sorted(self.next[0].items())
        blue = [(0, c, s) for c, s in blue]
        while blue:
            blue.sort(key=lambda b: (-self.arrive[b[2]], b[0], b[1]))
            parent, character, state = blue.pop(0)
            if self.next[parent].get(character) != state:
                continue
            for r in red:
                if self.compatible(r, state):
                    self.next[parent][character] = r
                    self.fold(r, state)
                    break
            else:
                red.append(state)
            members = set(red)
            blue = [(r, c, s) for r in red for c, s in self.next[r].items() if s not in members]
        number = {s: i for i, s in enumerate(red)}
        return [{c: number[s] for c, s in self.next[r].items()} for r in red]


def infer(values: list[str]) -> Automaton:
    """The merged states, with frequencies counted by running every value from the start.

    How often a character stands anywhere is mixed in, as a sample shows only a part of what
    there is.
    """
    states = PrefixTree(values).merged()
    flows, stops = [Counter() for _ in states], [0] * len(states)
    for value in values:
        state = 0
        for character in value:
            flows[state][character] += 1
            state = states[state][character]
        stops[state] += 1
    every = sum(flows, Counter())
    size = sum(every.values()) + 1
    share = {c: n / size for c, n in every.items()}
    moves, ends = [], []
    for flow, stop, to in zip(flows, stops, states):
        total = flow.total() + stop + 1
        cost = {c: -log2(max(UNSEEN, (1 - MIXED) * flow[c] / total + MIXED * share[c])) for c in to}
        moves.append({c: (state, cost[c]) for c, state in to.items()})
        ends.append(-log2(max(UNSEEN, stop / total)))
    anywhere = {c: -log2(max(UNSEEN, MIXED * p)) for c, p in share.items()}
    return Automaton(tuple(moves), tuple(ends), anywhere)


@dataclass(frozen=True)
class FormatModel:
    formats: tuple[Automaton, ...]
    background: Automaton

    def gain(self, value: str) -> float:
        """Bits by which the likeliest credential format beats ordinary words."""
        if not self.formats:
            return float("-inf")
        return self.background.bits(value) - min(a.bits(value) for a in self.formats)

    def accepts(self, value: str) -> bool:
        return self.gain(value) >= max(MIN_BITS, MIN_BITS_A_CHARACTER * len(value))


def train_formats(found: DataFrame) -> FormatModel:
    def values(column: str, kind: int, bound: int, like: str = "") -> list[str]:
        rows = (
            found.select(F.explode(column).alias("s"))
            .where((F.col("s.kind") == kind) & (F.length("s.value") <= MAX_VALUE) & F.col("s.value").rlike(like))
            .select("s.value")
            .distinct()
            .orderBy(F.xxhash64("value"), "value")
            .limit(bound)
        )
        return [r.value for r in rows.collect()]

    examples = [values("base", kind, SAMPLE) for kind in range(3)]
    # Numbers and addresses are rare among words, but nearest to credentials.
    ordinary = sorted({*values("others", 3, BACKGROUND), *values("others", 3, BACKGROUND, "[0-9]")})
    return FormatModel(tuple(infer(v) for v in examples if v), infer(ordinary))


def score_spans(found: DataFrame, model: FormatModel) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, bool] = {}
        for batch in batches:
            rows = []
            if len(seen) > 200_000:
                seen.clear()
            for row in batch.to_pylist():
                base, added = row["base"], []
                for span in row["others"]:
                    value = span["value"]
                    if value not in seen:
                        seen[value] = model.accepts(value)
                    if seen[value]:
                        added.append(span)
                spans = sorted(base + added, key=lambda s: (s["start"], s["kind"]))
                say = lambda part: ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in part)
                kinds = [s["kind"] for s in base]
                rows.append(
                    {
                        "doc_id": row["doc_id"],
                        "n_assign": kinds.count(0),
                        "n_access": kinds.count(1),
                        "n_hex": kinds.count(2),
                        "base_sha256": hashlib.sha256(say(base).encode()).hexdigest(),
                        "spans": say(spans),
                        "n_format": len(added),
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=RESULT_ARROW)

    return found.mapInArrow(score, RESULT_SCHEMA)


RESULT_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
        ("base_sha256", pa.string()), ("spans", pa.string()), ("n_format", pa.int64()),
    ]
)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = find_spans(docs, id_col, text_col)
    return score_spans(found, train_formats(found))

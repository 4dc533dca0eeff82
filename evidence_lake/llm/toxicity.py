"""Toxicity: a support vector machine over a gapped-subsequence string kernel with Nyström landmarks.

The kernel of two words sums over the subsequences of three characters they share, each weighed by
DECAY to the length it spans (at most SPAN), and is normalised. Inserted characters lengthen a span
and lower a weight, but no subsequence is lost. Landmarks are words; a word's features are its
kernels with them, whitened. The machine is linear in these features, so its decision is also
linear in the landmarks' subsequences: `SubsequenceModel.table` holds that sum exactly, and scoring
a word costs as much as listing its subsequences, whatever the number of landmarks.

Sentences carry no labels of their own. A sentence of a document labelled clean is clean; of one
labelled toxic, the sentence with the witness, its word of the largest margin, is toxic (labels
and machine are found in turns). A text is scored by its three worst words, through a logistic curve fitted on
labelled documents the machine has not seen.

Learning reads a bounded sample: at most MAX_LABELLED learnable documents of either label, those
with the smallest hash of their id. Everything else covers all rows and whole texts.

Defined cases: a null or empty text has no word and takes the margins of the mildest words; a null id
is held out and keeps its row; repeated rows score alike; other columns are not read. Without labels
of both kinds every score is 0, or 1 if all labels are toxic.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_texts, learnable, small_batches

MAX_LABELLED = 3_000
LANDMARKS = 384
SPAN = 7
DECAY = 0.6
MAX_UNIT = 24
ROUNDS = 4
STRONG = 0.25
EXPLAINED = 3
CLASSES = 64
MEMORY_WORDS = 500_000
SCORE_SCHEMA = "doc_id BIGINT, score DOUBLE"

# Second and third character of a subsequence, counted from its first.
OFFSETS = [(a, b) for a in range(1, SPAN - 1) for b in range(a + 1, SPAN)]
WEIGHTS = np.array([DECAY ** (b + 1) for _, b in OFFSETS])
START, END = CLASSES - 1, CLASSES - 2
TOP = 3
SPELLED = re.compile(r"(?<!\S)(?:\S ){3,}\S(?!\S)")


def character_classes() -> np.ndarray:
    """Class of each character of the basic plane: a letter of a-z, a digit, or one of 25 others."""
    table = 37 + np.arange(1 << 16) % 25
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[ord("0") : ord("9") + 1] = np.arange(27, 37)
    return table.astype(np.int64)


CLASS_OF = character_classes()


def words_of(text: str) -> list[str]:
    """Lower-cased words; words spelt out with blanks are put together."""
    text = text.lower()
    if SPELLED.search(text):
        text += " " + " ".join(m.replace(" ", "") for m in SPELLED.findall(text))
    return text.split()


def units(word: str) -> list[str]:
    """A word without the punctuation around it, as it is and without inner signs; long ones in
    overlapping windows."""
    word = word.strip(".,;:!?()[]\"'|") or word
    forms = [word]
    if not word.isalnum() and (plain := "".join(filter(str.isalnum, word))):
        forms.append(plain)
    if len(word) <= MAX_UNIT:
        return forms
    half = MAX_UNIT // 2
    return [form[i : i + MAX_UNIT] for form in forms for i in range(0, max(1, len(form) - half), half)]


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of one length at a time: their places, and codes and weights of all subsequences."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths[lengths > 0]).tolist():
        for at in np.array_split(np.flatnonzero(lengths == length), 1 + int((lengths == length).sum()) // 8192):
            codes = np.full((len(at), length + 2), START, np.int64)
            codes[:, -1] = END
            codes[:, 1:-1] = CLASS_OF[points[starts[at, None] + np.arange(length)] & 0xFFFF]
            parts, weights = [], []
            for (a, b), weight in zip(OFFSETS, WEIGHTS):
                if b <= length + 1:
                    n = length + 2 - b
                    parts.append((codes[:, :n] * CLASSES + codes[:, a : a + n]) * CLASSES + codes[:, b : b + n])
                    weights.append(np.full(n, weight))
            if parts:
                yield at, np.concatenate(parts, axis=1), np.concatenate(weights)


def norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Root of each word's kernel with itself: like subsequences are summed before squaring."""
    order = np.argsort(codes, axis=1, kind="stable")
    sorted_codes = np.take_along_axis(codes, order, axis=1)
    sums = np.cumsum(weights[order], axis=1)
    last = np.ones(codes.shape, bool)
    last[:, :-1] = sorted_codes[:, 1:] != sorted_codes[:, :-1]
    rows = np.nonzero(last)[0]
    ends = sums[last]
    each = np.diff(ends, prepend=0.0)
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    each[first] = ends[first]
    return np.sqrt(np.bincount(rows, each**2, len(codes)))


@dataclass(frozen=True)
class SubsequenceModel:
    """margin(word) = subsequences . table / norm + bias; score = curve of the TOP largest margins."""

    table: np.ndarray
    bias: float
    slopes: tuple[float, ...]
    shift: float

    def margins(self, words: list[str]) -> np.ndarray:
        parts = [units(w) for w in words]
        flat = [u for p in parts for u in p]
        values = np.full(len(flat), min(0.0, self.bias))
        for at, codes, weights in subsequences(flat):
            values[at] = self.table[codes] @ weights / norms(codes, weights) + self.bias
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.maximum.reduceat(values, np.cumsum(counts) - counts) if len(flat) else np.zeros(0)

    def worst(self, margins: Iterable[float]) -> list[float]:
        """The TOP largest margins of a text's different words; the mildest where there are fewer."""
        top = heapq.nlargest(TOP, margins)
        return top + [min(0.0, self.bias)] * (TOP - len(top))

    def scores(self, worst: np.ndarray) -> np.ndarray:
        z = np.clip(worst.reshape(-1, TOP), -2, 2) @ np.array(self.slopes) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class Landmarks:
    """Kernels of words with the landmarks, and the whitening that makes features of them."""

    def __init__(self, words: list[str]):
        self.words = words
        codes_of = np.zeros(CLASSES**3, np.int32)
        entries = []
        for at, codes, weights in subsequences(words):
            scale = norms(codes, weights)
            entries.append((np.repeat(at, codes.shape[1]), codes.ravel(), (weights / scale[:, None]).ravel()))
        owner, code, value = (np.concatenate(p) for p in zip(*entries))
        self.codes = np.unique(code)
        codes_of[self.codes] = np.arange(1, len(self.codes) + 1)
        self.codes_of = codes_of
        self.rows = np.zeros((len(self.codes) + 1, len(words)))
        np.add.at(self.rows, (codes_of[code], owner), value)
        values, vectors = np.linalg.eigh(self.kernel(words))
        keep = values > 1e-6 * values.max()
        self.whiten = vectors[:, keep] / np.sqrt(values[keep])

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)))
        for at, codes, weights in subsequences(words):
            scale = norms(codes, weights)
            for i in range(0, len(at), 512):
                rows = self.rows[self.codes_of[codes[i : i + 512]]]
                out[at[i : i + 512]] = np.einsum("nfl,f->nl", rows, weights) / scale[i : i + 512, None]
        return out

    def features(self, words: list[str]) -> np.ndarray:
        return self.kernel(words) @ self.whiten

    def table(self, plane: np.ndarray) -> np.ndarray:
        """The decision as one weight for each subsequence."""
        return (self.rows @ (self.whiten @ plane))[self.codes_of]


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """Plane and bias of a support vector machine with squared hinge loss, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([1.0] * x.shape[1] + [1e-3])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        short = 1 - y * (a @ w)
        active = short > 0
        b = a[active] * weight[active, None]
        new = np.linalg.solve(ridge + cost * b.T @ a[active], cost * b.T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def document_weights(bags: list[set[str]]) -> np.ndarray:
    """Documents with the same words are copies of each other, and share one weight."""
    keys = [tuple(sorted(bag)) for bag in bags]
    sizes = Counter(keys)
    return np.array([1 / sizes[k] for k in keys])


def witnesses(toxic: list[set[str]], clean: Counter) -> list[str]:
    """Words that accuse toxic documents. Strong ones, with STRONG of the best word's evidence (documents
    by weight, less twice the clean ones), count each by itself, so an insult that always comes with
    others is found. Of weaker ones only those are taken that explain documents not yet explained
    EXPLAINED times, best first."""
    weight = document_weights(toxic)
    least = max(min(2.0, weight.sum() / 2), 0.002 * weight.sum())
    holders = defaultdict(list)
    for i, words in enumerate(toxic):
        for w in words:
            holders[w].append(i)
    gain = {w: weight[h].sum() - 2 * clean[w] for w, h in holders.items()}
    gain = {w: g for w, g in gain.items() if g >= least}
    strong = STRONG * max(gain.values(), default=0.0)
    times, chosen = np.zeros(len(toxic), int), sorted((w for w in gain if gain[w] >= strong), key=lambda w: (-gain[w], w))
    for word in chosen:
        times[holders[word]] += 1
    heap = [(-g, w) for w, g in gain.items() if g < strong]
    heapq.heapify(heap)
    while heap:
        promised, word = heapq.heappop(heap)
        held = np.array(holders[word])
        left = weight[held[times[held] < EXPLAINED]].sum() - 2 * clean[word]
        if left < least:
            continue
        if left < -promised - 1e-9:
            heapq.heappush(heap, (-left, word))
            continue
        chosen.append(word)
        times[held] += 1
    return chosen


def disguised(words: list[str], rng: np.random.Generator) -> list[str]:
    """Each word with a character put in, and with one taken for another sign."""
    out = []
    for word in words:
        at, sign = int(rng.integers(1, max(2, len(word)))), "abcdefghijklmnopqrstuvwxyz0123456789"[rng.integers(36)]
        out += [word[:at] + sign + word[at:], word[:at] + word[at - 1] + word[at:]]
    return out


def fit_toxicity(texts: list[str], labels: np.ndarray) -> SubsequenceModel:
    labels = np.asarray(labels)
    if len(labels) == 0 or labels.min() == labels.max():
        toxic = len(labels) > 0 and labels.min() == 1
        return SubsequenceModel(np.zeros(CLASSES**3), 0.0, (0.0,) * TOP, 50.0 if toxic else -50.0)
    bags = [sorted({u for w in words_of(t) for u in units(w) if len(u) > 2}) for t in texts]
    # A third of the sample only serves the curve, so that it does not judge what it has seen.
    fit = np.arange(len(bags)) % 3 != 0
    if len(set(labels[fit])) < 2:
        fit[:] = True
    toxic = [set(b) for b, y, f in zip(bags, labels, fit) if y == 1 and f]
    clean = Counter(u for b, y, f in zip(bags, labels, fit) if y == 0 and f for u in b)
    found = witnesses(toxic, clean)
    rng = np.random.default_rng(11)
    clean_words = np.array(sorted(clean), dtype=object)
    common = [w for w, _ in clean.most_common(1000)]
    some = rng.choice(clean_words, min(4000, len(clean_words)), replace=False).tolist()
    positive, negative = list(found), sorted({*common, *some} - set(found))
    model = None
    for _ in range(ROUNDS):
        half = LANDMARKS // 2
        picked = positive[:half] + [negative[i] for i in rng.permutation(len(negative))[:half]]
        marks = Landmarks(picked or ["none"])
        seen = positive + [w for w in disguised(positive, rng) if not clean[w]]
        words = seen + negative
        y = np.array([1.0] * len(seen) + [-1.0] * len(negative))
        share = np.where(y > 0, len(y) / (2 * max(1, len(seen))), len(y) / (2 * max(1, len(negative))))
        plane, bias = fit_svm(marks.features(words), y, share)
        model = SubsequenceModel(marks.table(plane).astype(np.float32), bias, (0.0,) * TOP, 0.0)
        # Clean words nearest to the toxic side become examples and landmarks of the next round.
        margins = model.margins(clean_words.tolist()) if len(clean_words) else np.zeros(0)
        hard = clean_words[np.argsort(-margins)[:1500]].tolist()
        negative = list(dict.fromkeys(hard + negative))
        # So do the words by which toxic documents are known now.
        for bag in toxic:
            words = sorted(bag)
            best = words[int(model.margins(words).argmax())] if words else None
            if best is not None and not clean[best] and best not in positive:
                positive.append(best)
    worst = np.array([model.worst(model.margins(b).tolist()) for b in bags])
    judge = ~fit if len(set(labels[~fit])) == 2 else fit
    slopes, shift = fit_curve(np.clip(worst[judge], -2, 2), labels[judge])
    return SubsequenceModel(model.table, model.bias, slopes, shift)


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Logistic curve with softened targets, by damped Newton steps; never falling."""
    positive, negative = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    used = np.ones(len(w), bool)
    for _ in range(100):
        b = a[:, used]
        p = 1 / (1 + np.exp(-(b @ w[used])))
        hess = (b * (p * (1 - p))[:, None]).T @ b + 1e-3 * np.eye(b.shape[1])
        step = np.linalg.solve(hess, b.T @ (target - p) - 1e-3 * w[used])
        w[used] += step / max(1.0, np.abs(step).max())
        used[:-1] &= ~((w[:-1] < 0) & (np.abs(step).max() < 1e-3))
        w[~used] = 0.0
    return tuple(np.maximum(w[:-1], 0.0).tolist()), float(w[-1])


class KnownMargins(dict):
    """Margins of words seen before; forgotten as a whole once there are too many."""

    def learn(self, model: SubsequenceModel, words: Iterable[str]) -> None:
        if len(self) > MEMORY_WORDS:
            self.clear()
        new = [w for w in words if w not in self]
        self.update(zip(new, model.margins(new).tolist()))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """At most `bound` learnable documents of either label, those of the smallest id hash."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learnable(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("label"))
    )
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    one, other = (known.where(F.col("label") == v).orderBy(*order).limit(bound) for v in (1, 0))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(one.unionByName(other)), "doc_id")


def train_toxicity(docs: DataFrame, labels: DataFrame) -> SubsequenceModel:
    small_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels).orderBy(F.xxhash64("doc_id"), "doc_id", "text").toPandas()
    return fit_toxicity(rows["text"].tolist(), rows["label"].to_numpy())


def score_toxicity(
    docs: DataFrame, model: SubsequenceModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; no shuffle."""
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KnownMargins()
        for batch in batches:
            bags = [set(words_of(t)) for t in column_texts(batch.column(1))]
            known.learn(model, set().union(*bags))
            worst = np.array([model.worst(map(known.__getitem__, bag)) for bag in bags])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.scores(worst))], names=["doc_id", "score"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, SCORE_SCHEMA).select(
        "doc_id",
        F.coalesce(~learnable(F.col("doc_id")), F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Shallow boosted trees are grown on labelled rows; every path from a root is a rule, a conjunction of
bounds on statistics. A lasso logistic regression weighs the rules and sets most weights to zero.
What is left becomes one Spark column expression, so that scoring is a scan without Python.

Learning reads a bounded sample: at most MAX_LABELLED rows whose id may be learnt from, those with
the smallest hash of their id. Everything else covers all rows.

Defined cases: a null or empty text has statistics of 0 and gets a score like any other; a null id
is held out (nothing is learnt from it) and keeps its row; repeated rows score alike; other columns
are not read, and pass through on demand; names that start with `_q` are reserved. Without labels of both kinds every score is the share of good labels, or 1 if there
are none.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import learnable, stored

MAX_LABELLED = 20_000
TREES = 40
DEPTH = 3
SHRINK = 0.3
LEAF_ROWS = 8
LASSO = 0.002
THRESHOLD = 0.3

# Statistics: name -> Spark expression over `text` (not null) or over statistics named before it.
COUNTS = {
    "chars": "cast(char_length(text) as double)",
    "words": "cast(size(split(trim(text), '[ \\n]+')) as double)",
    "lines": "cast(char_length(text) - char_length(replace(text, '\\n', '')) + 1 as double)",
    "upper": "cast(char_length(regexp_replace(text, '[^\\\\p{Lu}]+', '')) as double)",
    "letters": "cast(char_length(regexp_replace(text, '[^\\\\p{L}]+', '')) as double)",
    "digits": "cast(char_length(regexp_replace(text, '[^0-9]+', '')) as double)",
    "marks": "cast(char_length(regexp_replace(text, '[\\\\p{L}0-9\\\\s.,]+', '')) as double)",
    "stops": "cast(char_length(text) - char_length(replace(replace(text, '.', ''), ',', '')) as double)",
    "bangs": "cast(char_length(text) - char_length(replace(text, '!', '')) as double)",
    "bars": "cast(char_length(text) - char_length(replace(text, '|', '')) as double)",
    "distinct": "cast(size(array_distinct(split(trim(text), '[ \\n]+'))) as double)",
    "repeats": "cast(char_length(text) - char_length(regexp_replace(text, '(?<!\\\\S)(\\\\S++) (?=\\\\1(?:\\\\s|$))', '')) as double)",
}
RATIOS = {
    "chars": "chars",
    "words": "words",
    "word_length": "chars / words",
    "line_words": "words / lines",
    "upper_share": "upper / greatest(letters, 1)",
    "letter_share": "letters / greatest(chars, 1)",
    "digit_share": "digits / greatest(chars, 1)",
    "mark_share": "marks / greatest(chars, 1)",
    "mark_words": "marks / words",
    "stop_words": "stops / words",
    "bang_words": "bangs / words",
    "bar_words": "bars / words",
    "distinct_share": "distinct / words",
    "repeat_share": "repeats / greatest(chars, 1)",
}


def with_statistics(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The columns `keep` and one column for each statistic, `_q_` and its name."""
    named = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_q_text"))
    counts = named.select(
        *keep, *(F.expr(e.replace("(text", "(_q_text")).alias(f"_qc_{n}") for n, e in COUNTS.items())
    )

    def ratio(expression: str) -> Column:
        words = [f"_qc_{w}" if w in COUNTS else w for w in expression.replace("(", " ( ").replace(",", " , ").split()]
        return F.expr(" ".join(words))

    return counts.select(*keep, *(ratio(e).alias(f"_q_{n}") for n, e in RATIOS.items()))


FEATURES = tuple(f"_q_{n}" for n in RATIOS)


@dataclass(frozen=True)
class Rule:
    """All of the bounds hold: (feature, above, limit) means value > limit, or value <= limit."""

    bounds: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        result = np.ones(len(x), bool)
        for feature, above, limit in self.bounds:
            result &= (x[:, feature] > limit) == above
        return result

    def column(self) -> Column:
        result = F.lit(True)
        for feature, above, limit in self.bounds:
            value = F.col(FEATURES[feature])
            result = result & (value > limit if above else value <= limit)
        return result


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in zip(self.rules, self.weights):
            z += weight * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        z = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            z = z + F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def _best_split(x: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, float] | None:
    """Feature and limit of the largest gain, by Newton sums over sorted values."""
    best, found = 1e-6, None
    total_g, total_h = grad.sum(), hess.sum() + 1
    for feature in range(x.shape[1]):
        order = np.argsort(x[:, feature], kind="stable")
        values = x[order, feature]
        g, h = np.cumsum(grad[order])[:-1], np.cumsum(hess[order])[:-1]
        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h) - total_g**2 / total_h
        here = (values[1:] > values[:-1]) & (np.arange(1, len(x)) >= LEAF_ROWS)
        here &= np.arange(1, len(x)) <= len(x) - LEAF_ROWS
        if here.any() and (top := np.where(here, gain, -1).argmax()) >= 0 and gain[top] > best and here[top]:
            best, found = gain[top], (feature, float((values[top] + values[top + 1]) / 2))
    return found


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Every path of boosted trees, once."""
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[tuple, Rule] = {}
    rng = np.random.default_rng(7)

    def grow(rows: np.ndarray, bounds: tuple, grad: np.ndarray, hess: np.ndarray) -> None:
        split = None
        if len(bounds) < DEPTH and len(rows) >= 2 * LEAF_ROWS:
            split = _best_split(x[rows], grad[rows], hess[rows])
        if bounds:
            rules.setdefault(bounds, Rule(bounds))
        if split is None:
            score[rows] += SHRINK * grad[rows].sum() / (hess[rows].sum() + 1)
            return
        feature, limit = split
        above = x[rows, feature] > limit
        grow(rows[above], bounds + ((feature, True, limit),), grad, hess)
        grow(rows[~above], bounds + ((feature, False, limit),), grad, hess)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        rows = np.sort(rng.permutation(len(y))[: max(2 * LEAF_ROWS, len(y) * 3 // 4)])
        grow(rows, (), y - p, p * (1 - p))
    return list(rules.values())


def lasso(holds: np.ndarray, y: np.ndarray, strength: float = LASSO, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of an L1 logistic regression, by accelerated proximal gradient."""
    a = np.hstack([holds, np.ones((len(y), 1))]).astype(np.float64)
    probe = np.ones(a.shape[1])
    for _ in range(20):
        probe = a.T @ (a @ probe)
        probe /= np.linalg.norm(probe)
    step = 4 * len(y) / max(1e-9, float(probe @ (a.T @ (a @ probe)))) * 0.95
    w = np.zeros(a.shape[1])
    ahead, momentum = w, 1.0
    for _ in range(steps):
        slope = a.T @ (1 / (1 + np.exp(-(a @ ahead))) - y) / len(y)
        new = ahead - step * slope
        new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - step * strength)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        return RuleModel((), (), 30.0 if share == 1 else -30.0)
    rules = tree_rules(x, y)
    weights, bias = lasso(np.stack([r.holds(x) for r in rules], axis=1), y) if rules else (np.zeros(0), 0.0)
    if not rules:
        bias = float(np.log(y.mean() / (1 - y.mean())))
    used = np.flatnonzero(weights)
    return RuleModel(tuple(rules[i] for i in used), tuple(float(weights[i]) for i in used), bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int = MAX_LABELLED) -> DataFrame:
    """At most `bound` labelled texts to learn from: those with the smallest hash of their id."""
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learnable(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def train_quality(docs: DataFrame, labels: DataFrame) -> RuleModel:
    sample = with_statistics(labelled_sample(docs, labels, "quality"), keep=("doc_id", "label"))
    rows = stored(sample, "quality-sample").orderBy("doc_id", *FEATURES).toPandas()
    return fit_rules(rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy(float))


def score_quality(
    docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD, keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The columns `keep` of every row of docs, with _q_score and _q_predicted; no shuffle."""
    scored = with_statistics(docs, keep=keep).select(*keep, model.column().alias("_q_score"))
    return scored.withColumn("_q_predicted", (F.col("_q_score") >= threshold).cast("int"))

"""Quality classification by a sparse rule ensemble.

Statistics of each text feed shallow boosted trees, fitted on a bounded sample of labelled rows. Every path from a root
to a node below it is a rule: a conjunction of bounds on statistics. Logistic weights of all rules and of the scaled
statistics are fitted with a lasso penalty, which leaves few of them, and the strength of the penalty is chosen on a part
of the sample. The rules that stay are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder

SAMPLE_ROWS = 20_000  # labelled rows that the ensemble is fitted on at most
TREES = 40
DEPTH = 3
BINS = 32
RATE = 0.3
SEED = 3
THRESHOLD = 0.7

STATISTICS = (
    "log_chars", "log_words", "word_length", "longest_word", "letters", "digits", "upper", "blanks", "stops", "commas", "exclaims", "symbols", "bars", "other_marks",
    "distinct_words", "top_word", "same_neighbours", "distinct_pairs", "repeated_lines", "words_per_line", "words_per_stop", "capital_words", "entropy", "non_ascii",
)
_MARK_WORD = re.compile(r"[#$%&*|!~^=<>{}\\/@]{2,}")


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a text, in the order of ``STATISTICS``; an empty or null text has zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    n = len(raw)
    words = text.split()
    k = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    p = counts[counts > 0] / n
    share = lambda chars: float(sum(counts[ord(c)] for c in chars)) / n
    letters = float(counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()) / n
    stops = share(".")
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log1p(n), math.log1p(len(words)), n / k, float(max(map(len, words), default=0)), letters, float(counts[48:58].sum()) / n, float(counts[65:91].sum()) / n,
        share(" \n\t\r"), stops, share(",;:"), share("!?"), share("#$%&*~^=<>{}\\/@"), share("|"), len(_MARK_WORD.findall(text)) / k,
        len(seen) / k, max(seen.values(), default=0) / k, same / k, (pairs + 1) / k, 1.0 - len(set(lines)) / max(1, len(lines)), k / max(1, len(lines)),
        k / (1.0 + counts[46]), sum(w[0].isupper() for w in words) / k, float(-(p * np.log2(p)).sum()), float(counts[128:].sum()) / n,
    ]


def _measure(columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([statistics(t) for t in batch["text"]], columns=list(STATISTICS), dtype=float)
            for i, c in enumerate(columns):
                out.insert(i, c, batch[c].astype("Int64").array)
            yield out

    return run


def with_statistics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The integer ``columns`` of ``rows`` and the statistics of ``text``."""
    schema = ", ".join([f"{c} long" for c in columns] + [f"{s} double" for s in STATISTICS])
    return rows.select(*columns, "text").mapInPandas(_measure(columns), schema)


# a rule: ((statistic, is above, bound), ...)
Rule = tuple[tuple[int, bool, float], ...]


def _grow(binned: np.ndarray, edges: list[np.ndarray], target: np.ndarray, weight: np.ndarray, rows: np.ndarray, columns: np.ndarray, depth: int, path: Rule, rules: list[Rule], fitted: np.ndarray) -> None:
    g, h = target[rows], weight[rows]
    fitted[rows] = g.sum() / (h.sum() + 1.0)
    if path:
        rules.append(path)
    if depth == 0 or len(rows) < 20:
        return
    best, at = 1e-6, None
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for c in columns:
        gs = np.cumsum(np.bincount(binned[rows, c], weights=g, minlength=BINS + 1))
        hs = np.cumsum(np.bincount(binned[rows, c], weights=h, minlength=BINS + 1))
        ns = np.cumsum(np.bincount(binned[rows, c], minlength=BINS + 1))
        gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - whole
        gain[(ns < 10) | (len(rows) - ns < 10)] = 0.0
        k = int(gain.argmax())
        if gain[k] > best and k < len(edges[c]):
            best, at = float(gain[k]), (int(c), k)
    if at is None:
        return
    c, k = at
    above = binned[rows, c] > k
    for side, part in ((False, rows[~above]), (True, rows[above])):
        _grow(binned, edges, target, weight, part, columns, depth - 1, (*path, (c, side, float(edges[c][k]))), rules, fitted)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Rule]:
    """Distinct rules of boosted trees, each grown on random halves of the rows and of the statistics."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, BINS + 1)[1:-1])) for c in range(x.shape[1])]
    binned = np.stack([np.searchsorted(edges[c], x[:, c], side="left") for c in range(x.shape[1])], axis=1)
    score, rules = np.full(len(y), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        columns = rng.permutation(x.shape[1])[: max(1, x.shape[1] // 2)]
        own: list[Rule] = []
        if len(rows):
            _grow(binned, edges, y - p, p * (1 - p), rows, columns, depth, (), own, np.zeros(len(y)))
        rules += own
        # the tree's deepest rules carry its values to all rows
        leaves = [r for r in own if not any(len(q) > len(r) and q[: len(r)] == r for q in own)]
        for r in leaves:
            held = holds(x, r)
            if held.any():
                score[held] += RATE * float((y - p)[held].sum() / ((p * (1 - p))[held].sum() + 1.0))
    return sorted(set(rules))


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c, above, bound in rule:
        out &= (x[:, c] > bound) if above else (x[:, c] <= bound)
    return out


def lasso(design: np.ndarray, y: np.ndarray, strength: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic model with an absolute penalty, by accelerated proximal gradients."""
    n, width = design.shape
    v = np.ones(width)
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = design.T @ (design @ v)
        v /= np.linalg.norm(v) or 1.0
    rate = 1.0 / (0.25 * (np.linalg.norm(design @ v) ** 2 / n + 1.0) * 1.1)
    w, b, ahead, ahead_b, t = np.zeros(width), 0.0, np.zeros(width), 0.0, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(design @ ahead + ahead_b, -30, 30))) - y
        moved = ahead - rate * (design.T @ r) / n
        after = np.sign(moved) * np.maximum(0, np.abs(moved) - rate * strength)
        after_b = ahead_b - rate * r.mean()
        t_after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = after + (t - 1) / t_after * (after - w), after_b + (t - 1) / t_after * (after_b - b)
        w, b, t = after, after_b, t_after
    return b, w


class Model:
    """An intercept, weighted rules, and weighted statistics scaled between two bounds: (statistic, low, high, weight)."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]], linear: list[tuple[int, float, float, float]]):
        self.intercept, self.rules, self.linear = intercept, rules, linear

    def column(self) -> Column:
        """The probability of label 1 as an expression over the statistics' columns."""
        total = F.lit(self.intercept)
        for c, low, high, weight in self.linear:
            total = total + F.lit(weight) * (F.greatest(F.lit(low), F.least(F.lit(high), F.col(STATISTICS[c]))) - F.lit(low)) / F.lit(high - low)
        for rule, weight in self.rules:
            held = F.lit(True)
            for c, above, bound in rule:
                value = F.col(STATISTICS[c])
                held = held & ((value > F.lit(bound)) if above else (value <= F.lit(bound)))
            total = total + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Model:
    """Fit on statistics and labels; without both labels the model is constant."""
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.5
        return Model(math.log((mean + 0.01) / (1.01 - mean)), [], [])
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    scaled = np.flatnonzero(high > low)
    rules = tree_rules(x, y, seed=seed)
    linear = (np.clip(x[:, scaled], low[scaled], high[scaled]) - low[scaled]) / (high - low)[scaled]
    design = np.concatenate([linear, np.stack([holds(x, r) for r in rules], axis=1).astype(float)], axis=1) if rules else linear
    part = np.random.default_rng(seed).random(len(y)) < 0.25
    best = (math.inf, 0.001)
    if 0 < part.sum() < len(y):
        for strength in (0.0005, 0.001, 0.002, 0.005):
            b, w = lasso(design[~part], y[~part], strength)
            p = np.clip(1 / (1 + np.exp(-(design[part] @ w + b))), 1e-6, 1 - 1e-6)
            best = min(best, (float(-(y[part] * np.log(p) + (1 - y[part]) * np.log(1 - p)).mean()), strength))
    b, w = lasso(design, y, best[1])
    k = len(scaled)
    kept = [(int(c), float(low[c]), float(high[c]), float(v)) for c, v in zip(scaled, w[:k], strict=True) if v]
    return Model(float(b), [(r, float(v)) for r, v in zip(rules, w[k:], strict=True) if v], kept)


def held_out():
    return remainder("doc_id", 4) == 2


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fold, the first by a hash of their id. Labels of a
    repeated id are taken at their largest."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("quality").cast("long").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most ``rows`` pairs of numbers
    data = with_statistics(found, ["doc_id", "label"]).toPandas().sort_values(["doc_id", *STATISTICS[:3]])
    return train(data[list(STATISTICS)].to_numpy(float), data["label"].to_numpy(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of ``docs`` (doc_id, text). Null and empty texts are scored by their zeros; repeated
    rows come back once each, and other columns are ignored."""
    return with_statistics(docs, ["doc_id"]).select("doc_id", model.column().alias("score"))

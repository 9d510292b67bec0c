"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on labelled rows; every path from a root is a conjunctive
rule (Friedman and Popescu, "Predictive Learning via Rule Ensembles"). Lasso
logistic regression keeps few of them, and the kept rules become one Spark column
expression over the statistics, so scoring is a projection in the JVM.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, keyed, map_batches, materialize

SAMPLE = 20_000  # labelled rows to fit on at most: those of smallest hash of the id
TREES = 30
DEPTH = 3
BINS = 32
LEAST = 8  # rows in a leaf
PENALTY = 0.002
STEPS = 400
SEED = 42
THRESHOLD = 0.7

STATS = (
    "log_words", "word_bytes", "upper", "digits", "symbols", "pipes", "bangs", "stops_by_word", "high_bytes", "lines_by_word",
    "dup_lines", "unique_words", "repeat_words", "line_words", "short_lines", "top_word", "long_word",
)

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SYMBOL = np.isin(_BYTES, list(b"#*$%&<>{}[]\\^~_="))


def stats_of(raw: bytes) -> tuple:
    """The statistics of one text, in the order of STATS; all zero but for a text without words."""
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(hist[_UPPER].sum() + hist[_LOWER].sum() + hist[128:].sum()))
    size = int(hist.sum()) - int(hist[[32, 9, 10, 11, 12, 13]].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    by_line = [len(x.split()) for x in lines]
    distinct = set(words)
    windows = list(zip(words, words[1:], words[2:]))
    return (
        math.log1p(n), size / n, float(hist[_UPPER].sum()) / letters, float(hist[_DIGIT].sum()) / size, float(hist[_SYMBOL].sum()) / size,
        hist[124] / n, hist[33] / n, (hist[46] + hist[44]) / n, float(hist[128:].sum()) / size, len(lines) / n,
        1 - len(set(lines)) / len(lines), len(distinct) / n, 1 - len(set(windows)) / len(windows) if windows else 0.0,
        n / len(lines), sum(x < 4 for x in by_line) / len(lines), max(Counter(words).values()) / n, float(max(map(len, distinct))),
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATS of every row, from its whole text; null is the empty text.

    Repeated rows and null ids are rows like any other; of words that are equally frequent it
    does not matter which is counted; very long texts are read whole in one worker; an empty
    table gives no rows. Other columns are not read, whatever they are called.
    """

    def stats(batch):
        rows = np.array([stats_of(x) for x in bytes_of(batch.column(1))], float)
        return {"doc_id": batch.column(0)} | {n: rows[:, k] for k, n in enumerate(STATS)}

    return map_batches(keyed(docs, id_col, text_col), stats, "doc_id long, " + ", ".join(f"{n} double" for n in STATS))


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, low, high): low < value <= high for each; weight in the log odds."""

    bounds: tuple[tuple[str, float, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        parts = [c for n, low, high in self.bounds for c in ([F.col(n) > low] if low > -math.inf else []) + ([F.col(n) <= high] if high < math.inf else [])]
        return reduce(Column.__and__, parts)

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(x[:, STATS.index(n)] > low) & (x[:, STATS.index(n)] <= high) for n, low, high in self.bounds])


@dataclass(frozen=True)
class Ensemble:
    base: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The probability of label 1 as a column expression over STATS."""
        odds = reduce(Column.__add__, [F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0)) for r in self.rules], F.lit(self.base))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _grow(codes: np.ndarray, residual: np.ndarray, rows: np.ndarray, columns: np.ndarray, depth: int, path: tuple, out: list) -> None:
    """Splits rows where the residuals' squared error falls most; adds each path to out."""
    if depth == 0 or len(rows) < 2 * LEAST:
        return
    r = residual[rows]
    total, n, best = r.sum(), len(rows), (1e-9, -1, -1)
    for c in columns:
        count = np.bincount(codes[rows, c], minlength=BINS)
        part = np.bincount(codes[rows, c], weights=r, minlength=BINS)
        left, below = np.cumsum(part)[:-1], np.cumsum(count)[:-1]
        fine = (below >= LEAST) & (n - below >= LEAST)
        gain = np.where(fine, left**2 / np.maximum(below, 1) + (total - left) ** 2 / np.maximum(n - below, 1) - total**2 / n, 0)
        if gain.max() > best[0]:
            best = (gain.max(), c, int(gain.argmax()))
    if best[1] < 0:
        return
    low = codes[rows, best[1]] <= best[2]
    for side, part in ((0, rows[low]), (1, rows[~low])):
        here = (*path, (best[1], best[2], side))
        out.append(here)
        _grow(codes, residual, part, columns, depth - 1, here, out)


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Trees on residuals of a running estimate, then lasso logistic weights for their paths.

    Without rows of both labels it has no rules and scores the smoothed share of label 1.
    """
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    if len(set(y.tolist())) < 2:
        return Ensemble(base, ())
    rng = np.random.default_rng(SEED)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
    odds, paths = np.full(len(y), base), []
    for _ in range(TREES):
        rows = np.sort(rng.choice(len(y), max(len(y) // 2, min(len(y), 4 * LEAST)), replace=False))
        columns = np.sort(rng.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False))
        residual = y - 1 / (1 + np.exp(-odds))
        found: list = []
        _grow(codes, residual, rows, columns, DEPTH, (), found)
        paths += found
        for path in (p for p in found if len(p) == DEPTH):
            inside = np.logical_and.reduce([(codes[:, c] <= k) == (side == 0) for c, k, side in path])
            odds[inside] += 2 * residual[inside].mean() if inside.any() else 0
    rules = {}
    for path in paths:
        bounds: dict[str, list[float]] = {}
        for c, k, side in path:
            b = bounds.setdefault(STATS[c], [-math.inf, math.inf])
            value = float(cuts[c][min(k, len(cuts[c]) - 1)])
            b[1 - side] = min(b[1], value) if side == 0 else max(b[0], value)
        rules[tuple(sorted((n, low, high) for n, (low, high) in bounds.items()))] = None
    rules = [Rule(b) for b in rules]
    held = np.stack([r.holds(x) for r in rules], 1).astype(float)
    share = held.mean(0)
    rules, held = zip(*[(r, held[:, k]) for k, r in enumerate(rules) if 0 < share[k] < 1]) if ((share > 0) & (share < 1)).any() else ((), ())
    if not rules:
        return Ensemble(base, ())
    weights, base = _lasso(np.stack(held, 1), y, base)
    return Ensemble(float(base), tuple(Rule(r.bounds, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6))


def _lasso(held: np.ndarray, y: np.ndarray, base: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the mean logistic loss and PENALTY times the weights' sizes."""
    n, k = held.shape
    step = 4 / (np.linalg.norm(held, 2) ** 2 / n + 1)
    w = near = np.zeros(k)
    b = near_b = base
    t = 1.0
    for _ in range(STEPS):
        gap = 1 / (1 + np.exp(-(held @ near + near_b))) - y
        new = near - step * (held.T @ gap) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        new_b, new_t = near_b - step * gap.mean(), (1 + math.sqrt(1 + 4 * t * t)) / 2
        near, near_b = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    return w, b


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Ensemble:
    """Fits on at most ``sample`` of the labelled ids, those of smallest hash, and their texts' statistics.

    An id that is labelled more than once has the largest label. Of rows that share an id the
    one whose statistics have the smallest hash is fitted, so that what is fitted is a text that there
    is. Labels of null, or for no row, are left out; with no rows left the ensemble has no rules.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(target).cast("double").alias("y")).dropna()
    chosen = materialize(known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # At most `sample` rows of two numbers, so it can be broadcast at any size of the corpus.
    near = keyed(docs, id_col, text_col).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = statistics(near).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct(*STATS, "y"), F.struct(F.xxhash64(*STATS), *STATS)).alias("s")).orderBy("doc_id").select("s.*").collect()
    x = np.array([[r[c] for c in STATS] for r in rows], float).reshape(len(rows), len(STATS))
    return fit(x, np.array([r.y for r in rows], float))


def classify(docs: DataFrame, ensemble: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row; null and empty texts are scored by statistics of zero.

    Repeated rows and null ids each get a score; very long texts are measured in full;
    an empty table gives no rows.
    """
    scored = statistics(docs, id_col, text_col).select("doc_id", ensemble.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


__all__ = ["Ensemble", "Rule", "classify", "fit", "statistics", "train"]

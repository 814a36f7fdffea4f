"""Quality classifier: a sparse ensemble of rules taken from trees.

Shallow gradient-boosted trees are grown over statistics of texts; every path from a root to
a node is a conjunctive rule. A logistic model with a lasso penalty over the rules, and over
the statistics themselves between their outer percentiles, keeps few of them. The kept rules
become one Spark column expression: scoring is a sum of `when` terms, without Python.

Training reads at most `train_rows` labelled rows, the first by a hash of doc_id; that bound
is a parameter. Null and empty texts have statistics of 0 and get a score like all others.
A label that is null, or a doc_id without a text, is no training row; without both labels in
training every score is the share of 1 (0.5 without any label). Repeated rows are scored
each. An empty table gives an empty result; columns but doc_id and text do not matter.
A text of any length is measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.language_id import bucket
from quarry.llm.quality_rules import add_counts

TRAIN_ROWS = 20_000
TREES, DEPTH, CUTS, MIN_LEAF = 40, 3, 32, 10
LASSO = 0.002


def statistics() -> dict[str, Column]:
    """Statistics of a text, from the counts of quality_rules.text_counts."""
    c = F.col
    words = F.greatest(c("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(c("word_chars"), F.lit(1)).cast("double")
    return {
        "words": F.log1p(c("n_words").cast("double")),
        "word_length": c("word_chars") / words,
        "symbols": c("n_symbols") / words,
        "dup_lines": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)).cast("double"),
        "repeats": c("n_repeat_words") / words,
        "line_words": c("n_words") / F.greatest(c("n_lines"), F.lit(1)).cast("double"),
        "letters": c("n_letters") / chars,
        "upper": c("n_upper") / chars,
        "distinct": c("n_distinct") / words,
    }


@dataclass(frozen=True)
class Rule:
    """All of its conditions (statistic, whether above, bound) hold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, above, bound in self.conditions:
            out &= (x[:, j] > bound) == above
        return out

    def column(self, columns: list[Column]) -> Column:
        out = None
        for j, above, bound in self.conditions:
            here = columns[j] > F.lit(bound) if above else columns[j] <= F.lit(bound)
            out = here if out is None else out & here
        return out


def _grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, rows: np.ndarray, path: tuple, depth: int, out: list, step: np.ndarray) -> None:
    """Adds the path of each node below, and writes each leaf's step."""
    g, h = slope[rows].sum(), curve[rows].sum()
    step[rows] = g / (h + 1)
    if not depth or len(rows) < 2 * MIN_LEAF:
        return
    best = (1e-6, 0, 0.0)
    for j in range(x.shape[1]):
        values = x[rows, j]
        cuts = np.unique(np.quantile(values, np.linspace(0.02, 0.98, CUTS)))
        side = np.searchsorted(cuts, values, side="left")
        gs = np.cumsum(np.bincount(side, slope[rows], len(cuts) + 1))[:-1]
        hs = np.cumsum(np.bincount(side, curve[rows], len(cuts) + 1))[:-1]
        n = np.cumsum(np.bincount(side, minlength=len(cuts) + 1))[:-1]
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g * g / (h + 1)
        gain[(n < MIN_LEAF) | (len(rows) - n < MIN_LEAF)] = 0
        k = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[k] > best[0]:
            best = (float(gain[k]), j, float(cuts[k]))
    if best[0] <= 1e-6:
        return
    _, j, cut = best
    for above in (False, True):
        part = rows[(x[rows, j] > cut) == above]
        own = (*path, (j, above, cut))
        out.append(Rule(tuple(sorted(own))))
        _grow(x, slope, curve, part, own, depth - 1, out, step)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """The different paths of boosted trees, each grown on half of the rows."""
    rules: list[Rule] = []
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    draw = np.random.default_rng(7)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        rows = np.sort(draw.permutation(len(y))[: max(2 * MIN_LEAF, len(y) // 2)])
        found: list[Rule] = []
        _grow(x, y - p, p * (1 - p), rows, (), depth, found, step)
        rules += found
        margin += 0.3 * step
    return list(dict.fromkeys(rules))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = LASSO, rounds: int = 500) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient steps; the intercept bears no penalty."""
    n, m = z.shape
    full = np.concatenate([np.ones((n, 1)), z], 1)
    v = np.ones(m + 1)
    for _ in range(30):  # the largest curvature, by power iteration
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / max(float(v @ (full.T @ (full @ v))), 1e-9)
    w = last = np.zeros(m + 1)
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    w[0] = np.log(share / (1 - share))
    last, t = w.copy(), 1.0
    for _ in range(rounds):
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at = w + (t - 1) / t2 * (w - last)
        slope = full.T @ (1 / (1 + np.exp(-(full @ at))) - y) / n
        new = at - rate * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        if np.abs(new - w).max() < 1e-7:
            w = new
            break
        w, last, t = new, w, t2
    return float(w[0]), w[1:]


class Ensemble:
    """Rules and linear terms with their weights."""

    def __init__(self, x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = LASSO) -> None:
        self.names = names
        self.rules: list[tuple[Rule, float]] = []
        self.linear: list[tuple[int, float, float, float, float]] = []
        if not len(y) or y.min() == y.max():
            share = (float(y.sum()) + 0.5) / (len(y) + 1) if len(y) else 0.5
            self.intercept = float(np.log(share / (1 - share)))
            return
        rules = tree_rules(x, y)
        low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
        cut = np.clip(x, low, high)
        mean, dev = cut.mean(0), np.maximum(cut.std(0), 1e-9)
        z = np.concatenate([np.stack([r.holds(x) for r in rules], 1).astype(float), (cut - mean) / dev * 0.4], 1)
        self.intercept, weights = lasso_logistic(z, y, penalty)
        self.rules = [(r, float(w)) for r, w in zip(rules, weights) if w]
        for j, w in enumerate(weights[len(rules) :]):
            if w:
                self.linear.append((j, float(w * 0.4 / dev[j]), float(low[j]), float(high[j]), float(mean[j])))

    def column(self, columns: list[Column]) -> Column:
        """Probability of label 1 as a column expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, w in self.rules:
            total = total + F.when(rule.column(columns), F.lit(w)).otherwise(F.lit(0.0))
        for j, w, low, high, mean in self.linear:
            total = total + (F.least(F.greatest(columns[j], F.lit(low)), F.lit(high)) - F.lit(mean)) * F.lit(w)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(total, F.lit(-50.0)), F.lit(50.0))))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id with the statistics of its text."""
    found = statistics()
    return add_counts(docs).select("doc_id", *(c.alias(n) for n, c in found.items()))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Ensemble:
    """Fit on labelled rows whose bucket(5) is not 0; labels has doc_id and quality.

    The drawn labels are few, so only their texts are counted.
    """
    names = list(statistics())
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (bucket(5) != 0))
    usable = usable.select("doc_id", F.col("quality").cast("double").alias("quality"))
    drawn = usable.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "quality").limit(train_rows)
    rows = counted(docs.select("doc_id", "text").join(F.broadcast(drawn.select("doc_id").distinct()), "doc_id", "left_semi")).join(F.broadcast(drawn), "doc_id")
    # Repeated rows can be more than drawn; the hash, not the id, says which of them count.
    data = rows.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(2 * train_rows).toPandas().sort_values("doc_id", kind="stable", ignore_index=True)
    return Ensemble(data[names].to_numpy(float), data["quality"].to_numpy(float), names)


def score(docs: DataFrame, ensemble: Ensemble, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 from threshold on)."""
    stats = counted(docs)
    scored = stats.withColumn("score", ensemble.column([F.col(n) for n in ensemble.names]))
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

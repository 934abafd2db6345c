"""Operator 7. Quality classifier: a sparse rule ensemble. Paths of small trees over text statistics become conjunctive
rules, a lasso logistic regression weighs them, and the rules that keep a weight are compiled to column expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import class_log_odds, crc_mod, labelled_sample, stored, table
from tessella.llm.quality_rules import share
from tessella.llm.text_stats import with_text_stats

#: (feature, is above, threshold) terms, and-ed.
Rule = tuple[tuple[str, bool, float], ...]


def features() -> dict[str, Column]:
    """Statistics of a text, from the counts of with_text_stats."""
    return {
        "words": F.log1p(F.col("n_words").cast("double")),
        "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "upper": share("n_upper", "word_chars"),
        "exclaim": share("n_exclaim", "n_words"),
        "stops": share("n_stops", "n_words"),
        "digits": share("n_digits", "word_chars"),
        "other": share("n_other", "word_chars"),
        "line_words": share("n_words", "n_lines"),
    }


def tree_rules(x: np.ndarray, y: np.ndarray, names: list[str], depth: int, rng: np.random.Generator, least: int) -> list[Rule]:
    """Every path from the root of a regression tree on residuals y; each split sees a random half of the features."""
    rules: list[Rule] = []

    def grow(rows: np.ndarray, path: Rule) -> None:
        if path:
            rules.append(path)
        if len(path) == depth or len(rows) < 2 * least:
            return
        best = (1e-9, None, None)
        for f in rng.choice(len(names), max(1, len(names) // 2), replace=False):
            v = x[rows, f]
            for t in np.unique(np.quantile(v, np.linspace(0.02, 0.98, 33), method="nearest")):
                up = v > t
                n = int(up.sum())
                if least <= n <= len(rows) - least:
                    a, b = y[rows[up]], y[rows[~up]]
                    gain = n * a.mean() ** 2 + (len(rows) - n) * b.mean() ** 2 - len(rows) * y[rows].mean() ** 2
                    if gain > best[0]:
                        best = (gain, f, float(t))
        if best[1] is not None:
            up = x[rows, best[1]] > best[2]
            for above in (True, False):
                grow(rows[up == above], (*path, (names[best[1]], above, best[2])))

    grow(np.arange(len(y)), ())
    return rules


def covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    return np.logical_and.reduce([(x[:, names.index(f)] > t) == above for f, above, t in rule])


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression under an L1 penalty, by accelerated proximal gradient steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    step = 1 / (0.25 * np.linalg.norm(x1, 2) ** 2 / len(y) + 1e-9)
    w = v = np.zeros(x1.shape[1])
    for k in range(rounds):
        new = v - step * (x1.T @ (1 / (1 + np.exp(-np.clip(x1 @ v, -50, 50))) - y) / len(y))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], n_trees: int = 24, depth: int = 3, penalty: float = 1e-3, seed: int = 7) -> tuple[list[tuple[Rule, float]], float]:
    """(rules with their weights, intercept). Trees are boosted: each is grown on what those before leave, over a random
    half of the rows, so that the rules differ."""
    rng, rules, fitted = np.random.default_rng(seed), {}, np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    least = min(10, max(2, len(y) // 40))  # rows of a leaf
    for _ in range(n_trees):
        rest = y - 1 / (1 + np.exp(-fitted))
        rows = rng.choice(len(y), max(1, len(y) // 2), replace=False)
        for rule in tree_rules(x[rows], rest[rows], names, depth, rng, least):
            rules.setdefault(rule, None)
            on = covers(rule, x, names)
            fitted[on] += 0.5 * rest[on].mean() if on.any() else 0
    if not rules:
        return [], float(fitted[0]) if len(fitted) else 0.0
    w, b = lasso(np.column_stack([covers(r, x, names) for r in rules]).astype(float), y, penalty)
    return [(r, float(k)) for r, k in zip(rules, w, strict=True) if k != 0], b


def compiled(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """Probability of label 1 as one column over the columns of features()."""
    holds = lambda rule: reduce(lambda a, b: a & b, [F.col(f) > t if above else F.col(f) <= t for f, above, t in rule])
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, [F.when(holds(r), w).otherwise(0.0) for r, w in rules], F.lit(intercept))))


def train(docs: DataFrame, labels: DataFrame, label: str, m: int, held: int, per_class: int = 2000) -> tuple[list[tuple[Rule, float]], float]:
    """Rules and intercept. Bound on the training sample: `per_class` rows a class, whole texts; their statistics are
    computed on the executors and only those numbers reach the driver. The intercept is corrected from the even sample to
    the classes' shares of all labelled training rows. Without labels there are no rules and the score is 0.5."""
    names = list(features())
    sample = with_text_stats(labelled_sample(docs, labels, label, m, held, per_class))
    got = sample.select("doc_id", "label", *[c.alias(n) for n, c in features().items()]).toPandas().sort_values("doc_id")
    y = got["label"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return [], 0.0
    rules, b = fit_rules(got[names].to_numpy(), y, names)
    return rules, float(b + class_log_odds(labels, label, m, held) - np.log(y.sum() / (len(y) - y.sum())))


def score(docs: DataFrame, model: tuple[list[tuple[Rule, float]], float]) -> DataFrame:
    """(doc_id, features, score) per row; null and empty texts have statistics of zero and are scored like any other,
    repeated rows score alike, and columns of docs other than doc_id and text are not read."""
    # The statistics, a few numbers a row, are written first: the pass over the texts is not compiled together with the rules.
    stats = stored(with_text_stats(docs.select("doc_id", "text")).select("doc_id", *[c.alias(n) for n, c in features().items()]))
    return stats.withColumn("score", compiled(*model))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, train(docs, labels, "quality", 3, 1))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

"""Operator 2. Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count
ratios, trained on labelled text.

An n-gram is a hash bucket. The feature of a bucket is its log-count ratio times its count in the text, and a text's
features have length 1 together. Every bucket that two texts of the sample hold has a weight: none is selected away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import class_log_odds, crc_mod, labelled_sample, table

NGRAMS, BITS = (3, 4, 5, 6), 20
#: Characters that are worked on at a time.
SPAN = 1 << 19


def buckets(points: np.ndarray) -> np.ndarray:
    """Bucket (below 2^BITS) of every n-gram that begins among the code points, for each n of NGRAMS."""
    out, h = [], points
    for n in range(2, NGRAMS[-1] + 1):
        if len(points) < n:
            break
        h = h[:-1] * np.uint32(0x9E3779B1) + points[n - 1 :]
        if n in NGRAMS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append(mixed >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of the lower-cased whole text and how often each comes. A long text is counted span by span."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) <= SPAN:
        found = np.sort(buckets(points))
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
        return found[first], np.diff(np.append(first, len(found)))
    counts = np.zeros(1 << BITS, np.int64)
    for i in range(0, len(points), SPAN):
        part = points[i : i + SPAN + NGRAMS[-1] - 1]
        counts += np.bincount(buckets(part), minlength=1 << BITS)
        if i + SPAN < len(points):  # what begins in the part's overlap is the next span's
            counts -= np.bincount(buckets(part[SPAN:]), minlength=1 << BITS)
    found = np.flatnonzero(counts)
    return found.astype(np.uint32), counts[found]


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, l2: float, epochs: int = 10, seed: int = 3) -> tuple[np.ndarray, float]:
    """Ridge logistic regression over sparse rows (buckets, values) by stochastic dual coordinate ascent."""
    rng, w, b0, n = np.random.default_rng(seed), np.zeros(1 << BITS), 0.0, len(rows)
    dual, signs = np.zeros(n), np.where(y == 1, 1.0, -1.0)
    width = [float(v @ v) + 1 for _, v in rows]
    for _ in range(epochs):
        for i in rng.permutation(n):
            at, v = rows[i]
            margin = signs[i] * (w[at] @ v + b0)
            step = (signs[i] / (1 + np.exp(np.clip(margin, -50, 50))) - dual[i]) / max(1.0, 0.25 + width[i] / (l2 * n))
            dual[i] += step
            w[at] += step / (l2 * n) * v
            b0 += step / (l2 * n)
    return w, b0


def scaled(found: np.ndarray, counts: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's features: counts times log-count ratios, scaled to length 1. Buckets without a ratio go."""
    v = ratio[found] * counts
    known = v != 0
    found, v = found[known], v[known].astype(np.float64)
    return found, v / max(1e-12, float(np.sqrt(v @ v)))


def train(docs: DataFrame, labels: DataFrame, label: str, m: int, held: int, per_class: int = 800, l2: float = 1e-5) -> dict | None:
    """Log-count ratios and weights by bucket, and an intercept; None without rows of both classes.

    Bound on the training sample: `per_class` rows a class, whole texts. Their n-grams are counted on the executors; the
    counts (at most 2^BITS a row) reach the driver. The ratio of a bucket compares in how many texts of each class it is,
    one added to each. The intercept is corrected from the sample's to the classes' shares of all labelled training rows.
    """
    sample = labelled_sample(docs, labels, label, m, held, per_class)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                got = [gram_counts(t) for t in part.column("text").to_pylist()]
                cols = [pa.array([b.astype("<u4").tobytes() for b, _ in got], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in got], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label").cast(pa.int32()), *cols], ["doc_id", "label", "buckets", "counts"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    got = sample.select("doc_id", "label", "text").mapInArrow(grams, f"doc_id {kind}, label int, buckets binary, counts binary").toPandas().sort_values("doc_id")
    y = got["label"].to_numpy()
    if not 0 < y.sum() < len(y):
        return None
    rows = [(np.frombuffer(b, "<u4"), np.frombuffer(c, "<u4")) for b, c in zip(got["buckets"], got["counts"], strict=True)]
    texts = np.zeros((2, 1 << BITS))
    for k, (found, _) in zip(y, rows, strict=True):
        texts[k, found] += 1
    share = (texts + 1) / (np.array([[(y == 0).sum()], [(y == 1).sum()]]) + 2)
    ratio = np.where(texts.sum(0) > 1, np.log(share[1] / share[0]), 0).astype(np.float32)
    w, b0 = fit_logistic([scaled(*r, ratio) for r in rows], y, l2)
    b0 += class_log_odds(labels, label, m, held) - np.log(y.sum() / (len(y) - y.sum()))
    return {"ratio": ratio, "weight": w.astype(np.float32), "intercept": float(b0)}


def text_score(text: str | None, model: dict) -> float:
    found, v = scaled(*gram_counts(text), model["ratio"])
    z = float(model["weight"][found] @ v) + model["intercept"]
    return float(1 / (1 + np.exp(-min(50.0, max(-50.0, z)))))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score) per row, over the whole text. A null, empty or very short text has no n-gram and gets the
    intercept's score; repeated rows score alike; without a model every score is 0.5; columns of docs other than doc_id
    and text are not read."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                scores = [text_score(t, model) if model is not None else 0.5 for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, train(docs, labels, "toxic", 5, 0))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

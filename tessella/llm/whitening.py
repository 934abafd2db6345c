"""Operator 13. Whitening by Golub-Kahan-Lanczos bidiagonalisation.

The matrix has a centred row for each distinct vector and stays distributed; only vectors of its width reach the driver. A
step is one pass over the rows: each task forms its part of u = Xv and of Xᵀu, and their sums come back. With full
reorthogonalisation X = U B Vᵀ, where B is upper bidiagonal and small; its singular value decomposition gives the
components (V times its right vectors) and the deviations (its singular values over the root of n).

A left vector is X times a vector of the driver, so none is kept anywhere: u = X w, and UᵀXw is (XᵀU)ᵀw, which the passes
before have left on the driver. A task that is lost is run again from the table of distinct vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm.common import stored, table

#: Residual of a component, as a share of the largest singular value, below which it has converged.
CLOSE = 1e-13
#: Singular values below this share of the largest are zero.
ZERO = 1e-9
#: Largest deviation: a long.
LONG = 2**63 - 1


def whole_vector(vector: str, scale: int) -> Column:
    """floor(scale * entry) of every entry, as longs."""
    return F.transform(F.col(vector), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))


def finite_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, without null, infinite or NaN entries."""
    wrong = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return df.where(F.col(vector).isNotNull() & ~F.coalesce(wrong, F.lit(False)))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def centred(rows: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """rows - s / n, rounded once: n * rows - s is exact where it fits."""
    most = max(map(abs, s))
    if rows.size and n * max(abs(int(rows.max())), abs(int(rows.min()))) + most >= 2**53:
        return rows - np.array([float(Fraction(v, n)) for v in s])
    return (n * rows - np.array(s, np.int64)) / n


def total(fit: DataFrame, f: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """Sum over all rows of what f gives for a matrix of them: a vector of a length that doesn't depend on the rows. Tasks
    add up their own, and positions are added before they reach the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for batch in batches:
            if batch.num_rows:
                one = f(matrix(batch.column(0), d))
                made = one if made is None else made + one
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.list_(pa.float64()))], ["v"])

    rows = fit.mapInArrow(part, "v array<double>").select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["at"]] = r["v"]
    return out


class Bidiagonal:
    """X V = U B with orthonormal columns: right vectors V, diagonal and superdiagonal of B, XᵀU, and the w of u = X w."""

    def __init__(self, d: int):
        self.d, self.random = d, np.random.default_rng(13)
        self.right, self.left, self.back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
        self.diagonal: list[float] = []
        self.beside: list[float] = []
        self.next, self.begun = self.fresh(), 0

    def fresh(self) -> np.ndarray:
        """A random unit vector that is orthogonal to all right vectors."""
        v = self.random.standard_normal(self.d)
        for _ in range(3):
            v = v - self.right @ (self.right.T @ v)
        return v / np.linalg.norm(v)

    def step(self, product: Callable[[np.ndarray], tuple[float, np.ndarray]]) -> None:
        """One pass. product(w): |Xw|² and XᵀXw."""
        v, size = self.next, self.sigma()
        w = v - (self.beside[-1] * self.left[:, -1] if self.diagonal else 0.0)
        for _ in range(2):  # what is left of the earlier left vectors in Xw goes
            w = w - self.left @ (self.back.T @ w)
        square, back = product(w)
        alpha = float(np.sqrt(max(square, 0.0)))
        if alpha <= size * 1e-14:  # v adds nothing that X doesn't send to earlier left vectors
            alpha, w, back = 0.0, w * 0.0, back * 0.0
        else:
            w, back = w / alpha, back / alpha
        self.right, self.left, self.back = (np.column_stack([a, b]) for a, b in ((self.right, v), (self.left, w), (self.back, back)))
        self.diagonal.append(alpha)
        r = back - alpha * v
        for _ in range(2):
            r = r - self.right @ (self.right.T @ r)
        beta = float(np.linalg.norm(r))
        if beta <= max(size, alpha) * 1e-13:
            self.end()
        else:
            self.beside.append(beta)
            self.next = r / beta

    def end(self) -> None:
        """The right vectors span all that their start reaches; the next one starts anew, for further copies of a value."""
        self.beside.append(0.0)
        self.begun = len(self.diagonal)
        if self.begun < self.d:
            self.next = self.fresh()

    def small(self, start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular value decomposition of B from a row on."""
        b = np.diag(self.diagonal[start:]) + np.diag(self.beside[start:-1], 1)
        return np.linalg.svd(b)

    def sigma(self) -> float:
        return float(self.small()[1][0]) if self.diagonal else 0.0

    def converged(self, k: int) -> bool:
        """Whether the largest value since the last new start is final, and so are those that reach the k largest."""
        if len(self.diagonal) < k or self.begun == len(self.diagonal):
            return False
        left, values, _ = self.small(self.begun)
        rest, most = self.beside[-1] * np.abs(left[-1]), self.small()[1]
        return bool(all(rest[i] <= CLOSE * most[0] for i in range(len(values)) if i == 0 or reaches(values[i], most[k - 1])))

    def kept(self, k: int) -> Bidiagonal:
        """The k largest values and their vectors, which X maps to themselves, and a new start beside them."""
        out, (_, values, right) = Bidiagonal(self.d), self.small()
        out.right, over = self.right @ right[:k].T, np.where(values[:k] > values[0] * ZERO, values[:k], np.inf)
        out.left, out.back = out.right / over, out.right * np.where(np.isinf(over), 0.0, over)
        out.diagonal, out.beside, out.random = list(values[:k]), [0.0] * (k - 1), self.random
        out.end()
        return out


def reaches(value: float, least: float) -> bool:
    return value >= least * (1 - 1e-12)


def components(fit: DataFrame, d: int, n: int, s: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(d x k matrix of unit components, their singular values), fewer where the rank is less."""

    def product(w: np.ndarray) -> tuple[float, np.ndarray]:
        def part(rows: np.ndarray) -> np.ndarray:
            x = centred(rows, n, s)
            u = x @ w
            return np.concatenate([[u @ u], x.T @ u])

        found = total(fit, part, d)
        return float(found[0]), found[1:]

    b, most = Bidiagonal(d), min(k, d)
    while len(b.diagonal) < d:
        b.step(product)
        if b.converged(most):
            # One start finds one copy of equal values, so another start follows until one brings nothing to the k largest;
            # where going on to the whole width costs fewer passes, that settles it.
            if b.begun and not reaches(b.small(b.begun)[1][0], b.small()[1][most - 1]):
                break
            if d - len(b.diagonal) > len(b.diagonal) - b.begun:
                b = b.kept(most)
    _, values, right = b.small()
    rank = int(np.sum(values > values[0] * ZERO)) if values[0] > 0 else 0
    k = min(k, rank)
    made = b.right @ right[:k].T
    made = made / np.linalg.norm(made, axis=0) if k else made
    sign = np.sign(made[np.argmax(np.abs(made), axis=0), np.arange(k)]) if k else np.ones(0)
    return made * sign, values[:k]


def exact_deviation(rows: np.ndarray, n: int, s: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - s)², exactly. Beyond a long it is an error."""
    most = n * max(abs(int(rows.max())), abs(int(rows.min()))) + max(map(abs, s)) if rows.size else 0
    if most**2 * len(s) <= LONG:
        return np.sum((n * rows - np.array(s, np.int64)) ** 2, axis=1).tolist()
    made = np.sum((n * rows.astype(object) - np.array(s, object)) ** 2, axis=1).tolist()
    if max(made) > LONG:
        raise OverflowError("a deviation is beyond a long")
    return made


def whitened(df: DataFrame, vector: str = "embedding", carry: tuple[str, ...] = ("vec_id",), scale: int = 256, k: int = 4) -> DataFrame:
    """(carry, component, n, deviation, whitened, explained, identity_error) for every row with a finite vector and each of
    the k largest components of the distinct whole vectors floor(scale * entry).

    Rows without a vector, or with a null or non-finite entry, go. Equal vectors count once in the fit, and each of their
    rows comes back. Shorter vectors have zeros at their end. Only components of positive deviation are returned: none of an
    empty table, of one distinct vector, or of vectors without entries. Other columns don't matter.
    """
    kept = T.StructType([df.schema[c] for c in carry])
    out = T.StructType([*kept, T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    rows = finite_vectors(df, vector).select(*carry, whole_vector(vector, scale).alias("_x"))
    d = rows.agg(F.max(F.size("_x")).alias("d")).first()["d"] or 0
    none = df.sparkSession.createDataFrame([], out)
    if not d:
        return none
    rows = rows.withColumn("_x", F.concat("_x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("_x"))))
    fit = stored(rows.select("_x").distinct())
    entry = F.col("x").cast("decimal(38,0)")
    sums = fit.select(F.posexplode("_x").alias("at", "x")).groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.sum(entry).alias("s"), F.sum(entry * entry).alias("q")).orderBy("at").collect()
    n, s = sums[0]["n"], [int(r["s"]) for r in sums]
    spread = float(sum(Fraction(int(r["q"]), n) - Fraction(int(r["s"]), n) ** 2 for r in sums))
    if spread == 0:
        return none
    made, values = components(fit, d, n, s, k)
    k = len(values)
    turn = made / (values / np.sqrt(n))
    explained = values**2 / n / spread

    def moments(rows: np.ndarray) -> np.ndarray:
        z = centred(rows, n, s) @ turn
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    found = total(fit, moments, d) / n
    error = float(np.max(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k))))
    arrow = to_arrow_schema(out)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(batch.num_columns - 1), d)
            at, m = pa.array(np.repeat(np.arange(len(x)), k)), len(x)
            z, far = centred(x, n, s) @ turn, np.repeat(np.array(exact_deviation(x, n, s), np.int64), k)
            columns = [*(batch.column(i).take(at) for i in range(len(kept))), np.tile(np.arange(1, k + 1), m), np.full(m * k, n), far, z.ravel(), np.tile(explained, m), np.full(m * k, error)]
            yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(project, out)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))

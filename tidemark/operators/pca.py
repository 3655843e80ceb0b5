"""Means, covariances and principal components: one aggregate over the rows, a small matrix on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_means(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.avg(c).alias(c) for c in columns))


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sample covariances in long form: a, b, cov for every pair of columns, both triangles."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    cell = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.covar_samp(a, b).alias("cov")) for a, b in pairs for x, y in {(a, b), (b, a)}]
    return df.agg(F.array(*cell).alias("m")).select(F.explode("m").alias("c")).select("c.a", "c.b", "c.cov")


def centred(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns' means taken off; the means are one row that the driver reads first."""
    means = column_means(df, columns).first()
    return df.withColumns({c: F.col(c) - F.lit(means[c]) for c in columns})


@dataclass
class PCA:
    """mean [d], components [k, d], variances [k]; ratio over the kept components, and over the total variance."""

    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def ratio_kept(self) -> np.ndarray:
        return self.variances / max(self.variances.sum(), 1e-300)

    @property
    def ratio(self) -> np.ndarray:
        return self.variances / max(self.total, 1e-300)

    def transform(self, df: DataFrame, vector: str = "features", out: str = "pca") -> DataFrame:
        """df with the projections of the centred vectors, as array expressions."""
        mean = F.array(*(F.lit(float(x)) for x in self.mean))
        dot = lambda c: F.aggregate(F.zip_with(F.zip_with(vector, mean, lambda x, m: x.cast("double") - m), F.array(*(F.lit(float(x)) for x in c)), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
        return df.withColumn(out, F.array(*(dot(c) for c in self.components)))


def moments(df: DataFrame, vector: str, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and sample covariance of vectors; partitions send d * d sums each, added up in a tree."""

    def part(rows):
        n, s, q = 0, np.zeros(d), np.zeros((d, d))
        for b in rows:
            x = np.asarray(b.column(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
            n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([q.ravel().tolist()])], ["n", "s", "q"])

    sums = df.select(vector).where(F.col(vector).isNotNull()).mapInArrow(part, "n long, s array<double>, q array<double>")
    cells = sums.select("n", F.posexplode(F.concat("s", "q")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()  # d + d * d rows
    n = cells[0]["n"] if cells else 0
    if n < 2:
        raise ValueError("at least two vectors are needed")
    flat = np.array([r["x"] for r in cells])
    mean = flat[:d] / n
    return n, mean, (flat[d:].reshape(d, d) - n * np.outer(mean, mean)) / (n - 1)


def power_iteration(matrix: np.ndarray, steps: int = 100) -> tuple[float, np.ndarray]:
    """Largest eigenvalue and its vector, from the uniform vector on; a zero vector where that is orthogonal to it."""
    v = np.full(len(matrix), 1 / np.sqrt(len(matrix)))
    for _ in range(steps):
        w = matrix @ v
        size = np.linalg.norm(w)
        if size < 1e-12:
            return 0.0, np.zeros(len(matrix))
        v = w / size
    return float(v @ matrix @ v), v


def fit(df: DataFrame, vector: str, d: int, k: int = 2, method: str = "eigh", steps: int = 100) -> PCA:
    """Principal components; the largest coefficient of each is positive. method: eigh, or power with deflation."""
    _, mean, cov = moments(df, vector, d)
    if method == "eigh":
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(values)[::-1][:k]
        values, comps = values[order], vectors[:, order].T
    elif method == "power":
        left, values, comps = cov.copy(), [], []
        for _ in range(k):
            value, v = power_iteration(left, steps)
            left -= value * np.outer(v, v)
            values.append(value)
            comps.append(v)
        values, comps = np.array(values), np.array(comps)
    else:
        raise ValueError("method is eigh or power")
    signs = np.sign(comps[np.arange(len(comps)), np.abs(comps).argmax(1)])
    signs[signs == 0] = 1
    return PCA(mean, comps * signs[:, None], np.maximum(values, 0), float(np.trace(cov)))

"""Ridge regression from sums per fold: one pass over the rows, then a small solve per penalty and fold."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOM = 1 << 22  # numbers in the sums of a task


@dataclass
class Line:
    """A fitted line; ``r2`` has the mean over the folds for every penalty."""

    coefficients: np.ndarray
    intercept: float
    penalty: float
    r2: dict[float, float]

    def predict(self, df: DataFrame, features: str = "features", output: str = "prediction") -> DataFrame:
        """Add the prediction; null for a row without features."""
        x = _array(df, features)
        pairs = F.zip_with(x, F.array(*(F.lit(float(c)) for c in self.coefficients)), lambda a, b: a * b)
        return df.withColumn(output, F.aggregate(pairs, F.lit(float(self.intercept)), lambda s, v: s + v))


def _array(df: DataFrame, column: str):
    return vector_to_array(column) if isinstance(df.schema[column].dataType, VectorUDT) else F.col(column).cast("array<double>")


def fold_sums(df: DataFrame, fold: str, n_folds: int, features: str = "features", label: str = "label", weight: str = "n") -> np.ndarray:
    """Weighted sums of products of (1, features, label) for every fold, a matrix each.

    Rows with a null in the features, the label or the weight, or a fold outside 0 .. n_folds - 1, count
    for nothing. What comes to the driver has the size of the features squared, whatever the rows.
    """
    rows = df.select(F.col(fold).cast("int").alias("fold"), _array(df, features).alias("x"), F.col(label).cast("double").alias("y"),
                     F.col(weight).cast("double").alias("w"))
    whole = F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()) & F.col("y").isNotNull() & F.col("w").isNotNull()
    rows = rows.where(F.col("fold").between(0, n_folds - 1) & whole)
    wide = rows.select(F.size("x").alias("d")).limit(1).first()  # all rows have one size
    d = wide["d"] if wide else 0
    if (d + 2) ** 2 * n_folds > ROOM:
        raise ValueError(f"{d} features are too many for sums of products of {n_folds} folds")

    def sums(batches):
        out = np.zeros((n_folds, d + 2, d + 2))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, d)
            both = np.column_stack([np.ones(n), x, batch.column("y").to_numpy()])
            w, k = batch.column("w").to_numpy(), batch.column("fold").to_numpy()
            for f in np.unique(k):
                mine = both[k == f]
                out[f] += (mine * w[k == f, None]).T @ mine
        f, i, j = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(out[f, i, j])],
                                         names=["f", "i", "j", "v"])

    found = np.zeros((n_folds, d + 2, d + 2))
    for r in rows.mapInArrow(sums, "f int, i int, j int, v double").groupBy("f", "i", "j").agg(F.sum("v").alias("v")).collect():
        found[r["f"], r["i"], r["j"]] = r["v"]
    return found


def solve(sums: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept from sums of products.

    The mean squared error over two is weighed against the penalty times the squares of the
    coefficients over two, features counted in units of their deviation; constant ones get 0.
    """
    total = sums[0, 0]
    if total <= 0:
        return np.zeros(len(sums) - 2), 0.0
    mean = sums[0, 1:] / total
    cov = sums[1:, 1:] / total - np.outer(mean, mean)
    deviation = np.sqrt(np.clip(np.diag(cov), 0, None))
    moves = deviation[:-1] > 1e-9 * np.maximum(1, np.abs(mean[:-1]))
    out = np.zeros(len(mean) - 1)
    if deviation[-1] > 0 and moves.any():
        scale = deviation[:-1][moves]
        matrix = cov[:-1, :-1][np.ix_(moves, moves)] / np.outer(scale, scale) + np.eye(moves.sum()) * penalty / deviation[-1]
        target = cov[:-1, -1][moves] / (scale * deviation[-1])
        out[moves] = np.linalg.lstsq(matrix, target, rcond=None)[0] * deviation[-1] / scale
    return out, float(mean[-1] - out @ mean[:-1])


def r2_of(sums: np.ndarray, coefficients: np.ndarray, intercept: float) -> float:
    """Share of the spread that a line explains on the rows behind the sums."""
    line = np.r_[-intercept, -coefficients, 1.0]
    spread = sums[-1, -1] - sums[0, -1] ** 2 / sums[0, 0] if sums[0, 0] > 0 else 0.0
    return float(1 - line @ sums @ line / spread) if spread > 0 else float("nan")


def ridge_from_sums(df: DataFrame, penalties: list[float], fold: str, n_folds: int, **columns) -> Line:
    """The line with the penalty that explains most on held-out folds, fitted on all rows; ties take the smaller penalty."""
    sums = fold_sums(df, fold, n_folds, **columns)
    whole = sums.sum(axis=0)
    scores = {}
    for p in penalties:
        known = [x for k in range(n_folds) if np.isfinite(x := r2_of(sums[k], *solve(whole - sums[k], p)))]
        scores[p] = float(np.mean(known)) if known else float("nan")
    best = min(penalties, key=lambda p: (-scores[p] if scores[p] == scores[p] else np.inf, p))
    return Line(*solve(whole, best), best, scores)

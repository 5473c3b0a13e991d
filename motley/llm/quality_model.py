"""Quality classifier: regularised quadratic discriminant over statistics of the text.

Statistics and scores are built-in expressions; Spark sums the moments of the labelled rows
in one pass. Each class covariance is shrunk towards the pooled one and towards a multiple
of the identity, factored once by Cholesky, and the inverse factors are kept: the score is the
difference of two squared lengths, which are Mahalanobis distances, and of log determinants.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motley.llm.common import has_word, let, temporary, whole, words
from motley.llm.quality_rules import STOP_FORMS

FEATURES = ["log_words", "log_word_length", "symbols", "marks", "capitals", "digits", "distinct", "repeats",
            "stop_words", "punctuation", "log_line_words"]
POOLED, SPHERICAL, SOFTNESS, CUT = 0.2, 0.02, 4.0, 0.7


def _left(text: Column, other: str) -> Column:
    """Characters that remain without those of a class."""
    return F.length(F.regexp_replace(text, other, ""))


def statistics(text: Column) -> Column:
    """Array of the transformed statistics; a text without a word gives zeros."""
    def of(t, w):
        n, chars = F.size(w), F.length(F.array_join(w, ""))

        def share(count, per):
            return F.sqrt(count.cast("double") / F.greatest(per, F.lit(1)))

        lines = F.size(F.filter(F.split(t, "\n"), has_word))
        return F.array(
            F.log1p(n.cast("double")), F.log(F.greatest(chars, F.lit(1)) / F.greatest(n, F.lit(1))),
            share(_left(t, r"[^#*$%&|<>]+"), n), share(_left(t, r"[^!?]+"), n), share(_left(t, r"[^\p{Lu}]+"), chars),
            share(_left(t, r"[^0-9]+"), chars), F.size(F.array_distinct(w)) / F.greatest(n, F.lit(1)),
            share(F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i + 1), F.lit(False)))), n),
            F.size(F.filter(w, lambda x: x.isin(STOP_FORMS))) / F.greatest(n, F.lit(1)),
            share(_left(t, r"[^.,;:]+"), n), F.log1p(n / F.greatest(lines, F.lit(1))))

    return let(whole(text), lambda t: let(words(t), lambda w: of(t, w)))


@dataclass
class Model:
    """Means, inverse Cholesky factors and log constants of the classes 0 and 1."""

    means: np.ndarray
    inverse: np.ndarray
    constant: np.ndarray

    @classmethod
    def of_moments(cls, count, total, product, pooled: float = POOLED, spherical: float = SPHERICAL) -> Model:
        """From per-class counts, sums and sums of products."""
        count, total, product = np.asarray(count, float), np.asarray(total, float), np.asarray(product, float)
        means = total / count[:, None]
        own = product / count[:, None, None] - means[:, :, None] * means[:, None, :]
        common = np.einsum("k,kij->ij", count / count.sum(), own)
        inverse, constant, size = [], [], total.shape[1]
        for k in range(2):
            mixed = (1 - pooled) * own[k] + pooled * common
            level = max(np.trace(mixed) / size, 1e-9)
            factor = np.linalg.cholesky((1 - spherical) * mixed + spherical * level * np.eye(size))
            inverse.append(np.linalg.inv(factor))
            constant.append(np.log(count[k] / count.sum()) - np.log(np.diag(factor)).sum())
        return cls(means, np.array(inverse), np.array(constant))

    def log_density(self, x: Column, k: int) -> Column:
        square = F.lit(0.0)
        for row in range(self.means.shape[1]):
            z = F.lit(0.0)
            for col in range(row + 1):
                z = z + (x[col] - F.lit(float(self.means[k, col]))) * F.lit(float(self.inverse[k, row, col]))
            square = square + z * z
        return F.lit(float(self.constant[k])) - square / 2

    def score(self, text: Column) -> Column:
        """Between 0 and 1, higher where class 1 is likelier; 0 for a text without a word."""
        def of(x):
            odds = (self.log_density(x, 1) - self.log_density(x, 0)) / SOFTNESS
            bounded = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))
            return F.when(x[0] > 0, 1 / (1 + F.exp(-bounded))).otherwise(0.0)

        return let(statistics(text), of)


@dataclass
class Constant:
    """Stands in for a model where the labels show one class only or none."""

    value: float

    def score(self, text: Column) -> Column:
        return F.lit(float(self.value))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Model | Constant:
    """The model of all labelled rows that are not held out.

    A document counts only if its labels are 0 or 1 and all alike. With fewer than two
    documents of a class nothing can be told apart: every score is then the share of 1
    among the labelled rows, or 1 if there are none.
    """
    said = (labels.select(labels[id_col].alias("id"), labels[label_col].alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
            .where(~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top"))
            .where("y = top").select("id", "y"))
    size = len(FEATURES)
    rows = (docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where(~held_out(F.col("id")))
            .select("id", statistics(F.col("text")).alias("x")).join(said, "id"))
    sums = [F.sum(F.col("x")[i]) for i in range(size)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(size) for j in range(i + 1)]
    found = {r[0]: r[1:] for r in rows.groupBy("y").agg(F.count("*"), *sums, *products).collect()}
    seen = [found[y][0] if y in found else 0 for y in (0, 1)]
    if min(seen) < 2:
        return Constant(seen[1] / sum(seen) if sum(seen) else 1.0)
    product = np.zeros((2, size, size))
    for y in (0, 1):
        at = iter(found[y][1 + size:])
        for i in range(size):
            for j in range(i + 1):
                product[y, i, j] = product[y, j, i] = next(at)
    return Model.of_moments([found[y][0] for y in (0, 1)], [found[y][1:1 + size] for y in (0, 1)], product)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """(id, held_out, score, predicted): one row per input row, learnt from ``labels`` by id.

    ``predicted`` is 1 from a score of ``cut`` on. Null and empty texts score 0. A null id is
    not held out and has no label; repeated rows are scored alike; an empty table gives no
    rows; other columns are never read, so they cannot be inputs.
    """
    model = fit(docs, labels, id_col, text_col)
    scored = docs.select(docs[id_col].alias(id_col), model.score(docs[text_col]).alias("score"))
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows that score ``cut`` or more, with all their columns unchanged."""
    flag = temporary(docs.columns, "_good")
    score = fit(docs, labels, id_col, text_col).score(docs[text_col])
    return docs.withColumn(flag, score >= cut).where(F.col(flag)).drop(flag)

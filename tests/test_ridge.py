"""Ridge from fold sums against Spark's own solver and row by row."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from motley.plans import ridge as rg


def data(spark, n=300, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)) * [1, 10, 0.1, 1, 0] + [0, 5, 0, 2, 3]
    y = x @ [2, 0.3, 5, 0, 1] + rng.normal(size=n)
    w = rng.integers(1, 5, n).astype(float)
    rows = [(int(i % 3), [float(v) for v in a], float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w))]
    return x, y, w, spark.createDataFrame(rows, "fold int, features array<double>, label double, n double").repartition(4)


@pytest.mark.parametrize("penalty", [0.0, 0.1, 10.0])
def test_equal_to_sparks(spark, penalty):
    *_, df = data(spark)
    line = rg.ridge_from_sums(df, [penalty], "fold", 3)
    model = LinearRegression(elasticNetParam=0.0, regParam=penalty, weightCol="n", solver="normal").fit(
        df.withColumn("features", array_to_vector("features")))
    assert line.coefficients == pytest.approx(model.coefficients.toArray(), abs=1e-6) and line.intercept == pytest.approx(model.intercept, abs=1e-6)


def test_folds_and_choice(spark):
    x, y, w, df = data(spark)
    line = rg.ridge_from_sums(df, [0.01, 1.0, 1000.0], "fold", 3)
    fold = np.arange(len(y)) % 3
    for p, got in line.r2.items():
        scores = []
        for k in range(3):
            both = np.column_stack([np.ones(len(y)), x, y])[fold != k]
            c, b = rg.solve((both * w[fold != k, None]).T @ both, p)
            t = fold == k
            mean = np.average(y[t], weights=w[t])
            scores.append(1 - (w[t] * (y[t] - x[t] @ c - b) ** 2).sum() / (w[t] * (y[t] - mean) ** 2).sum())
        assert got == pytest.approx(np.mean(scores))
    assert line.penalty == 0.01 and line.r2[0.01] > 0.5 > line.r2[1000.0]
    found = line.predict(df).select("features", "prediction").collect()
    assert all(r.prediction == pytest.approx(np.dot(r.features, line.coefficients) + line.intercept) for r in found)


def test_one_scan_and_odd_rows(spark):
    *_, df = data(spark, 60)
    odd = spark.createDataFrame([(0, None, 1.0, 1.0), (1, [None] * 5, 1.0, 1.0), (7, [1.0] * 5, 1.0, 1.0), (0, [1.0] * 5, None, 1.0),
                                 (None, [1.0] * 5, 1.0, 1.0), (0, [1.0] * 5, 1.0, None)], df.schema)
    assert rg.fold_sums(df.unionByName(odd), "fold", 3) == pytest.approx(rg.fold_sums(df, "fold", 3))
    none = rg.ridge_from_sums(df.limit(0), [0.1], "fold", 3)
    assert none.intercept == 0 and none.penalty == 0.1
    assert rg.ridge_from_sums(df, [0.1], "fold", 3).predict(odd).where("prediction IS NULL").count() >= 2
    flat = rg.ridge_from_sums(df.withColumn("label", F.lit(4.0)), [0.1], "fold", 3)
    assert flat.intercept == pytest.approx(4.0) and np.allclose(flat.coefficients, 0)

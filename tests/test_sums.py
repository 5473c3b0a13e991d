"""Errors from sums against errors row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motley.operators import aggregates as agg
from motley.plans import evaluate as ev

SCHEMA = "row_id INT, table_id INT, key STRING, raw STRING, exp INT, y DOUBLE"


def data(spark, n=400, seed=2):
    """Few keys, one of them common and one null, repeated and missing outcomes."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        key = None if i % 17 == 0 else ("common" if i % 3 else f"k{rng.integers(5)}")
        y = None if i % 13 == 0 else float(rng.integers(0, 30)) * (1 if i % 2 else 10)
        rows.append((i, int(rng.integers(4)), key, f"{key}-{rng.integers(3)}", None if i % 29 == 0 else int(rng.integers(3)), y))
    splits = [(s, t, int(t in x)) for s, x in enumerate(([0], [1, 2], [3, 0])) for t in range(4)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(splits, "split_id INT, table_id INT, is_test INT")


@pytest.mark.parametrize("task, exp", [("salary", "exp"), ("salary", None), ("quantile", None)])
@pytest.mark.parametrize("buckets", [2, 64])
def test_error_sums(spark, monkeypatch, task, exp, buckets):
    monkeypatch.setattr(ev.absolute_error_sums, "__defaults__", (buckets,))
    df, splits = data(spark)
    rows = ev.cv_errors(df, splits, "key", exp, "y", task).where("error IS NOT NULL")
    want = {r.split_id: (r.n, r.rmse, r.mae) for r in rows.groupBy("split_id").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.col("error") ** 2)).alias("rmse"), F.avg("error").alias("mae")).collect()}
    sums = ev.error_sums(df, splits, "key", exp, "y", task, absolute=True)
    got = {r.split_id: (r.n, r.rmse, r.mae) for r in ev.mean_errors(sums, ["split_id"]).collect()}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_errors_by_variants(spark):
    df, splits = data(spark)
    rows = ev.cv_errors(df, splits, "key", "exp", "y").where("error IS NOT NULL").alias("r")
    known = ev.n_variants(df, splits, ["key", "exp"], ["raw", "exp"])
    want = {}
    seen = {(r.split_id, r.key, r.exp): r.n_variants for r in known.collect()}
    for r in rows.collect():
        kind = ["none", "one"][seen[r.split_id, r.key, r.exp]] if seen[r.split_id, r.key, r.exp] < 2 else "many"
        want.setdefault((r.split_id, kind), []).append(r.error)
    got = {(r.split_id, r.seen): (r.n, r.mae) for r in ev.error_by_variants(df, splits, "key", "exp", "y", "raw").collect()}
    assert got == {k: (len(v), pytest.approx(np.mean(v))) for k, v in want.items()}


def test_no_rows(spark):
    df, splits = data(spark)
    assert ev.error_sums(df.limit(0), splits, "key", "exp", "y", absolute=True).count() == 0
    none = ev.error_sums(df.withColumn("y", F.lit(None).cast("double")), splits, "key", "exp", "y", absolute=True)
    assert none.count() == 0


@pytest.mark.parametrize("buckets", [3, 1024])
def test_average_precision_with_an_outlier(spark, buckets):
    """One far score leaves the others in buckets of about the same size; ties count together."""
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(2)), float(rng.integers(300)) / 100) for _ in range(2_000)] + [(1, 1e12), (0, -1e12)]
    scores = sorted({s for _, s in rows}, reverse=True)
    seen = hits = want = 0
    for s in scores:
        here = [y for y, x in rows if x == s]
        seen, hits = seen + len(here), hits + sum(here)
        want += hits / seen * sum(here) / sum(y for y, _ in rows)
    df = spark.createDataFrame([*rows, (1, None)], "y INT, score DOUBLE")
    assert ev.average_precision(df, "y", "score", buckets).first()[0] == pytest.approx(want)
    assert ev.average_precision(df.where("y = 0"), "y", "score").first()[0] == 0


def test_merged_sketches(spark):
    """The rank of every merged estimate is near the wanted one, and small groups are exact up to the next value."""
    rng = np.random.default_rng(3)
    rows = [(t, "ab"[i % 2] if i % 50 else None, float(rng.exponential(100))) for t in range(4) for i in range(5_000)] + [(0, "c", None), (0, "d", 7.0)]
    df = spark.createDataFrame(rows, "table_id INT, k STRING, y DOUBLE")
    sketches = agg.quantile_sketches(df.repartition(6), ["table_id", "k"], "y")
    for q in (0.1, 0.75):
        for r in agg.sketched_quantile(sketches, ["k"], q).collect():
            values = np.array([y for _, k, y in rows if k == r.k and y is not None])
            assert r.n == len(values) and abs((values <= r.estimate).mean() - q) < 0.03 or len(values) == 1 and r.estimate == 7.0
    assert agg.sketched_quantile(sketches, ["k"], 0.5).count() == 4

"""Rows are read no more often than a query needs them, and samples do not shuffle them."""

import importlib

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from motley.operators import sampling
from motley.sources.people import people

QUERIES = queries()


@pytest.mark.parametrize("name, module, key, reads", [
    ("boosted_salary", "learning", "title", 2), ("boosted_propensity", "learning", "title", 3), ("predict_curve", "learning", "title", 3),
    ("ridge", "learning", "title", 1), ("column_pipeline", "encoders", "job_title", 1)])
def test_rows_are_read_once(spark, sf, monkeypatch, name, module, key, reads):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(title):
        seen.add(1)
        return title

    counted = counted.asNondeterministic()
    monkeypatch.setattr(importlib.import_module(f"catalog.{module}"), "people",
                        lambda s, folder, *columns: people(s, folder, *columns).withColumn(key, counted(key)))
    assert QUERIES[name](spark, sf).count() > 0
    assert 0 < seen.value <= reads * people(spark, sf, "row_id").count()


def test_sampled_rows_stay_in_place(spark):
    """Strata are few: rows meet their cut without a shuffle, which would bring a whole stratum to one task."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(4000).select("id", (F.col("id") % 2).alias("side"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("kind"))
        kept = sampling.stratified_downsample(rows, ["side", "kind"], "id", F.lit(0.25))
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
        sizes = {(r["side"], r["kind"]): r["count"] for r in rows.groupBy("side", "kind").count().collect()}
        assert {(r["side"], r["kind"]): r["count"] for r in kept.groupBy("side", "kind").count().collect()} == {
            k: n - int(n * 0.25) for k, n in sizes.items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

"""Sources, dictionaries, aggregates, splits, streaming and plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from motley.functions import hashing
from motley.operators import aggregates as agg
from motley.operators import dictionary as dic
from motley.operators import sampling
from motley.operators import vector_join as vec
from motley.plans import evaluate as ev
from motley.plans import learners as ml
from motley.sources import files, ingest
from motley.sources.specs import ETHNICITY_CODES, SPECS, catalog_specs
from motley.streaming import chunks as ch
from motley.workdir import fresh_path


def spec(name):
    return next(s for s in SPECS if s.name == name)


def raw(spark, s, rows):
    columns = [*s.columns().values(), *([s.full_time[0]] if s.full_time else [])]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` STRING" for c in columns))


def cleaned(spark, name, rows):
    s = spec(name)
    return ingest.clean_source(raw(spark, s, rows), s, 3).collect()


def test_source_rows(spark):
    rows = [
        ("51000,5", "Mgr,  II", "01/02/2001", "M", "White", "Full Time"),
        ("51000,5", "Mgr", "01/02/2001", "F", None, "Full Time"),
        ("51000,5", "Mgr", "01/02/2001", "F", "White", "Part Time"),
    ]
    assert [tuple(r) for r in cleaned(spark, "austin_city", rows)] == [(3, 51000.5, "mgr ii", 18, 1, "White", "city")]


def test_special_sources(spark):
    hourly = cleaned(spark, "dallas_city", [("20,5", "a", "01/02/2001", "M", "x", "2080", "Active Full-time (Permanent)"),
                                            ("300", "b", "01/02/2001", "F", "x", "2080", "Active Full-time (Permanent)")])
    assert [r["salary"] for r in hourly] == [20.5 * 2080, 300.0]
    assert len(cleaned(spark, "houston_city", [("0", "a", "01/02/2001", "Male", "x", "Full Time")])) == 0
    assert cleaned(spark, "texas_state", [("5", "a", "01/02/85", "Male", "x", "40")])[0]["seniority"] == 34
    assert cleaned(spark, "ut_am", [("5", "a", "2 Jan 2009", "Male", "x", "F")])[0]["seniority"] == 10
    assert cleaned(spark, "ut_galveston", [("5", "a", "01/02/2009 00:00", "Male", "x", "Full-time")])[0]["seniority"] == 10
    assert cleaned(spark, "ut_sw_medical", [("5", "a", "01/02/2009", "Male", "Full-Time")])[0]["ethnicity"] is None


def test_latin1_round_trip(spark):
    path = fresh_path(spark, "latin")
    files.write_delimited(spark.createDataFrame([("Señor, \"é\"",)], "t STRING"), path, encoding="ISO-8859-1")
    assert files.read_delimited(spark, path, encoding="ISO-8859-1").first()["t"] == "Señor, \"é\""


def test_catalog_names():
    assert len(catalog_specs()) == 14 and len(catalog_specs(["ut_am"])) == 13
    assert len(ETHNICITY_CODES) == 68 and set(ETHNICITY_CODES.values()) == {-1, 1, 2, 3, 4, 5, 6}
    with pytest.raises(ValueError):
        catalog_specs(["nowhere"])


def test_unmapped_codes(spark):
    rows = spark.createDataFrame([("White",), ("??",)], "e STRING")
    assert [r[0] for r in rows.select(ingest.ethnicity_code(F.col("e"), "null")).collect()] == [1, None]
    with pytest.raises(Exception, match="no code"):
        rows.select(ingest.ethnicity_code(F.col("e"))).collect()


def test_dense_ids(spark):
    values = [f"v{i:04d}" for i in range(1000)]
    rows = spark.createDataFrame([(v,) for v in values * 2], "v STRING")
    by_value = {r["v"]: r["id"] for r in dic.dense_ids(rows, "v", "value", 0, buckets=7).collect()}
    assert by_value == {v: i for i, v in enumerate(values)}
    by_hash = [r["id"] for r in dic.dense_ids(rows, "v", "hash").orderBy("v").collect()]
    assert sorted(by_hash) == list(range(1, 1001)) and by_hash != sorted(by_hash)


@pytest.mark.parametrize("buckets", [128, 3])
def test_group_quantile(spark, buckets):
    rng = np.random.RandomState(0)
    data = [("hot", float(x)) for x in np.round(rng.lognormal(3, 2, 3000), 1)] + [("one", 5.0), ("two", 1.0), ("two", 2.0)]
    rows = spark.createDataFrame(data, "k STRING, y DOUBLE")
    for q in (0.0, 0.25, 0.75, 1.0):
        got = {r["k"]: r["estimate"] for r in agg.group_quantile(rows, ["k"], "y", q, buckets).collect()}
        for k in ("hot", "one", "two"):
            assert got[k] == pytest.approx(np.quantile([y for kk, y in data if kk == k], q))


@pytest.mark.parametrize("buckets", [128, 3])
def test_null_groups_are_kept(spark, buckets):
    rows = spark.createDataFrame([(None, 1.0, 1), (None, 3.0, 2), ("a", 5.0, 3)], "k STRING, y DOUBLE, id INT")
    got = {r["k"]: r["estimate"] for r in agg.group_quantile(rows, ["k"], "y", 0.5, buckets).collect()}
    assert got == {None: 2.0, "a": 5.0}
    kept = sampling.stratified_downsample(rows, ["k"], "id", F.lit(0.5), hashing.mixed_hash(F.col("id"), 1))
    assert sorted(str(r["k"]) for r in kept.collect()) == ["None", "a"]
    folds = sampling.stratified_kfold(rows, "id", "k", 2, hashing.mixed_hash(F.col("id"), 1))
    assert folds.count() == 3


def test_run_summary_drops_what_is_not_finite(spark):
    rows = spark.createDataFrame([("m", x) for x in (1.0, 2.0, 3.0, float("nan"), float("inf"), -float("inf"))], "m STRING, ate DOUBLE")
    got = agg.run_summary(rows, ["m"], "ate").first()
    assert (got["mean"], got["upper"], got["lower"], got["runs"]) == (2.0, 2.5, 1.5, 3)


def test_folds(spark):
    rows = spark.range(1003).withColumn("label", F.pmod("id", F.lit(3)))
    out = sampling.stratified_kfold(rows, "id", "label", 5, hashing.mixed_hash(F.col("id"), 1))
    sizes = [r["count"] for r in out.groupBy("label", "fold").count().collect()]
    assert len(sizes) == 15 and sum(sizes) == 1003 and max(sizes) - min(sizes) <= 1
    tests = sampling.group_shuffle_split(list(range(14)), 40, 7)
    assert all(len(set(t)) == 7 for t in tests) and len({tuple(t) for t in tests}) > 30
    assert sampling.leave_one_group_out([2, 0]) == [[0], [2]]


def test_average_precision(spark):
    y, s = [1, 0, 1, 1, 0, 0], [0.9, 0.8, 0.7, 0.7, 0.2, 0.1]
    rows = spark.createDataFrame(list(zip(y, s)), "y INT, s DOUBLE")
    assert ev.average_precision(rows, "y", "s").first()[0] == pytest.approx(1 / 3 * 1 + 2 / 3 * 3 / 4)
    hard = spark.createDataFrame(list(zip([1, 0, 1, 0], [1, 1, 0, 0])), "y INT, s INT")
    assert ev.average_precision(hard, "y", "s").first()[0] == pytest.approx(0.5)


def test_knn(spark):
    rows = spark.createDataFrame([(f"p{i}", [float(i), 0.0]) for i in range(30)], "k STRING, v ARRAY<DOUBLE>").repartition(5)
    got = vec.knn_values(rows, "k", "v", [("q", [10.2, 0.0])], 3).orderBy("rank").collect()
    assert [r["value"] for r in got] == ["p10", "p11", "p9"]


def test_quantile_boosting_covers(spark):
    rng = np.random.RandomState(1)
    x = rng.randint(0, 4, 2000)
    y = 10.0 * x + rng.uniform(0, 8, 2000)
    from pyspark.ml.functions import array_to_vector
    rows = spark.createDataFrame([(float(a), float(b), 1) for a, b in zip(x, y)], "x DOUBLE, y DOUBLE, n INT").withColumn(
        "features", array_to_vector(F.array("x")))
    boost = ml.boosted_quantile(rows, "y", 0.75, rounds=6, lr=0.5, depth=2, save_every=3)
    under = boost.predict(rows).agg(F.avg((F.col("y") <= F.col("prediction")).cast("int"))).first()[0]
    assert 0.65 < under < 0.85


def chunked(spark, rows, schema, parts):
    path = fresh_path(spark, "source")
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return ch.read_chunks(spark, path, spark.read.parquet(path).schema)


def test_stream_of_chunks(spark):
    rows = [(i, "ab"[i % 2], float(i)) for i in range(100)]
    stream = chunked(spark, rows, "i INT, c STRING, y DOUBLE", 4)
    path = fresh_path(spark, "chunks")
    ch.scan_chunks(stream, path)
    back = spark.read.parquet(path)
    assert back.count() == 100 and back.select("chunk").distinct().count() == 4
    stats = ch.stream_target_stats(stream, "c", "y", fresh_path(spark, "stats"))()
    assert {r["c"]: (r["n"], r["mean"]) for r in stats.collect()} == {"a": (50, 49.0), "b": (50, 50.0)}


def test_online_linear_learns(spark):
    rng = np.random.RandomState(0)
    x = rng.normal(size=(600, 3))
    y = (x @ [2.0, -1.0, 0.5] + 0.3 > 0).astype(int)
    stream = chunked(spark, [([float(v) for v in a], int(b)) for a, b in zip(x, y)], "x ARRAY<DOUBLE>, y INT", 3)
    model = ch.online_linear(stream, "x", "y", 3, fresh_path(spark, "online"), steps=10)
    data = spark.createDataFrame([([float(v) for v in a], int(b)) for a, b in zip(x, y)], "x ARRAY<DOUBLE>, y INT")
    assert ev.accuracy(model.predict(data, "x"), "y", "prediction").first()[0] > 0.9


@pytest.mark.parametrize("name", [
    "exact_matching_gap", "estimate_lookup", "kernel_join", "fuzzy_opposite_gap", "fuzzy_aipw", "cv_errors",
    "tune_threshold", "similarity_encode", "sensitivity_sweep", "variant_lookup", "group_quantile"])
def test_no_all_pairs_join_in_plan(spark, sf, name, capsys):
    queries()[name](spark, sf).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

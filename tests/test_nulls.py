"""No row is lost for a null key, a title without a vector or an unknown outcome."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motley.operators import aggregates as agg
from motley.operators import encoders as enc
from motley.operators import lookups as look
from motley.operators.dictionary import canonicalize_by_words
from motley.operators.sampling import stratified_downsample, stratified_kfold
from motley.operators.vector_join import embed_titles, knn_values, nearest_prototype, similar_pairs
from motley.plans import evaluate as ev
from motley.plans import gap
from motley.plans import learners as ml

TITLES = ["police officer", "officer police", "bus driver", "unheard title", "zero word", None]


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.RandomState(4)
    rows = []
    for i in range(240):
        salary = None if i % 7 == 0 else float(rng.randint(20, 90) * 1000)
        rows.append((i, i % 4, TITLES[i % 6], None if i % 11 == 0 else int(rng.randint(1, 6)), "ab"[i % 2],
                     None if i % 13 == 0 else "xy"[i % 2], int(rng.randint(0, 2)), salary))
    return spark.createDataFrame(rows, "row_id long, table_id int, title string, seniority int, employer string, "
                                       "ethnicity string, gender int, salary double").cache()


@pytest.fixture(scope="module")
def vectors(spark, people):
    words = spark.createDataFrame([("police", [1.0, 0.0]), ("officer", [0.8, 0.6]), ("bus", [0.0, 1.0]), ("driver", [0.6, 0.8]),
                                   ("zero", [0.0, 0.0]), ("word", [0.0, 0.0])], "word string, vector array<double>")
    return embed_titles(people, "title", words).cache()


@pytest.fixture(scope="module")
def similar(vectors):
    return similar_pairs(vectors, "title", "vector", 0.5).cache()


def test_every_title_is_near_itself(similar, vectors):
    assert vectors.count() == 5
    assert {r.title for r in similar.where("title = other AND cos > 0.999").collect()} == set(TITLES) - {None}


def test_gaps_count_every_row(people, similar, vectors):
    assert gap.fuzzy_aipw(people, similar, 0.5).first().n_rows == 240
    assert gap.fuzzy_opposite_gap(people, similar, 0.5).first().n_rows == 240
    assert gap.exact_matching_gap(people).first().n_rows == 240
    done = ml.aipw(people, vectors, rounds=2, depth=2).first()
    assert done.n_rows == 240 and np.isfinite(done.ate)


def test_cells_keep_sizes_and_known_means(people):
    got = agg.cells(people, gap.COVARIATES)
    want = people.groupBy(*gap.COVARIATES).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("gender") == 1, F.col("salary"))).alias("y1"),
        F.avg(F.when(F.col("gender") == 0, F.col("salary"))).alias("y0"))
    pick = lambda d: sorted(map(str, d.select(*gap.COVARIATES, "n", F.round("y1", 6), F.round("y0", 6)).collect()))
    assert pick(got) == pick(want) and got.agg(F.sum("n")).first()[0] == 240


def test_grain_means(people):
    grains = agg.multi_grain_estimates(people, "title", "seniority", "salary").collect()
    want = {(r.title, r.seniority): r.m for r in people.groupBy("title", "seniority").agg(F.avg("salary").alias("m")).collect()}
    for r in grains:
        if r.grain == "key_exp":
            assert r.estimate == pytest.approx(want[r.title, r.seniority])
    assert sum(r.n for r in grains if r.grain == "key_exp") == 240
    whole = next(r for r in grains if r.grain == "all")
    assert whole.estimate == pytest.approx(people.agg(F.avg("salary")).first()[0])


@pytest.mark.parametrize("kernel", [False, True])
def test_errors_of_every_test_row(spark, people, similar, kernel):
    splits = spark.createDataFrame([(0, t, int(t >= 2)) for t in range(4)], "split_id int, table_id int, is_test int")
    more = {"similar": similar, "threshold": 0.5} if kernel else {}
    out = ev.cv_errors(people, splits, "title", "seniority", "salary", **more).toPandas()
    assert len(out) == 120 and (out.error.isna() == out.salary.isna()).all()
    got = ev.cv_rmse(people, splits, "title", "seniority", "salary").first()
    assert got.n == int(out.salary.notna().sum())


def test_squared_errors_agree(spark, people):
    splits = spark.createDataFrame([(0, t, int(t >= 2)) for t in range(4)], "split_id int, table_id int, is_test int")
    rows = ev.cv_errors(people, splits, "title", "seniority", "salary").toPandas()
    assert ev.cv_rmse(people, splits, "title", "seniority", "salary").first().rmse == pytest.approx((rows.error ** 2).mean() ** 0.5)


def test_learned_answers_for_every_row(people, vectors):
    model = ml.boosted_salary(people, vectors, rounds=2, depth=2)
    assert model.transform(people).where("prediction IS NOT NULL").count() == 240
    share = ml.boosted_propensity(people, vectors, rounds=2, depth=2).transform(people)
    assert share.select(ml.probability()).where("propensity BETWEEN 0 AND 1").count() == 240


def test_kernel_and_variants_of_null_titles(people, similar):
    grains = look.grain_estimates(people, "title", "seniority", "salary")
    asked = people.select("title", "seniority").distinct()
    out = look.kernel_join(asked, grains, similar, 0.5, "title", "seniority")
    assert out.count() == asked.count() == out.where("estimate IS NOT NULL").count()
    assert canonicalize_by_words(people, "title").count() == 240


def test_target_mean_of_known_targets(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0), (None, 2.0)], "c string, y double")
    model = enc.TargetMeanEncoder("c", "y").fit(rows)
    assert model.prior_ == pytest.approx([2.0]) and model.transform(rows).where("encoded IS NOT NULL").count() == 4


def test_minhash_groups_lose_no_pair(spark):
    values = [f"senior project manager {x}" for x in "abcdefg"] + ["bus driver", "bus drivers", "nurse"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.value: r.representative for r in enc.minhash_candidates(df, "v").collect()}
    signed = {r.v: r.h for r in df.select("v", enc.minhash(F.col("v"), 20, (3, 3)).alias("h")).collect()}
    label = {v: v for v in values}
    for _ in values:
        for a in values:
            for b in values:
                if any(signed[a][i:i + 2] == signed[b][i:i + 2] for i in range(0, 20, 2)):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == {v: g for v, g in label.items() if list(label.values()).count(g) > 1}


def test_default_hash_samples_exactly(spark):
    rows = spark.range(5_000).select((F.col("id") * 1_000_003).alias("id"), F.pmod("id", F.lit(3)).alias("k"))
    kept = stratified_downsample(rows, ["k"], "id", F.lit(0.25)).groupBy("k").count().collect()
    assert sorted((r.k, r["count"]) for r in kept) == [(0, 1251), (1, 1251), (2, 1250)]
    folds = stratified_kfold(rows, "id", "k", 5).groupBy("k", "fold").count().toPandas()
    assert folds.groupby("k")["count"].agg(lambda c: c.max() - c.min()).max() <= 1


def test_quantiles_of_uneven_values(spark):
    rng = np.random.RandomState(0)
    values = {"one": [5.0], "outlier": [*rng.rand(999), 1e12], "ties": [1.0] * 50 + [2.0] * 51, "wide": list(rng.lognormal(0, 4, 3_000)),
              None: list(rng.rand(40))}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("one", None)], "k string, y double")
    for q in (0.0, 0.3, 0.75, 1.0):
        for r in agg.group_quantile(df, ["k"], "y", q, buckets=8).collect():
            assert r.estimate == pytest.approx(np.quantile(values[r.k], q), rel=1e-9) and r.n == len(values[r.k])


@pytest.fixture(scope="module")
def gappy(spark):
    rows = [(i, None if i % 5 == 0 else [float(i % 7), None if i % 11 == 0 else 1.0] + [0.5] * (i == 13), i % 2) for i in range(40)]
    return spark.createDataFrame(rows, "id long, v array<double>, y int"), {i for i in range(40) if i % 5 and i % 11 and i != 13}


def test_rows_without_a_vector(spark, gappy):
    df, known = gappy
    near = knn_values(df, "id", "v", [("q", [3.0, 1.0])], 50).collect()
    assert {r.value for r in near} == known
    assert nearest_prototype(df, "id", "v", [[6.0, 1.0]]).first().value in {i for i in known if i % 7 == 6}
    same = df.where("id <> 13")  # one size
    made = {r.id: r.features for r in enc.rbf_features(same, "v", 6, 0.5).collect()}
    assert {i for i, f in made.items() if f is not None} == known and all(len(made[i]) == 6 for i in known)
    assert enc.rbf_features(same.where("v IS NULL"), "v", 6, 0.5).where("features IS NULL").count() == 8


def test_classifiers_without_a_vector(spark, gappy):
    df, known = gappy
    same = df.where("id <> 13").withColumn("y", F.when(F.col("id") == 1, None).otherwise((F.element_at("v", 1) > 3).cast("int")))
    same = same.withColumn("y", F.coalesce("y", F.when(F.col("id") != 1, 0)))
    found = {r.id: r.prediction for r in ml.kernel_classifier(same, "v", "y", 20, 0.5)(same).collect()}
    assert len(found) == 39 and {i for i, p in found.items() if p is not None} == known


def test_quantiles_of_counted_rows(spark):
    """A value may come in several rows; no row passes a sketch per key or meets the buckets of its key."""
    rng = np.random.RandomState(3)
    rows = [(k, float(v), int(w)) for k in ("a", None) for v, w in zip(rng.randint(0, 700, 2_000), rng.randint(0, 4, 2_000))]
    df = spark.createDataFrame(rows + [("a", None, 5), ("none", 1.0, 0)], "k string, y double, w int")
    for q in (0.0, 0.75, 1.0):
        found = agg.group_quantile(df, ["k"], "y", q, weight="w")
        got = {r.k: (r.estimate, r.n) for r in found.collect()}
        for k in ("a", None):
            every = np.repeat([v for kk, v, _ in rows if kk == k], [w for kk, _, w in rows if kk == k])
            assert got.pop(k) == (pytest.approx(np.quantile(every, q)), len(every))
        assert not got
    plan = found._jdf.queryExecution().toString()
    assert "percentile_approx" not in plan and "_bounds" not in plan

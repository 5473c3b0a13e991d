"""Models written and read back, and streams that stop and go on."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Observation
from pyspark.sql import functions as F

from motley.operators import encoders as enc
from motley.operators import topics as top
from motley.plans import learners as ml
from motley.streaming import chunks as ch

WORDS = ["police officer", "police sergeant", "senior police officer", "bus driver", "bus operator", "truck driver"]


def test_streams_go_on(spark, tmp_path):
    """Two calls with a chunk each give what one call with both gives, with words the first has not met."""
    first = spark.createDataFrame([(w,) for w in WORDS[:3] * 4], "v string")
    second = spark.createDataFrame([(w,) for w in WORDS * 3], "v string")
    params = top.TopicParams(n_topics=3, hashing=False, init="random")
    folders = {}
    for name in ("once", "twice"):
        source = f"{tmp_path}/{name}-source"
        for k, rows in enumerate((first, second)):
            rows.coalesce(1).write.mode("append").parquet(source)
            if name == "twice" or k == 1:
                read = ch.read_chunks(spark, source, "v string")
                folders[name] = ch.stream_topics(read, "v", params, f"{tmp_path}/{name}")
    once, twice = (top.topic_table(folders[x]).toPandas().sort_values(["topic", "gram"]) for x in ("once", "twice"))
    assert np.allclose(once.weight, twice.weight) and (once.gram.to_numpy() == twice.gram.to_numpy()).all()
    assert {"bu", "driv"} <= set(twice.gram) and np.allclose(folders["once"].b, folders["twice"].b)
    again = ch.stream_topics(ch.read_chunks(spark, f"{tmp_path}/twice-source", "v string"), "v", params, f"{tmp_path}/twice")
    assert np.allclose(again.b, folders["twice"].b)  # nothing new, nothing done


def test_online_linear_goes_on(spark, tmp_path):
    rng = np.random.RandomState(1)
    x = rng.normal(size=(300, 4))
    rows = spark.createDataFrame([(v.tolist(), int(v[0] > 0)) for v in x], "x array<double>, y int")
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
        model = ch.online_linear(ch.read_chunks(spark, f"{tmp_path}/rows", rows.schema), "x", "y", 4, f"{tmp_path}/state")
    assert model.seen == 10
    right = model.predict(rows, "x").where("prediction = y").count()
    assert right > 240


def test_encoders_and_trees_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(w, float(i % 4)) for i, w in enumerate(WORDS * 5)], "v string, y double")
    for i, (kind, model) in enumerate([(enc.SimilarityModel, enc.SimilarityEncoder("v").fit(rows)),
                                       (enc.TargetMeanModel, enc.TargetMeanEncoder("v", "y").fit(rows))]):
        model.save(f"{tmp_path}/{i}")
        pick = lambda m: sorted(map(str, m.transform(rows).select("v", "encoded").collect()))
        assert pick(kind.load(spark, f"{tmp_path}/{i}")) == pick(model)
    cells = rows.groupBy("v", "y").agg(F.count("*").cast("double").alias("n"))
    vectors = spark.createDataFrame([(w, [float(len(w)), float(w.count("o"))]) for w in WORDS], "title string, vector array<double>")
    from pyspark.ml import Pipeline
    features = Pipeline(stages=ml.feature_stages(vectors.withColumnRenamed("title", "v"), [], [], "v")).fit(cells)
    ready = features.transform(cells).select("v", "y", "n", "features")
    boost = ml.boosted_quantile(ready, "y", rounds=2)
    boost.save(spark, f"{tmp_path}/boost")
    got = ml.QuantileBoost.load(spark, f"{tmp_path}/boost").predict(ready)
    assert sorted(map(str, got.collect())) == sorted(map(str, boost.predict(ready).collect()))


def test_classifiers_after_an_observation(spark):
    """The session keeps what observed a query; models that tasks are sent must not bring it along."""
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    rows = spark.range(60).select("id", F.array((F.col("id") % 2).cast("double"), (F.col("id") % 7).cast("double")).alias("v"),
                                  (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2).cast("string").alias("label"))
    vectors = rows.withColumn("features", array_to_vector("v"))
    assert ml.logistic_scores(vectors, "y").where((F.col("p") > 0.5) == (F.col("y") == 1)).count() == 60
    assert ml.kernel_classifier(rows, "v", "y")(rows).where(F.col("prediction") == F.col("y")).count() > 30
    assert ml.forest_classifier(vectors, "label", trees=3).transform(vectors).where("predicted = label").count() == 60

"""Learned estimates.  Some keep rounds and folds small; data is never cut."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from catalog import sql as Q
from catalog.evaluation import GROUPS, splits_sql
from catalog.lookups import title_vectors
from catalog.registry import query
from motley.functions import hashing
from motley.operators import sampling
from motley.operators.aggregates import finite
from motley.operators.encoders import words_of
from motley.plans import learners as ml
from motley.plans import ridge as rg
from motley.plans.gap import COVARIATES
from motley.sources.people import people, table
from motley.workdir import materialize


def vectors(spark, sf):
    return materialize(title_vectors(spark, sf, "title"), "vectors")


SMALL = {"rounds": 5, "depth": 3}
P = f"WITH {Q.PEOPLE}"


def _within(df, y, p="prediction", slack=0.5):
    """Whether a prediction lies near the range of y."""
    span = df.agg(F.struct(F.min(y).alias("lo"), F.max(y).alias("hi")).alias("r")).scalar()
    room = (span["hi"] - span["lo"]) * slack
    return F.col(p).between(span["lo"] - room, span["hi"] + room)


@query("boosted_salary", f"{P} SELECT DISTINCT title, seniority, true AS in_range, true AS beats_mean FROM people")
def boosted_salary(spark, sf):
    """A salary for every title and year; checked by its range and error."""
    p = people(spark, sf, "row_id", "title", "seniority", "salary")
    y, e = F.col("salary"), F.col("prediction")
    sums = materialize(p.groupBy("title", "seniority").agg(
        F.sum(y).alias("s"), F.sum(y * y).alias("ss"), F.count(y).alias("n"), F.min(y).alias("lo"), F.max(y).alias("hi")), "sums")
    found = ml.boosted_salary(p, vectors(spark, sf)).transform(sums)
    left = F.sum(F.col("ss") - 2 * e * F.col("s") + F.col("n") * e * e)
    fits = found.agg((left < F.sum("ss") - F.sum("s") ** 2 / F.sum("n")).alias("ok")).scalar()
    lo, hi = (sums.agg(f("lo" if f is F.min else "hi").alias("x")).scalar() for f in (F.min, F.max))
    return found.select("title", "seniority", e.between(lo - (hi - lo) / 2, hi + (hi - lo) / 2).alias("in_range"),
                        fits.alias("beats_mean"))


@query("boosted_propensity", f"{P} SELECT DISTINCT title, true AS is_probability FROM people")
def boosted_propensity(spark, sf):
    p = people(spark, sf, "title", "gender")
    model = ml.boosted_propensity(p, vectors(spark, sf), **SMALL)
    return model.transform(p.select("title").distinct()).select("title", ml.probability()).select(
        "title", F.col("propensity").between(0, 1).alias("is_probability"))


@query("boosted_quantile", f"{P} SELECT DISTINCT title, true AS in_range, true AS near_share FROM people")
def boosted_quantile(spark, sf):
    """Three quarters of the salaries, give or take a tenth, lie below the prediction."""
    p = people(spark, sf, "title", "salary").groupBy("title", "salary").agg(F.count("*").cast("double").alias("n"))
    features = Pipeline(stages=ml.feature_stages(vectors(spark, sf), [], [])).fit(p)
    rows = materialize(features.transform(p).select("title", "salary", "n", "features"), "quantile")
    found = materialize(ml.boosted_quantile(rows, "salary").predict(rows).select("title", "salary", "n", "prediction"), "found")
    below = F.sum(F.when(F.col("salary") <= F.col("prediction"), F.col("n")).otherwise(0)) / F.sum("n")
    share = found.agg(below.between(0.65, 0.85).alias("near")).scalar()
    return found.select("title", _within(found, "salary").alias("in_range"), share.alias("near_share")).distinct()


@query("tune_learning_rate", "SELECT unnest([0.01::DOUBLE, 0.31622776601683794::DOUBLE]) AS lr, true AS finite")
def tune_learning_rate(spark, sf):
    p = people(spark, sf, "table_id", "title", "seniority", "salary")
    folds = [GROUPS[:7], GROUPS[7:]]
    tuned = ml.tune_learning_rate(p, vectors(spark, sf), folds, [0.01, 10**-0.5], rounds=3, depth=3)
    return tuned.select("lr", finite(F.col("rmse")).alias("finite"))


@query("tune_learning_rate_sex", "SELECT fit, lr, true AS below_one FROM (SELECT unnest(['seen', 'all']) AS fit), "
                                 "(SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE]) AS lr)")
def tune_learning_rate_sex(spark, sf):
    """The classifier's rates, judged on titles the training tables hold and on all."""
    p = people(spark, sf, "table_id", "title", "seniority", "gender")
    both = [ml.tune_learning_rate(p, vectors(spark, sf), [GROUPS[:7]], [0.1, 0.5], "gender", task="sex", fit_on=fit, rounds=2,
                                  depth=2).withColumn("fit", F.lit(fit)) for fit in ("seen", "all")]
    return both[0].unionByName(both[1]).select("fit", "lr", (F.col("rmse") < 1).alias("below_one"))


@query("grid_search", """SELECT lr, depth, true AS finite FROM (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE]) AS lr),
  (SELECT unnest([2, 4]) AS depth)""")
def grid_search(spark, sf):
    cells = ml.mean_cells(people(spark, sf, "title", "seniority", "salary"), ["title", "seniority"], "salary")
    _, found = ml.grid_search(ml.boosted_regressor(3), ml.feature_stages(vectors(spark, sf), ["seniority"], []),
                              cells, [0.1, 0.5], [2, 4], folds=2)
    rows = [({p.name: float(v) for p, v in m.items()}, float(s)) for m, s in zip(found.getEstimatorParamMaps(), found.avgMetrics)]
    out = spark.createDataFrame([(m["stepSize"], int(m["maxDepth"]), s) for m, s in rows], "lr DOUBLE, depth INT, rmse DOUBLE")
    return out.select("lr", "depth", finite(F.col("rmse")).alias("finite"))


@query("predict_curve", f"""{P}, v AS (SELECT DISTINCT matched_title, title AS variant FROM people
    UNION SELECT DISTINCT matched_title, 'all' FROM people)
  SELECT matched_title, variant, CAST(e AS INTEGER) AS seniority, true AS in_range FROM v, (SELECT unnest(range(34)) AS e)""")
def predict_curve(spark, sf):
    p = people(spark, sf, "title", "matched_title", "seniority", "salary")
    model = ml.boosted_salary(p, vectors(spark, sf), **SMALL)
    return ml.predict_curve(model, p, "matched_title").select(
        "matched_title", "variant", "seniority", _within(p, "salary").alias("in_range"))


@query("ridge", f"""{P} SELECT title, seniority, employer, ethnicity, gender, true AS in_range, true AS beats_mean
  FROM people GROUP BY ALL""")
def ridge(spark, sf):
    """Among the three penalties; checked on the cells it was fitted on."""
    cells = materialize(ml.mean_cells(people(spark, sf, *COVARIATES, "gender", "salary"), [*COVARIATES, "gender"], "salary"), "cells")
    model, _ = ml.ridge(cells, ml.feature_stages(vectors(spark, sf), ["seniority", "gender"], ["employer", "ethnicity"]),
                        [0.1, 10.0, 1000.0])
    found = model.transform(cells)
    e = F.col("label") - F.col("prediction")
    mean = F.sum(F.col("n") * F.col("label")) / F.sum("n")
    total = F.sum(F.col("n") * F.col("label") ** 2) - F.sum("n") * mean * mean
    fits = found.agg((F.sum(F.col("n") * e * e) < total).alias("ok")).scalar()
    return found.select(*COVARIATES, "gender", _within(cells, "label").alias("in_range"), fits.alias("beats_mean"))


@query("ridge_sums", f"""{P}, m AS (SELECT stddev_pop(salary) AS sy, stddev_pop(seniority) AS s1, stddev_pop(gender) AS s2, corr(seniority, gender) AS r,
    corr(seniority, salary) AS r1, corr(gender, salary) AS r2, avg(salary) AS y, avg(seniority) AS x1, avg(gender) AS x2 FROM people),
  c AS (SELECT *, 1 + 1000 / sy AS d FROM m),
  b AS (SELECT *, (d * r1 - r * r2) / (d * d - r * r) * sy / s1 AS b1, (d * r2 - r * r1) / (d * d - r * r) * sy / s2 AS b2 FROM c)
  SELECT 'seniority' AS term, round(b1, 6) AS value FROM b UNION ALL SELECT 'gender', round(b2, 6) FROM b
  UNION ALL SELECT 'intercept', round(y - b1 * x1 - b2 * x2, 6) FROM b""")
def ridge_sums(spark, sf):
    """Salary by experience and sex with a penalty of 1000, from sums per fold."""
    p = people(spark, sf, "row_id", "seniority", "gender", "salary").select(
        F.pmod("row_id", F.lit(3)).alias("fold"), F.array("seniority", "gender").cast("array<double>").alias("features"),
        F.col("salary").alias("label"), F.lit(1.0).alias("n"))
    line = rg.ridge_from_sums(p, [1000.0], "fold", 3)
    rows = [*zip(("seniority", "gender"), map(float, line.coefficients)), ("intercept", float(line.intercept))]
    return spark.createDataFrame(rows, "term STRING, value DOUBLE").withColumn("value", F.round("value", 6))


def _worded(spark, sf):
    """All documents with hashed word counts, and their labels where they have one."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", "lang", "quality", words_of(F.coalesce("text", F.lit(""))).alias("words"))
    return materialize(HashingTF(inputCol="words", outputCol="features", numFeatures=512).transform(docs).drop("words"), "docs")


@query("random_forest", "SELECT doc_id, lang, true AS known_label, true AS mostly_right FROM documents")
def random_forest(spark, sf):
    """A language for every document; checked by its values and the share of right ones."""
    docs = _worded(spark, sf)
    found = ml.forest_classifier(docs, "lang", trees=10, depth=5).transform(docs)
    right = found.agg((F.avg((F.col("predicted") == F.col("lang")).cast("double")) > 0.8).alias("right")).scalar()
    langs = [r[0] for r in docs.select("lang").distinct().collect()]
    return found.select("doc_id", "lang", F.col("predicted").isin(langs).alias("known_label"), right.alias("mostly_right"))


@query("logistic", """SELECT d.doc_id, quality, true AS in_range, true AS beats_base_rate
  FROM documents d LEFT JOIN labels USING (doc_id)""")
def logistic(spark, sf):
    """Fitted on the labelled documents, a probability for all; checked by its range and mean log loss."""
    docs = _worded(spark, sf)
    scored = ml.logistic_scores(docs, "quality")
    y = F.col("quality")
    p = F.least(F.greatest(F.col("p"), F.lit(1e-9)), F.lit(1 - 1e-9))
    loss = F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))
    rate = F.avg("quality")
    base = scored.agg((loss < -(rate * F.log(rate) + (1 - rate) * F.log(1 - rate))).alias("better")).scalar()
    return scored.select("doc_id", "quality", F.col("p").between(0, 1).alias("in_range"), base.alias("beats_base_rate"))


@query("kernel_classifier", "SELECT vec_id, CAST(label < 5 AS INTEGER) AS y, true AS is_label, true AS better_than_half FROM embeddings")
def kernel_classifier(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    found = ml.kernel_classifier(rows, "embedding", "y", max_iter=10)(rows)
    right = found.agg((F.avg((F.col("prediction") == F.col("y")).cast("double")) > 0.5).alias("ok")).scalar()
    return found.select("vec_id", "y", F.col("prediction").isin(0.0, 1.0).alias("is_label"), right.alias("better_than_half"))


def _rows(spark, sf, *more):
    return people(spark, sf, *COVARIATES, "gender", "salary", *more)


_GAP = f"{P} SELECT count(*) AS n_rows, true AS plausible FROM people"


def _plausible(rows, found):
    """The gap is below a tenth of the spread of salaries, as sex is drawn without regard to them."""
    spread = rows.agg(F.stddev_pop("salary").alias("s")).scalar()
    return found.select("n_rows", (F.abs("ate") < spread / 10).alias("plausible"))


@query("aipw", _GAP)
def aipw(spark, sf):
    rows = _rows(spark, sf)
    return _plausible(rows, ml.aipw(rows, vectors(spark, sf), **SMALL))


@query("aipw_crossfit", _GAP)
def aipw_crossfit(spark, sf):
    rows = _rows(spark, sf, "row_id")
    folded = sampling.kfold(rows, "row_id", 2, hashed=hashing.mixed_hash(F.col("row_id"), 1))
    return _plausible(rows, ml.aipw_crossfit(folded, vectors(spark, sf), n_folds=2, rounds=3, depth=3))


SUBSETS = [tables for size in (1, 3, 7) for tables in sampling.group_shuffle_split(GROUPS, 2, size, seed=size)] + [GROUPS]


@query("aipw_subsets", f"""{P}, {splits_sql(SUBSETS)} SELECT split_id, count(*) AS n_rows, true AS plausible FROM people
  JOIN splits USING (table_id) WHERE is_test = 1 GROUP BY split_id""")
def aipw_subsets(spark, sf):
    """The cross-fitted gap over 1, 3, 7 and all 14 tables; fourteen models of each kind grow together."""
    rows = _rows(spark, sf, "row_id", "table_id")
    folded = sampling.kfold(rows, "row_id", 2, hashed=hashing.mixed_hash(F.col("row_id"), 1))
    found = ml.aipw_crossfit(folded, vectors(spark, sf), n_folds=2, rounds=3, depth=3, subsets=sampling.split_table(spark, GROUPS, SUBSETS))
    spread = rows.agg(F.stddev_pop("salary").alias("s")).scalar()
    # the fewer rows, the wider the gap may stray where there is none
    return found.select("split_id", "n_rows", (F.abs("ate") < spread * (0.05 + 8 / F.sqrt("n_rows"))).alias("plausible"))


@query("aipw_tuned", _GAP)
def aipw_tuned(spark, sf):
    rows = _rows(spark, sf)
    return _plausible(rows, ml.aipw_tuned(rows, vectors(spark, sf), [0.1, 0.5], [3], folds=2, rounds=3))

"""Learned answers: boosted trees, linear models and doubly robust gaps.

Rows with equal covariates carry the same features, so models are fitted on
covariate cells weighted by their size.  For squared and logistic loss this
gives the same fit as the rows and keeps training independent of their number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motley.functions.vectors import usable
from motley.operators.aggregates import cell_sums, merge_cells
from motley.operators.encoders import rbf_features
from motley.operators.joins import join_groups
from motley.plans.boosting import Boosts, fit_many
from motley.plans.gap import COVARIATES
from motley.workdir import fresh_path, materialize


class TitleVectors(Transformer):
    """Join the embedding of a title and whether it has one; a title without gets zeros."""

    def __init__(self, vectors: DataFrame, title: str = "title", output: str = "title_vector"):
        super().__init__()
        self.vectors, self.title, self.output = vectors, title, output
        widest = vectors.agg(F.max(F.size("vector"))).first()[0]
        self.size = max(widest or 0, 0)

    def _transform(self, df: DataFrame) -> DataFrame:
        zeros = F.array_repeat(F.lit(0.0), self.size)
        known = self.vectors.where(F.col("vector").isNotNull()).select(F.col(self.title), F.col("vector").alias("_known"))
        joined = join_groups(df, known, [self.title], "left")
        flag = F.array(F.col("_known").isNotNull().cast("double"))
        filled = F.coalesce(F.col("_known").cast("array<double>"), zeros)
        return joined.withColumn(self.output, array_to_vector(F.concat(filled, flag))).drop("_known")


class KnownNumbers(Transformer):
    """Numeric columns with 0 for null, and flags that tell which values are known."""

    def __init__(self, columns: list[str]):
        super().__init__()
        self.columns = columns
        self.outputs = [f"{c}{end}" for c in columns for end in ("_n", "_known")]

    def _transform(self, df: DataFrame) -> DataFrame:
        for c in self.columns:
            df = df.withColumn(f"{c}_n", F.coalesce(F.col(c).cast("double"), F.lit(0.0))).withColumn(
                f"{c}_known", F.col(c).isNotNull().cast("double"))
        return df


def feature_stages(vectors: DataFrame, numeric: list[str], categorical: list[str], title: str = "title") -> list:
    """Stages from covariates to ``features``: embedding, numbers, one-hot categories."""
    numbers = KnownNumbers(numeric)
    stages: list = [TitleVectors(vectors, title), numbers]
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep", stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCol=f"{c}_i", outputCol=f"{c}_v")]
    names = ["title_vector", *numbers.outputs, *[f"{c}_v" for c in categorical]]
    return [*stages, VectorAssembler(inputCols=names, outputCol="features")]


def mean_cells(df: DataFrame, covariates: list[str], y: str) -> DataFrame:
    """Cells with mean known outcome ``label`` and their number ``n``, for squared loss."""
    return df.where(F.col(y).isNotNull()).groupBy(*covariates).agg(
        F.avg(y).alias("label"), F.count("*").cast("double").alias("n"))


def class_cells(df: DataFrame, covariates: list[str], y: str) -> DataFrame:
    """Cells per known class, for classification."""
    return df.where(F.col(y).isNotNull()).groupBy(*covariates, F.col(y).cast("double").alias("label")).agg(
        F.count("*").cast("double").alias("n"))


def boosted_regressor(rounds: int = 100, lr: float = 0.1, depth: int = 5, seed: int = 0) -> GBTRegressor:
    return GBTRegressor(maxIter=rounds, stepSize=lr, maxDepth=depth, weightCol="n", seed=seed)


def boosted_classifier(rounds: int = 100, lr: float = 0.1, depth: int = 5, seed: int = 0) -> GBTClassifier:
    return GBTClassifier(maxIter=rounds, stepSize=lr, maxDepth=depth, weightCol="n", seed=seed)


def boosted_salary(df: DataFrame, vectors: DataFrame, y: str = "salary", exp: str = "seniority", **options) -> PipelineModel:
    """Salary given title embedding and experience.

    The cells are written, as the fit reads them many times.
    """
    stages = feature_stages(vectors, [exp], [])
    return Pipeline(stages=[*stages, boosted_regressor(**options)]).fit(materialize(mean_cells(df, ["title", exp], y), "cells"))


def boosted_propensity(df: DataFrame, vectors: DataFrame, y: str = "gender", **options) -> PipelineModel:
    """Probability of the treatment given the title embedding."""
    stages = feature_stages(vectors, [], [])
    return Pipeline(stages=[*stages, boosted_classifier(**options)]).fit(materialize(class_cells(df, ["title"], y), "cells"))


def probability(name: str = "propensity"):
    return vector_to_array("probability")[1].alias(name)


@dataclass
class QuantileBoost:
    """Boosted trees for a quantile: a start value and a tree with a value per leaf for each round."""

    boosts: Boosts

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the bins, every tree and its leaf values below ``path``."""
        self.boosts.save(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "QuantileBoost":
        return cls(Boosts.load(spark, path))

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Add the prediction to rows with ``features``."""
        return self.boosts.predict(df, output).withColumn(output, F.get(output, F.lit(0)))


def boosted_quantile(df: DataFrame, y: str, q: float = 0.75, rounds: int = 100, lr: float = 0.1, depth: int = 3,
                     save_every: int = 10, weight: str = "n") -> QuantileBoost:
    """Boosting with the pinball loss on rows (features, y, weight).

    Each round fits a small tree to the gradient and gives every leaf the exact
    quantile of its residuals.  The outcomes with their running prediction are
    written every few rounds, so lineage stays short.
    """
    cells = df.select(F.lit(0).alias("group"), "features", F.col(y).alias("total"), F.col(weight).alias("weight"))
    return QuantileBoost(fit_many(cells, [{0}], [lr], "quantile", rounds=rounds, depth=depth, q=q, save_every=save_every))


def tune_learning_rate(df: DataFrame, vectors: DataFrame, folds: list[list[int]], rates: list[float], y: str = "salary",
                       exp: str = "seniority", task: str = "salary", fit_on: str = "all", **options) -> DataFrame:
    """(lr, rmse) over held-out tables; the models of all rates and folds grow together.

    With ``task='sex'`` y is 0 or 1 and the error that of the probability. ``fit_on`` 'seen'
    or 'unseen' only judges held-out titles that the training tables hold, or lack.
    """
    keys = ["title", exp]
    sums = df.groupBy("table_id", *keys).agg(
        F.sum(y).alias("_s"), F.sum(F.col(y) * F.col(y)).alias("_ss"), F.count(y).alias("_n")).where("_n > 0")
    sums = materialize(sums, "sums")
    tables = {r["table_id"] for r in sums.select("table_id").distinct().collect()}  # a row per table
    features = Pipeline(stages=feature_stages(vectors, [exp], [])).fit(sums)
    ready = materialize(features.transform(sums).select("table_id", *keys, "features", "_s", "_ss", "_n"), "ready")
    cells = ready.select(F.col("table_id").alias("group"), "features", F.col("_s").alias("total"), F.col("_n").alias("weight"))
    models = [(lr, fold) for lr in rates for fold in range(len(folds))]
    boosts = fit_many(cells, [tables - set(folds[f]) for _, f in models], [lr for lr, _ in models],
                      "logistic" if task == "sex" else "squared", **options)
    held = df.sparkSession.createDataFrame(
        [(t, m, f, float(lr)) for m, (lr, f) in enumerate(models) for t in folds[f]], "table_id INT, model INT, fold INT, lr DOUBLE")
    judged = boosts.predict(ready, "_p").drop("features").join(F.broadcast(held), "table_id").withColumn("_p", F.get("_p", F.col("model")))
    if fit_on != "all":
        outside = df.sparkSession.createDataFrame([(t, f) for f, fold in enumerate(folds) for t in tables - set(fold)],
                                                  "table_id INT, fold INT")
        known = sums.join(F.broadcast(outside), "table_id").select("fold", "title").distinct()
        judged = join_groups(judged, known, ["fold", "title"], "left_semi" if fit_on == "seen" else "left_anti")
    error = F.sum(F.col("_ss") - 2 * F.col("_p") * F.col("_s") + F.col("_n") * F.col("_p") ** 2)
    found = judged.groupBy("lr").agg(F.sqrt(error / F.sum("_n")).alias("rmse"))
    asked = df.sparkSession.createDataFrame([(float(lr),) for lr in rates], "lr DOUBLE")
    return asked.join(found, "lr", "left")


def best_rate(tuned: DataFrame) -> float:
    """The rate with the least error, the smaller one on ties."""
    return tuned.where(F.col("rmse").isNotNull()).orderBy("rmse", "lr").first()["lr"]


def grid_search(learner, stages: list, cells: DataFrame, rates: list[float], depths: list[int], folds: int = 5,
                seed: int = 0, parallelism: int = 2):
    """Cross-validated learning rate and depth; gives (fitted pipeline, CV model)."""
    features = Pipeline(stages=stages).fit(cells)
    ready = materialize(features.transform(cells).select("features", "label", "n"), "grid")
    grid = ParamGridBuilder().addGrid(learner.stepSize, rates).addGrid(learner.maxDepth, depths).build()
    score = (RegressionEvaluator(metricName="rmse", weightCol="n") if isinstance(learner, GBTRegressor)
             else BinaryClassificationEvaluator(weightCol="n"))
    found = CrossValidator(estimator=learner, estimatorParamMaps=grid, evaluator=score, numFolds=folds,
                           parallelism=parallelism, seed=seed).fit(ready)
    return PipelineModel([*features.stages, found.bestModel]), found


def predict_curve(model: PipelineModel, variants: DataFrame, group: str, years: int = 34, exp: str = "seniority") -> DataFrame:
    """Predicted salary of each title for 0..years-1 of experience, and the mean of its group."""
    asked = materialize(variants.select(group, "title").distinct(), "variants").withColumn(
        exp, F.explode(F.sequence(F.lit(0), F.lit(years - 1))))
    each = model.transform(asked).select(group, F.col("title").alias("variant"), exp, "prediction")
    pooled = each.groupBy(group, exp).agg(F.avg("prediction").alias("prediction")).withColumn("variant", F.lit("all"))
    return each.unionByName(pooled)


def ridge(cells: DataFrame, stages: list, penalties: list[float], folds: int = 3, seed: int = 0):
    """Ridge regression with a cross-validated penalty."""
    features = Pipeline(stages=stages).fit(cells)
    ready = materialize(features.transform(cells).select("features", "label", "n"), "ridge")
    line = LinearRegression(elasticNetParam=0.0, weightCol="n")
    grid = ParamGridBuilder().addGrid(line.regParam, penalties).build()
    found = CrossValidator(estimator=line, estimatorParamMaps=grid, numFolds=folds, seed=seed,
                           evaluator=RegressionEvaluator(metricName="r2", weightCol="n")).fit(ready)
    return PipelineModel([*features.stages, found.bestModel]), found


def without_summary(model, spark: SparkSession):
    """The model as written and read back.

    A fitted binary classifier keeps a training summary that refers to the session. Tasks are sent
    the model, but cannot be once the session has seen an observation or a job tag.
    """
    path = fresh_path(spark, "model")
    model.write().save(path)
    return type(model).load(path)


def kernel_classifier(df: DataFrame, vec: str, y: str, n_components: int = 100, gamma: float = 0.5, seed: int = 42,
                      max_iter: int = 20):
    """Random Fourier features and a linear SVM; gives the function that predicts.

    Rows without a vector or label are not learnt from; without a vector the prediction is null.
    """
    ready = lambda d: rbf_features(d, vec, n_components, gamma, seed, "_rbf").withColumn(
        "features", array_to_vector("_rbf"))
    known = usable(F.col(vec))
    model = LinearSVC(labelCol=y, maxIter=max_iter).fit(ready(df.where(known & F.col(y).isNotNull())))
    model = without_summary(model, df.sparkSession)
    return lambda d: model.transform(ready(d.where(known))).drop("_rbf").unionByName(d.where(~known), allowMissingColumns=True)


def forest_classifier(df: DataFrame, label: str, trees: int = 20, depth: int = 5, seed: int = 1) -> PipelineModel:
    """Random forest on ``features`` for a text label; rows without one are not learnt from.

    Adds ``predicted``, the most likely label.
    """
    known = df.where(F.col(label).isNotNull())
    names = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep").fit(known)
    forest = RandomForestClassifier(labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed).fit(names.transform(known))
    forest = without_summary(forest, df.sparkSession)
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=[*names.labels, ""])
    return PipelineModel([names, forest, back])


def logistic_scores(df: DataFrame, label: str, penalty: float = 0.01, rounds: int = 20, name: str = "p") -> DataFrame:
    """All rows with the probability of label 1, learnt from the rows that have a label."""
    known = df.where(F.col(label).isNotNull())
    model = LogisticRegression(labelCol=label, maxIter=rounds, regParam=penalty).fit(known)
    model = without_summary(model, df.sparkSession)
    return model.setPredictionCol("_p").transform(df).withColumn(name, probability(name)).drop(
        "_p", "probability", "rawPrediction")


# --- doubly robust gap -----------------------------------------------------


def outcome_cells(cells: DataFrame) -> DataFrame:
    """Mean salary and size per covariates and sex."""
    both = cells.select(*COVARIATES, F.explode(F.array(
        F.struct(F.lit(1).alias("gender"), F.col("c1").alias("n"), F.col("s1").alias("s")),
        F.struct(F.lit(0).alias("gender"), F.col("c0").alias("n"), F.col("s0").alias("s")))).alias("x"))
    return both.where("x.n > 0").select(
        *COVARIATES, "x.gender", (F.col("x.s") / F.col("x.n")).alias("label"), F.col("x.n").cast("double").alias("n"))


def fit_outcome(cells: DataFrame, vectors: DataFrame, learner=None) -> PipelineModel:
    """Salary given covariates and sex, from cell sums."""
    train = outcome_cells(cells)
    stages = feature_stages(vectors, ["seniority", "gender"], ["employer", "ethnicity"])
    return Pipeline(stages=[*stages, learner or boosted_regressor()]).fit(train)


def fit_propensity(cells: DataFrame, vectors: DataFrame, learner=None) -> PipelineModel:
    """Probability of being male given covariates, from cell sizes."""
    train = propensity_cells(cells)
    stages = feature_stages(vectors, ["seniority"], ["employer", "ethnicity"])
    return Pipeline(stages=[*stages, learner or boosted_classifier()]).fit(train)


def propensity_cells(cells: DataFrame) -> DataFrame:
    both = cells.select(*COVARIATES, F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("n1").alias("n")),
        F.struct(F.lit(0.0).alias("label"), F.col("n0").alias("n")))).alias("x"))
    return both.where("x.n > 0").select(*COVARIATES, "x.label", F.col("x.n").cast("double").alias("n"))


def aipw_terms(cells: DataFrame, outcome: PipelineModel, propensity: PipelineModel) -> DataFrame:
    """Sum of individual effects per cell: ``effect`` and ``n``.

    Summed over the rows of a cell the doubly robust formula needs only the
    sizes and salary sums of both sexes.  Rows without a known salary stand for
    the known ones of their cell and sex; where none is known they move nothing.
    """
    keep = [*COVARIATES, "n", "n1", "n0", "y1", "y0"]
    out = cells.withColumns({"y1": F.try_divide("s1", "c1"), "y0": F.try_divide("s0", "c0")}).drop("s1", "s0", "c1", "c0")
    for g, name in ((1, "mu1"), (0, "mu0")):
        out = outcome.transform(out.withColumn("gender", F.lit(g))).withColumnRenamed("prediction", name).select(*keep, name)
        keep.append(name)
    return effects(propensity.transform(out).select(*keep, probability("e")))


def effects(out: DataFrame, *keep: str) -> DataFrame:
    """Size and summed effect of cells with the answers ``mu1``, ``mu0`` and ``e`` of the models."""
    men = F.when(F.col("y1").isNull(), 0.0).otherwise(
        F.try_divide(F.col("n1") * (F.col("y1") - F.col("mu1")), F.col("e")))
    women = F.when(F.col("y0").isNull(), 0.0).otherwise(
        F.try_divide(F.col("n0") * (F.col("y0") - F.col("mu0")), 1 - F.col("e")))
    return out.select(*keep, "n", (F.col("n") * (F.col("mu1") - F.col("mu0")) + men - women).alias("effect"))


def mean_effect(terms: DataFrame) -> DataFrame:
    return terms.agg((F.sum("effect") / F.sum("n")).alias("ate"), F.sum("n").alias("n_rows"))


def aipw(df: DataFrame, vectors: DataFrame, rounds: int = 100, lr: float = 0.1, depth: int = 5) -> DataFrame:
    """Doubly robust gap with models fitted and applied on all rows."""
    cells = materialize(cell_sums(df, COVARIATES), "cells")
    outcome = fit_outcome(cells, vectors, boosted_regressor(rounds, lr, depth))
    propensity = fit_propensity(cells, vectors, boosted_classifier(rounds, lr, depth))
    return mean_effect(aipw_terms(cells, outcome, propensity))


def aipw_crossfit(df: DataFrame, vectors: DataFrame, fold: str = "fold", n_folds: int = 5, rounds: int = 100,
                  lr: float = 0.1, depth: int = 5, subsets: DataFrame | None = None) -> DataFrame:
    """Doubly robust gap where each fold is judged by models of the other folds.

    With ``subsets`` (split_id, table_id, is_test = 1) a row per subset of tables; the models of
    all folds and subsets grow together.
    """
    by = [] if subsets is None else ["table_id"]
    cells = materialize(cell_sums(df.where(F.col(fold).between(0, n_folds - 1)), [*by, fold, *COVARIATES]), "cells")
    if subsets is None:
        chosen, tables = [(0, None)], {0: {None}}
    else:
        chosen = [tuple(r) for r in subsets.where("is_test = 1").select("split_id", "table_id").collect()]  # subsets of tables
        tables = {}
        for s, t in chosen:
            tables.setdefault(s, set()).add(t)
    models = [(s, k) for s in sorted(tables) for k in range(n_folds)]
    members = [{f"{t}/{other}" for t in tables[s] for other in range(n_folds) if other != k} for s, k in models]
    group = F.concat_ws("/", F.col("table_id").cast("string") if by else F.lit("None"), F.col(fold).cast("string"))
    grouped = cells.withColumn("group", group)
    numbers = features_of(vectors, cells)
    known = numbers(grouped.select(*COVARIATES, "group", F.explode(F.array(
        F.struct(F.lit(1).alias("gender"), F.col("c1").alias("weight"), F.col("s1").alias("total")),
        F.struct(F.lit(0).alias("gender"), F.col("c0").alias("weight"), F.col("s0").alias("total")))).alias("x")).select(
            *COVARIATES, "group", "x.gender", "x.weight", "x.total"), True)
    sizes = numbers(grouped.select(*COVARIATES, "group", (F.col("n1") + F.col("n0")).alias("weight"), F.col("n1").alias("total")), False)
    settings = {"rounds": rounds, "depth": depth}
    outcome = fit_many(materialize(known.select("group", "features", "weight", "total"), "outcome"), members, [lr] * len(models), **settings)
    propensity = fit_many(materialize(sizes.select("group", "features", "weight", "total"), "treatment"), members, [lr] * len(models),
                          "logistic", **settings)
    named = df.sparkSession.createDataFrame([(s, k, i) for i, (s, k) in enumerate(models)], f"split_id INT, {fold} INT, model INT")
    asked = cells.withColumn(fold, F.col(fold).cast("int"))
    if by:
        pairs = df.sparkSession.createDataFrame(chosen, "split_id INT, table_id INT")
        asked = merge_cells(asked.join(F.broadcast(pairs), "table_id"), ["split_id", fold, *COVARIATES])
    else:
        asked = asked.withColumn("split_id", F.lit(0))
    asked = asked.join(F.broadcast(named), ["split_id", fold])
    keep = ["split_id", "model", *COVARIATES, "n", "n1", "n0", "y1", "y0"]
    out = asked.withColumns({"y1": F.try_divide("s1", "c1"), "y0": F.try_divide("s0", "c0")}).select(*keep)
    for g, name in ((1, "mu1"), (0, "mu0")):
        out = outcome.predict(numbers(out.withColumn("gender", F.lit(g)), True), name, model="model").select(*keep, name)
        keep.append(name)
    out = propensity.predict(numbers(out, False), "e", model="model").select(*keep, "e")
    found = effects(out, "split_id").groupBy("split_id").agg((F.sum("effect") / F.sum("n")).alias("ate"), F.sum("n").alias("n_rows"))
    return found if by else found.drop("split_id")


def features_of(vectors: DataFrame, cells: DataFrame):
    """A function that adds ``features`` of the covariates, with or without the sex, to any rows."""
    fitted = {sexed: Pipeline(stages=feature_stages(vectors, ["seniority"] + ["gender"] * sexed, ["employer", "ethnicity"])).fit(
        cells.withColumn("gender", F.lit(0))) for sexed in (True, False)}
    return lambda rows, sexed: fitted[sexed].transform(rows)


def aipw_tuned(df: DataFrame, vectors: DataFrame, rates: list[float], depths: list[int], folds: int = 5,
               rounds: int = 100) -> DataFrame:
    """Doubly robust gap with grid-searched models, predictions in sample."""
    cells = materialize(cell_sums(df, COVARIATES), "cells")
    outcome, _ = grid_search(boosted_regressor(rounds), feature_stages(
        vectors, ["seniority", "gender"], ["employer", "ethnicity"]), outcome_cells(cells), rates, depths, folds)
    propensity, _ = grid_search(boosted_classifier(rounds), feature_stages(
        vectors, ["seniority"], ["employer", "ethnicity"]), propensity_cells(cells), rates, depths, folds)
    return mean_effect(aipw_terms(cells, outcome, propensity))

"""Errors of the estimators on tables they were not fitted on.

Folds are rows of a small (split_id, table_id, is_test) table.  Training data
is reduced to sums per (table, key) once; every split only adds up those sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motley.operators.aggregates import (
    cell_means, cell_sums, group_quantile, merge_cells, quantile_sketches, sketched_quantile,
)
from motley.operators.dictionary import range_bounds
from motley.operators.joins import join_groups
from motley.operators.lookups import (
    estimate_lookup, grains_from_sums, kernel_join, variant_lookup, variant_presence,
)
from motley.operators.sampling import stratified_downsample
from motley.operators.vector_join import with_itself
from motley.plans.boosting import fit_many
from motley.plans.gap import COVARIATES, fuzzy_aipw_of_cells, gap_of_cells
from motley.plans.learners import feature_stages
from motley.workdir import materialize


def sides(splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(split_id, table_id) of the training and of the test tables."""
    side = lambda v: F.broadcast(splits.where(F.col("is_test") == v).select("split_id", "table_id"))
    return side(0), side(1)


def table_sums(df: DataFrame, key: str, exp: str | None, y: str) -> DataFrame:
    """Sums and counts of the known y per (table, key[, exp]): all that fitting and squared errors need.

    Written once, as every split, grain and threshold reads them.
    """
    keys = ["table_id", key] + ([exp] if exp else [])
    sums = df.groupBy(*keys).agg(
        F.sum(y).alias("_s"), F.sum(F.col(y) * F.col(y)).alias("_ss"), F.count(y).alias("n"))
    return materialize(sums, "sums")


def train_grains(sums: DataFrame, splits: DataFrame, key: str, exp: str | None) -> dict[str, DataFrame]:
    train, _ = sides(splits)
    keys = ["split_id", key] + ([exp] if exp else [])
    fine = sums.join(train, "table_id").groupBy(*keys).agg(F.sum("_s").alias("_s"), F.sum("n").alias("n"))
    return grains_from_sums(fine, key, exp, ["split_id"])


def value_table(df: DataFrame, key: str, y: str) -> DataFrame:
    """Row counts ``_n`` per (table, key, value): all that quantiles need."""
    return materialize(df.groupBy("table_id", key, y).agg(F.count("*").alias("_n")), "values")


def train_quantiles(counted: DataFrame, splits: DataFrame, key: str, y: str, q: float = 0.75) -> dict[str, DataFrame]:
    """Quantile grains per split from a value table."""
    train, _ = sides(splits)
    fine = group_quantile(counted.join(train, "table_id"), ["split_id", key], y, q, weight="_n")
    fine = materialize(fine, "quantiles")
    whole = fine.groupBy("split_id").agg(
        (F.sum(F.col("estimate") * F.col("n")) / F.sum("n")).alias("estimate"), F.sum("n").alias("n"))
    return {"fine": fine, "all": whole}


def sketched_train_quantiles(df: DataFrame, splits: DataFrame, key: str, y: str, q: float = 0.75, k: int = 200) -> dict[str, DataFrame]:
    """The grains of ``train_quantiles`` from one sketch per (table, key), merged per split; near, not exact."""
    train, _ = sides(splits)
    sketches = materialize(quantile_sketches(df, ["table_id", key], y, k), "sketches")
    fine = materialize(sketched_quantile(sketches.join(train, "table_id"), ["split_id", key], q), "quantiles")
    whole = fine.groupBy("split_id").agg((F.sum(F.col("estimate") * F.col("n")) / F.sum("n")).alias("estimate"), F.sum("n").alias("n"))
    return {"fine": fine, "all": whole}


def n_variants(df: DataFrame, splits: DataFrame, key: list[str], raw: list[str]) -> DataFrame:
    """(split, key, n_variants): raw spellings of each test key seen in training."""
    train, test = sides(splits)
    spelled = materialize(df.select("table_id", *dict.fromkeys([*key, *raw])).distinct(), "spelled")
    pairs = spelled.select(*dict.fromkeys([*key, *raw])).distinct()
    asked = spelled.select("table_id", *key).distinct().join(test, "table_id").select("split_id", *key).distinct()
    seen = spelled.join(train, "table_id").select("split_id", *raw).distinct()
    return variant_presence(asked, pairs, seen, key, raw, by=["split_id"])


def cv_answers(df: DataFrame, splits: DataFrame, key: str, exp: str | None, y: str, task: str = "salary",
               similar: DataFrame | None = None, threshold: float | None = None, q: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """The estimate of every test key in every split, and the counted table it was found from.

    Matching & averaging, or with ``similar`` the kernel estimate. For quantiles the answers
    also have ``_truth``, the quantile of the test rows of the same key.
    """
    _, test = sides(splits)
    keys = [key] + ([exp] if exp else [])
    if task == "quantile":
        counted = value_table(df, key, y)
        grains = train_quantiles(counted, splits, key, y, q)
        truth = group_quantile(counted.join(test, "table_id"), ["split_id", key], y, q, weight="_n").select(
            "split_id", key, F.col("estimate").alias("_truth"))
    else:
        counted = table_sums(df, key, exp, y)
        grains = train_grains(counted, splits, key, exp)
        truth = None
    asked = counted.join(test, "table_id").select("split_id", *keys).distinct()
    if similar is None:
        answers = estimate_lookup(asked, grains, key, exp, ["split_id"])
    else:
        answers = kernel_join(asked, grains, similar, threshold, key, exp, ["split_id"])
    if truth is not None:
        answers = join_groups(answers, truth, ["split_id", key], "left")
    return answers, counted


def cv_errors(df: DataFrame, splits: DataFrame, key: str, exp: str | None, y: str, task: str = "salary",
              similar: DataFrame | None = None, threshold: float | None = None, q: float = 0.75) -> DataFrame:
    """Absolute error of every test row in every split.

    Null keys are keys like any other; a row without a known truth has a null error. Where
    only means are wanted, ``error_sums`` finds them without a row per row and split.
    """
    _, test = sides(splits)
    answers, _ = cv_answers(df, splits, key, exp, y, task, similar, threshold, q)
    return _row_errors(df, test, answers, [key] + ([exp] if exp else []), y)


def error_sums(df: DataFrame, splits: DataFrame, key: str, exp: str | None, y: str, task: str = "salary",
               similar: DataFrame | None = None, threshold: float | None = None, q: float = 0.75,
               absolute: bool = False) -> DataFrame:
    """(split_id, key[, exp], n, squared[, absolute]): sums of the errors of the test rows of each cell.

    ``n`` counts the rows whose error is known. Squared errors come from sums of y and its
    square, absolute ones from running sums over the distinct values of y; the rows are
    added up per table once, whatever the number of splits.
    """
    answers, counted = cv_answers(df, splits, key, exp, y, task, similar, threshold, q)
    keys = ["split_id", key] + ([exp] if exp else [])
    if task == "quantile":
        _, test = sides(splits)
        rows = counted.join(test, "table_id").groupBy(*keys).agg(F.sum("_n").alias("n"))
        error = F.abs(F.col("_truth") - F.col("estimate"))
        out = join_groups(rows, answers, keys).where(error.isNotNull())
        return out.select(*keys, "n", (F.col("n") * error * error).alias("squared"), (F.col("n") * error).alias("absolute"))
    squared = squared_error_sums(answers.select(*keys, "estimate"), counted, splits, key, exp).where(
        F.col("squared").isNotNull() & (F.col("n") > 0)).select(*keys, "n", "squared")
    if not absolute:
        return squared
    values = materialize(df.where(F.col(y).isNotNull()).groupBy("table_id", key, *([exp] if exp else []), y).agg(
        F.count("*").alias("_n")), "values")
    return join_groups(squared, absolute_error_sums(answers, values, splits, key, exp, y), keys, "left")


def absolute_error_sums(answers: DataFrame, values: DataFrame, splits: DataFrame, key: str, exp: str | None, y: str,
                        buckets: int = 64) -> DataFrame:
    """(split_id, key[, exp], absolute): the sum of |y - estimate| over the test rows of each answered cell.

    ``values`` has the number ``_n`` of rows per (table, key[, exp], y). With C rows and a sum of S up
    to the estimate e, of N rows and a sum of T in all, the sum is e (2 C - N) + T - 2 S. An
    estimate takes C and S from the last value not above it. The values of a key are cut
    into buckets, so that a common key is not one task's.
    """
    _, test = sides(splits)
    cell = ["table_id", key] + ([exp] if exp else [])
    bounds = range_bounds(values, y, buckets)
    bucket = lambda c: sum((F.when(F.col(c) > F.lit(x), 1).otherwise(0) for x in bounds), F.lit(0))
    known = values.select(*cell, F.col(y).cast("double").alias("v"), "_n").withColumn("b", bucket("v"))
    cells = values.select(*cell).distinct().join(test, "table_id")
    asked = join_groups(cells, answers.where(F.col("estimate").isNotNull()).select("split_id", *cell[1:], "estimate"), ["split_id", *cell[1:]])
    asked = asked.select("split_id", *cell, F.col("estimate").cast("double").alias("v")).withColumn("b", bucket("v"))
    none = lambda kind: F.lit(None).cast(kind)
    both = known.withColumn("split_id", none("int")).unionByName(asked.withColumn("_n", none("long")))
    sums = both.groupBy(*cell, "b").agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") * F.col("v")).alias("_t"))
    before = Window.partitionBy(*cell).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*cell)
    nil = lambda c: F.coalesce(c, F.lit(0))
    base = sums.select(*cell, "b", nil(F.sum("_n").over(before)).alias("_c"), nil(F.sum("_t").over(before)).alias("_s"),
                       F.sum("_n").over(whole).alias("_all"), F.sum("_t").over(whole).alias("_sum"))
    upto = Window.partitionBy(*cell, "b").orderBy("v", F.col("split_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.select("*", nil(F.sum("_n").over(upto)).alias("_cin"), nil(F.sum(F.col("_n") * F.col("v")).over(upto)).alias("_sin"))
    found = join_groups(placed.where("split_id IS NOT NULL"), base, [*cell, "b"])
    count, total = F.col("_c") + F.col("_cin"), F.col("_s") + F.col("_sin")
    error = F.col("v") * (2 * count - F.col("_all")) + F.col("_sum") - 2 * total
    return found.groupBy("split_id", *cell[1:]).agg(F.sum(error).alias("absolute"))


def mean_errors(sums: DataFrame, by: list[str]) -> DataFrame:
    """rmse, brier, n and, where there are absolute sums, mae of error sums."""
    n = F.sum("n")
    out = [F.sqrt(F.sum("squared") / n).alias("rmse"), (F.sum("squared") / n).alias("brier"), n.alias("n")]
    if "absolute" in sums.columns:
        out.append((F.sum("absolute") / n).alias("mae"))
    return sums.groupBy(*by).agg(*out)


def error_by_variants(df: DataFrame, splits: DataFrame, key: str, exp: str | None, y: str, raw: str) -> DataFrame:
    """Errors per split for keys of which training knows no, one or many spellings."""
    keys = [key] + ([exp] if exp else [])
    known = n_variants(df, splits, keys, [raw] + ([exp] if exp else []))
    kind = F.when(F.col("n_variants") == 0, "none").when(F.col("n_variants") == 1, "one").otherwise("many")
    sums = join_groups(error_sums(df, splits, key, exp, y, absolute=True), known, ["split_id", *keys])
    return mean_errors(sums.withColumn("seen", kind), ["split_id", "seen"])


def partial_matching(df: DataFrame, splits: DataFrame, key: str, raw: str, exp: str, y: str) -> DataFrame:
    """(split_id, key, exp, n, squared) of the estimate of one spelling of each test key that training knows.

    Keys of which it knows none have the estimate -1.
    """
    train, test = sides(splits)
    fine = materialize(df.groupBy("table_id", key, raw, exp).agg(
        F.sum(y).alias("_s"), F.sum(F.col(y) * F.col(y)).alias("_ss"), F.count(y).alias("n")), "sums")
    known = fine.join(train, "table_id").groupBy("split_id", raw, exp).agg((F.sum("_s") / F.sum("n")).alias("estimate"))
    asked = fine.join(test, "table_id").select("split_id", key, exp).distinct()
    pairs = fine.select(key, raw, exp).distinct()
    answers = variant_lookup(asked, pairs, known, [key, exp], [raw, exp], by=["split_id"])
    return squared_error_sums(answers, fine, splits, key, exp)


def _row_errors(df: DataFrame, test: DataFrame, answers: DataFrame, keys: list[str], y: str) -> DataFrame:
    """Test rows of every split with their estimate and absolute error against ``_truth``, else against y."""
    own = [c for c in ("_truth",) if c in answers.columns]
    out = join_groups(df.join(test, "table_id"), answers.select("split_id", *keys, "estimate", *own),
                      ["split_id", *keys], "left")
    target = F.col("_truth") if own else F.col(y)
    return out.withColumn("error", F.abs(target - F.col("estimate"))).drop("_truth")


def learned_answers(df: DataFrame, splits: DataFrame, vectors: DataFrame, key: str, exp: str | None, y: str,
                    task: str = "salary", q: float = 0.75, **options) -> DataFrame:
    """(split_id, key[, exp], estimate): boosted trees on title vectors, fitted on the training tables of each split.

    ``task`` is salary (squared loss), sex (probability of 1) or quantile. The models of all
    splits grow together on cells per (table, key, exp), or counts per (table, key, value).
    """
    _, test = sides(splits)
    keys = [key] + ([exp] if exp else [])
    renamed = vectors.withColumnRenamed([c for c in vectors.columns if c != "vector"][0], key)
    stages = feature_stages(renamed, [exp] if exp else [], [], key)
    per_table = value_table(df, key, y).withColumnRenamed("_n", "n") if task == "quantile" else table_sums(df, key, exp, y)
    asked = per_table.join(test, "table_id").select("split_id", *keys).distinct()
    features = Pipeline(stages=stages).fit(per_table)
    cells = features.transform(per_table).select(
        F.col("table_id").alias("group"), "features", F.col("n").alias("weight"), F.col(y if task == "quantile" else "_s").alias("total"))
    trained = splits.where("is_test = 0").groupBy("split_id").agg(F.collect_set("table_id").alias("tables"))
    members = {r["split_id"]: set(r["tables"]) for r in trained.collect()}  # a row per split
    numbers = {s: i for i, s in enumerate(sorted(members))}
    loss = {"salary": "squared", "sex": "logistic", "quantile": "quantile"}[task]
    rate = options.pop("lr", 0.1)
    boosts = fit_many(materialize(cells, "cells"), [members[s] for s in numbers], [rate] * len(numbers), loss, q=q,
                      **{"depth": 3 if task == "quantile" else 5, **options})
    named = F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair)) if numbers else F.lit(None).cast("map<int,int>")
    mine = features.transform(asked).withColumn("_model", F.try_element_at(named, F.col("split_id")))
    return boosts.predict(mine, "estimate", model="_model").select("split_id", *keys, "estimate")


def cv_errors_learned(df: DataFrame, splits: DataFrame, vectors: DataFrame, key: str, exp: str | None, y: str,
                      task: str = "salary", raw: str | None = None, q: float = 0.75, **options) -> DataFrame:
    """Absolute error of the learned estimate of every test row in every split.

    With ``raw`` each row also tells ``n_variants``, how many spellings of its key the
    training tables hold.
    """
    _, test = sides(splits)
    keys = [key] + ([exp] if exp else [])
    answers = learned_answers(df, splits, vectors, key, exp, y, task, q, **options)
    if task == "quantile":
        counted = value_table(df, key, y).join(test, "table_id")
        truth = group_quantile(counted, ["split_id", key], y, q, weight="_n").select(
            "split_id", key, F.col("estimate").alias("_truth"))
        answers = join_groups(answers, truth, ["split_id", key], "left")
    out = _row_errors(df, test, answers, keys, y)
    if raw:
        known = n_variants(df, splits, keys, [raw] + ([exp] if exp else []))
        out = join_groups(out, known, ["split_id", *keys], "left").fillna({"n_variants": 0})
    return out


def squared_error_sums(answers: DataFrame, sums: DataFrame, splits: DataFrame, key: str, exp: str | None,
                       spread: bool = False) -> DataFrame:
    """Sum of squared errors per answered cell from the sums of y and y squared; with ``spread`` those sums too.

    No test row is touched: sum (y - e)^2 = sum y^2 - 2 e sum y + n e^2.
    """
    _, test = sides(splits)
    keys = ["split_id", key] + ([exp] if exp else [])
    cells = sums.join(test, "table_id").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_s", "_ss", "n")])
    e = F.col("estimate")
    out = join_groups(cells, answers, keys).withColumn("squared", F.col("_ss") - 2 * e * F.col("_s") + F.col("n") * e * e)
    return out if spread else out.drop("_s", "_ss")


def cv_rmse(df: DataFrame, splits: DataFrame, key: str, exp: str | None, y: str) -> DataFrame:
    """RMSE of matching & averaging per split, from sums only."""
    sums = table_sums(df, key, exp, y)
    keys = [key] + ([exp] if exp else [])
    _, test = sides(splits)
    asked = sums.join(test, "table_id").select("split_id", *keys).distinct()
    answers = estimate_lookup(asked, train_grains(sums, splits, key, exp), key, exp, ["split_id"])
    errors = squared_error_sums(answers, sums, splits, key, exp)
    return errors.groupBy("split_id").agg(
        F.sqrt(F.sum("squared") / F.sum("n")).alias("rmse"), F.sum("n").alias("n"))


def tune_threshold(df: DataFrame, splits: DataFrame, similar: DataFrame, thresholds: list[float], key: str,
                   exp: str | None, y: str, fit_on: str = "all", raw: str | None = None) -> DataFrame:
    """(t, rmse, n) of the kernel estimate for each threshold over all splits.

    ``similar`` must reach down to the smallest threshold; t is a column, so
    all thresholds share one pass.  ``fit_on`` 'seen' or 'unseen' keeps the
    test keys with or without variants in training.
    """
    keys = [key] + ([exp] if exp else [])
    sums = table_sums(df, key, exp, y)
    grains = train_grains(sums, splits, key, exp)
    _, test = sides(splits)
    asked = sums.join(test, "table_id").select("split_id", *keys).distinct()
    if fit_on != "all":
        known = n_variants(df, splits, keys, [raw or key] + ([exp] if exp else []))
        seen = F.col("n_variants") >= 1 if fit_on == "seen" else F.col("n_variants") == 0
        asked = join_groups(asked, known.where(seen).select("split_id", *keys), ["split_id", *keys], "left_semi")
    fallback = estimate_lookup(asked, grains, key, exp, ["split_id"]).withColumnRenamed("estimate", "_fallback")
    t = F.array(*[F.lit(float(x)) for x in thresholds])
    near = with_itself(similar, sums, key).withColumn("t", F.explode(t)).withColumn(
        "_w", (F.col("cos") - F.col("t")) / (1 - F.col("t"))).where(F.col("_w") > 0)
    cells = grains["fine"].withColumnRenamed(key, "_other")
    share = F.col("_w") * F.col("n")
    kernel = join_groups(cells, near.select(F.col("other").alias("_other"), key, "t", "_w"), ["_other"]).groupBy(
        "split_id", "t", *keys).agg(F.try_divide(F.sum(share * F.col("estimate")), F.sum(share)).alias("_kernel"))
    answers = join_groups(fallback.withColumn("t", F.explode(t)), kernel, ["split_id", "t", *keys], "left").withColumn(
        "estimate", F.coalesce("_kernel", "_fallback"))
    errors = squared_error_sums(answers.select("split_id", "t", *keys, "estimate"), sums, splits, key, exp)
    return errors.groupBy("t").agg(F.sqrt(F.sum("squared") / F.sum("n")).alias("rmse"), F.sum("n").alias("n"))


def subset_gaps(df: DataFrame, subsets: DataFrame, dismiss: bool = True) -> DataFrame:
    """Exact-matching gap of every subset of tables (split_id, table_id, is_test=1)."""
    _, chosen = sides(subsets)
    sums = cell_sums(df, ["table_id", *COVARIATES]).join(chosen, "table_id")
    return gap_of_cells(cell_means(merge_cells(sums, ["split_id", *COVARIATES])), dismiss, ["split_id"])


def subset_fuzzy(df: DataFrame, subsets: DataFrame, similar: DataFrame, threshold: float) -> DataFrame:
    """Fuzzy doubly robust gap of every subset of tables."""
    _, chosen = sides(subsets)
    sums = cell_sums(df, ["table_id", *COVARIATES]).join(chosen, "table_id")
    table = cell_means(merge_cells(sums, ["split_id", *COVARIATES]))
    return fuzzy_aipw_of_cells(table, similar, threshold, ["split_id"])


def r2(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    left = F.sum((F.col(y) - F.col(p)) ** 2)
    return df.groupBy(*(by or [])).agg((1 - left / (F.var_pop(y) * F.count(y))).alias("r2"))


def accuracy(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def average_precision(df: DataFrame, y: str, score: str, buckets: int = 1024) -> DataFrame:
    """Sum over falling scores of precision times the gain in recall.

    Rows are added up per score. Scores are cut at quantiles of a sample chosen by hash, so
    that single far ones do not leave the others in one bucket; running totals go over
    the buckets first, then inside each.
    """
    tied = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    total = df.where(F.col(score).isNotNull()).agg(F.sum(y)).first()[0]
    if not total:
        return df.sparkSession.createDataFrame([(0.0,)], "average_precision DOUBLE")
    bounds = range_bounds(tied, score, buckets)
    below = F.filter(F.array(*(F.lit(x) for x in bounds)), lambda x: F.col(score) <= x) if bounds else F.array()
    tagged = materialize(tied.withColumn("_b", F.size(below)), "scores")
    sums = tagged.groupBy("_b").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_p"))
    upto = Window.orderBy("_b")  # a row per bucket
    before = sums.select("_b", (F.sum("_n").over(upto) - F.col("_n")).alias("_n"),
                         (F.sum("_p").over(upto) - F.col("_p")).alias("_p"))
    inside = Window.partitionBy("_b").orderBy(F.desc(score))
    ranked = tagged.join(F.broadcast(before), "_b").select(
        "pos", (F.col("_n") + F.sum("n").over(inside)).alias("seen"),
        (F.col("_p") + F.sum("pos").over(inside)).alias("hits"))
    gain = F.col("pos") / F.lit(float(total))
    return ranked.agg(F.sum(F.col("hits") / F.col("seen") * gain).alias("average_precision"))


def sensitivity_sweep(df: DataFrame, runs: DataFrame, row_id: str, hashed: Column,
                      estimator: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """A gap estimator over many down-sampled copies at once.

    ``runs`` has (run_id, rate, table_id, men): in each run the men tables lose
    the share ``rate`` of their women and the other tables of their men.
    ``estimator(cells, by)`` gets the covariate cells of all runs together.

    The side that stays whole is added up per table once and only its sums are
    copied to the runs; single rows are looked at for the thinned side alone.
    """
    by = ["run_id", "rate"]
    keys = [*by, *COVARIATES]
    runs = F.broadcast(runs)
    whole = materialize(cell_sums(df, ["table_id", *COVARIATES]), "cells").join(runs, "table_id")
    men = F.col("men") == 1
    stays = whole.select(
        *keys, F.when(men, F.col("n1")).otherwise(F.col("n0")).alias("n"),
        F.when(men, F.col("n1")).otherwise(0).alias("n1"), F.when(men, 0).otherwise(F.col("n0")).alias("n0"),
        F.when(men, F.col("s1")).alias("s1"), F.when(~men, F.col("s0")).alias("s0"),
        F.when(men, F.col("c1")).otherwise(0).alias("c1"), F.when(men, 0).otherwise(F.col("c0")).alias("c0"),
    ).where("n > 0")
    thinned = df.join(runs.where("rate < 1"), "table_id").where(men == (F.col("gender") == 0))
    left = stratified_downsample(thinned, [*by, "men"], row_id, F.col("rate"), hashed)
    cells = merge_cells(stays.unionByName(cell_sums(left, keys)), keys)
    return estimator(cell_means(cells), by)


PLACES = 1024


def run_offset(run: Column, modulus: int, places: int = PLACES) -> Column:
    """Where on the circle of hashes a run begins to drop rows: at the edge of one of the buckets."""
    return F.pmod(run * 389, F.lit(places)) * -(-modulus // places)


def sensitivity_sweep_sums(df: DataFrame, runs: DataFrame, row_id: str, hashed: Column, modulus: int,
                           estimator: Callable[[DataFrame, list[str]], DataFrame], places: int = PLACES) -> DataFrame:
    """``sensitivity_sweep`` for very many runs: rows have one hash, and a run its own place to start from.

    ``hashed`` is below ``modulus``. Rows are added up once per (cell, table, sex, bucket of the
    hash). A run drops the rows from its start on, round the circle, until its share is gone:
    whole buckets, known from running sums over the buckets, and a part of one bucket, the
    only one whose rows are looked at. So rows never meet runs, but for a ``places``-th of them.
    """
    by, cover = ["run_id", "rate"], list(COVARIATES)
    width = -(-modulus // places)
    tagged = df.select("table_id", "gender", *cover, "salary", F.col(row_id).alias("_id"), hashed.cast("long").alias("_h"))
    tagged = tagged.withColumn("_b", F.floor(F.col("_h") / width).cast("int"))
    own = ["table_id", "gender", *cover]
    sums = materialize(tagged.groupBy(*own, "_b").agg(F.count("*").alias("n"), F.sum("salary").alias("s"), F.count("salary").alias("c")), "buckets")
    runs = F.broadcast(runs.withColumn("_k", (run_offset(F.col("run_id"), modulus, places) / width).cast("int")))
    thinned = (F.col("men") == 1) == (F.col("gender") == 0)

    # the bucket that holds the cut of each run and side
    turned = F.pmod(F.col("_b") - F.col("_k"), F.lit(places))
    sides_of = sums.groupBy("table_id", "gender", "_b").agg(F.sum("n").alias("n")).join(runs.where("rate < 1"), "table_id").where(thinned)
    counted = sides_of.groupBy(*by, "men", "gender", "_k", "_b").agg(F.sum("n").alias("n")).withColumn("_o", turned)
    side = Window.partitionBy(*by, "men", "gender")
    placed = counted.withColumns({"_upto": F.sum("n").over(side.orderBy("_o")), "_size": F.sum("n").over(side)})
    need = F.floor(F.col("_size") * F.col("rate"))
    cuts = placed.where((F.col("_upto") >= need) & (F.col("_upto") - F.col("n") < need)).select(
        *by, "men", "gender", F.col("_b").alias("_cut"), (need - F.col("_upto") + F.col("n")).alias("_need"))
    # a run that drops nothing has no cut: it keeps all buckets, as if it had ended just before its first one
    asked = runs.where("rate < 1").withColumn("gender", F.when(F.col("men") == 1, 0).otherwise(1)).join(cuts, [*by, "men", "gender"], "left")
    asked = materialize(asked, "cuts")

    # all rows beyond the cut, from running sums: those up to the start, less those up to the cut, and a whole turn if that lies behind
    cells = sums.select(*own).distinct()
    ends = join_groups(cells, asked.select("table_id", "gender", *by, "men", F.explode(F.array(
        F.struct((F.col("_k") - 1).alias("_b"), F.lit(1).alias("sign")),
        F.struct(F.coalesce("_cut", F.col("_k") - 1).alias("_b"), F.lit(-1).alias("sign")))).alias("e")).select(
            "table_id", "gender", *by, "men", "e._b", "e.sign"), ["table_id", "gender"])
    nil = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = sums.unionByName(ends, allowMissingColumns=True)
    upto = Window.partitionBy(*own).orderBy("_b", F.col("run_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    running = both.select(*own, *by, "men", "sign", *(F.sum(nil(x)).over(upto).alias(x) for x in ("n", "s", "c"))).where("run_id IS NOT NULL")
    span = running.groupBy(*own, *by, "men").agg(*(F.sum(F.col(x) * F.col("sign")).alias(x) for x in ("n", "s", "c")))
    turn = asked.select("table_id", "gender", *by, "men", (F.col("_cut").isNull() | (F.col("_cut") >= F.col("_k"))).alias("_turn"))
    total = sums.groupBy(*own).agg(*(F.sum(x).alias(f"_{x}") for x in ("n", "s", "c")))
    kept = join_groups(join_groups(span, turn, ["table_id", "gender", *by, "men"]), total, own)
    kept = kept.select(*own, *by, *((F.col(x) + F.when(F.col("_turn"), nil(f"_{x}")).otherwise(0)).alias(x) for x in ("n", "s", "c")))

    # the rows of the cut bucket beyond the cut
    opened = tagged.join(F.broadcast(asked.where("_cut IS NOT NULL").select("table_id", "gender", *by, "men", F.col("_cut").alias("_b"), "_need")),
                         ["table_id", "gender", "_b"])
    inside = Window.partitionBy(*by, "men", "gender").orderBy("_h", "_id")
    opened = opened.withColumn("_r", F.row_number().over(inside)).where(F.col("_r") > F.col("_need"))
    opened = opened.groupBy(*own, *by).agg(F.count("*").alias("n"), F.sum("salary").alias("s"), F.count("salary").alias("c"))

    stays = sums.groupBy(*own).agg(*(F.sum(x).alias(x) for x in ("n", "s", "c"))).join(runs, "table_id").where(~thinned)
    parts = stays.select(*own, *by, "n", "s", "c").unionByName(kept).unionByName(opened).where("n > 0")
    men, women = F.col("gender") == 1, F.col("gender") == 0
    merged = parts.groupBy(*by, *cover).agg(
        F.sum("n").alias("n"), F.sum(F.when(men, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(women, F.col("n")).otherwise(0)).alias("n0"),
        F.sum(F.when(men & (F.col("c") > 0), F.col("s"))).alias("s1"), F.sum(F.when(women & (F.col("c") > 0), F.col("s"))).alias("s0"),
        F.sum(F.when(men, F.col("c")).otherwise(0)).alias("c1"), F.sum(F.when(women, F.col("c")).otherwise(0)).alias("c0"))
    return estimator(cell_means(merged), by)

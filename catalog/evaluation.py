"""Splits, cross-table errors, tuning and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql as Q
from catalog.gaps import EFFECT, cells_sql, gap_sql, opposite_sql, smooth_sql
from catalog.lookups import T, fine, similar_titles, title_vectors
from catalog.registry import query
from motley.functions import hashing
from motley.operators import sampling
from motley.plans import evaluate as ev
from motley.plans import gap
from motley.sources.people import N_TABLES, people, table
from motley.workdir import materialize

P = f"WITH {Q.PEOPLE}"
GROUPS = list(range(N_TABLES))
SHUFFLED = sampling.group_shuffle_split(GROUPS, 4, 7)
LEFT_OUT = sampling.leave_one_group_out(GROUPS)
SUBSETS = sampling.group_shuffle_split(GROUPS, 6, 3, seed=0)


def splits_sql(tests, name="splits") -> str:
    rows = ", ".join(f"({s}, {g}, {int(g in t)})" for s, t in enumerate(tests) for g in GROUPS)
    return f"{name}(split_id, table_id, is_test) AS (SELECT * FROM (VALUES {rows}))"


def splits(spark, tests):
    return sampling.split_table(spark, GROUPS, tests)


@query("group_shuffle_split", f"""{P}, {splits_sql(SHUFFLED)} SELECT split_id, is_test, count(*) AS n FROM people
  JOIN splits USING (table_id) GROUP BY ALL""")
def group_shuffle_split(spark, sf):
    return people(spark, sf, "table_id").join(F.broadcast(splits(spark, SHUFFLED)), "table_id").groupBy(
        "split_id", "is_test").agg(F.count("*").alias("n"))


@query("leave_one_group_out", f"""{P}, {splits_sql(LEFT_OUT)} SELECT split_id, is_test, count(*) AS n FROM people
  JOIN splits USING (table_id) GROUP BY ALL""")
def leave_one_group_out(spark, sf):
    return people(spark, sf, "table_id").join(F.broadcast(splits(spark, LEFT_OUT)), "table_id").groupBy(
        "split_id", "is_test").agg(F.count("*").alias("n"))


@query("kfold", f"SELECT o_orderkey, CAST(({hashing.mixed_hash_sql('o_orderkey', 1)}) % 5 AS INTEGER) AS fold FROM orders")
def kfold(spark, sf):
    return sampling.kfold(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5,
                          hashed=hashing.mixed_hash(F.col("o_orderkey"), 1))


@query("stratified_kfold", f"""SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY
  {hashing.mixed_hash_sql('doc_id', 2)}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels""")
def stratified_kfold(spark, sf):
    return sampling.stratified_kfold(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality", 5,
                                     hashing.widened(hashing.mixed_hash(F.col("doc_id"), 2))).select("doc_id", "quality", "fold")


def _train(keys: str, y: str = "salary") -> str:
    return f"""{splits_sql(SHUFFLED)}, train AS (SELECT split_id, {keys}, {y} AS y FROM people JOIN splits USING (table_id) WHERE is_test = 0),
  test AS (SELECT split_id, row_id, {keys}, {y} AS y FROM people JOIN splits USING (table_id) WHERE is_test = 1)"""


_SALARY = f"""{_train('matched_title, seniority')}, f AS (SELECT split_id, matched_title, seniority, avg(y) AS e FROM train GROUP BY ALL),
  x AS (SELECT split_id, seniority, avg(y) AS e FROM train GROUP BY ALL), a AS (SELECT split_id, avg(y) AS e FROM train GROUP BY ALL),
  err AS (SELECT split_id, row_id, abs(y - coalesce(f.e, x.e, a.e)) AS error FROM test LEFT JOIN f USING (split_id, matched_title, seniority)
    LEFT JOIN x USING (split_id, seniority) JOIN a USING (split_id))"""


@query("cv_errors", f"{P}, {_SALARY} SELECT split_id, row_id, round(error, 4) AS error FROM err")
def cv_errors(spark, sf):
    p = people(spark, sf, "row_id", "table_id", "matched_title", "seniority", "salary")
    return ev.cv_errors(p, splits(spark, SHUFFLED), "matched_title", "seniority", "salary").select(
        "split_id", "row_id", F.round("error", 4).alias("error"))


@query("matching_average", f"""{P}, {_SALARY} SELECT split_id, round(sqrt(avg(error * error)), 4) AS rmse, count(*) AS n
  FROM err GROUP BY ALL""")
def matching_average(spark, sf):
    """RMSE of the salary estimate per split, computed from sums per table only."""
    p = people(spark, sf, "table_id", "matched_title", "seniority", "salary")
    return ev.cv_rmse(p, splits(spark, SHUFFLED), "matched_title", "seniority", "salary").withColumn(
        "rmse", F.round("rmse", 4))


_QUANTILE = f"""{_train('matched_title')}, f AS (SELECT split_id, matched_title, quantile_cont(y, 0.75) AS e, count(*) AS n FROM train GROUP BY ALL),
  a AS (SELECT split_id, sum(e * n) / sum(n) AS e FROM f GROUP BY ALL), q AS (SELECT split_id, matched_title, quantile_cont(y, 0.75) AS t
    FROM test GROUP BY ALL),
  err AS (SELECT split_id, row_id, abs(t - coalesce(f.e, a.e)) AS error FROM test JOIN q USING (split_id, matched_title)
    LEFT JOIN f USING (split_id, matched_title) JOIN a USING (split_id))"""


@query("cv_errors_quantile", f"{P}, {_QUANTILE} SELECT split_id, row_id, round(error, 4) AS error FROM err")
def cv_errors_quantile(spark, sf):
    p = people(spark, sf, "row_id", "table_id", "matched_title", "salary")
    return ev.cv_errors(p, splits(spark, SHUFFLED), "matched_title", None, "salary", task="quantile").select(
        "split_id", "row_id", F.round("error", 4).alias("error"))


@query("quantile_sketches", f"""{P}, {splits_sql(sampling.group_shuffle_split(GROUPS, 40, 7, seed=3))} SELECT split_id, matched_title, count(*) AS n,
  true AS near_rank FROM people JOIN splits USING (table_id) WHERE is_test = 0 GROUP BY ALL""")
def quantile_sketches(spark, sf):
    """Quantiles of forty splits from one sketch per table and title; near the wanted rank among the rows of the split."""
    p = people(spark, sf, "table_id", "matched_title", "salary")
    s = splits(spark, sampling.group_shuffle_split(GROUPS, 40, 7, seed=3))
    found = ev.sketched_train_quantiles(p, s, "matched_title", "salary", k=400)["fine"]
    train, _ = ev.sides(s)
    values = ev.value_table(p, "matched_title", "salary").join(train, "table_id").join(found, ["split_id", "matched_title"])
    below = F.sum(F.when(F.col("salary") <= F.col("estimate"), F.col("_n")).otherwise(0)) / F.sum("_n")
    under = F.sum(F.when(F.col("salary") < F.col("estimate"), F.col("_n")).otherwise(0)) / F.sum("_n")
    return values.groupBy("split_id", "matched_title", "n").agg(((below >= 0.73) & (under <= 0.77)).alias("near_rank"))


_SEX = f"""{_train('matched_title', 'gender')}, f AS (SELECT split_id, matched_title, avg(y) AS e FROM train GROUP BY ALL),
  a AS (SELECT split_id, avg(y) AS e FROM train GROUP BY ALL),
  err AS (SELECT split_id, row_id, abs(y - coalesce(f.e, a.e)) AS error FROM test LEFT JOIN f USING (split_id, matched_title) JOIN a USING (split_id))"""


def _errors(spark, sf, task):
    """Error sums of a task per split."""
    y, exp = ("gender", None) if task == "sex" else ("salary", None if task == "quantile" else "seniority")
    p = people(spark, sf, "table_id", "matched_title", *([exp] if exp else []), y)
    return ev.mean_errors(ev.error_sums(p, splits(spark, SHUFFLED), "matched_title", exp, y, task), ["split_id"])


@query("rmse", f"{P}, {_SALARY} SELECT split_id, round(sqrt(avg(error * error)), 4) AS rmse FROM err GROUP BY ALL")
def rmse(spark, sf):
    return _errors(spark, sf, "salary").select("split_id", F.round("rmse", 4).alias("rmse"))


@query("mae", f"{P}, {_QUANTILE} SELECT split_id, round(avg(error), 4) AS mae FROM err GROUP BY ALL")
def mae(spark, sf):
    return _errors(spark, sf, "quantile").select("split_id", F.round("mae", 4).alias("mae"))


@query("brier", f"{P}, {_SEX} SELECT split_id, round(avg(error * error), 8) AS brier FROM err GROUP BY ALL")
def brier(spark, sf):
    return _errors(spark, sf, "sex").select("split_id", F.round("brier", 8).alias("brier"))


# one table against the rest keeps titles with no, one or more known variants apart
_RARE = [[g for g in GROUPS if g != 0], [g for g in GROUPS if g not in (1, 2)]]
_VARIANTS = f"""{splits_sql(_RARE)}, spelled AS (SELECT DISTINCT table_id, fine_title AS k, seniority, job_title || '|' || fine_title AS raw FROM people),
  asked AS (SELECT DISTINCT split_id, k, seniority FROM spelled JOIN splits USING (table_id) WHERE is_test = 1),
  seen AS (SELECT DISTINCT split_id, k, seniority, raw FROM spelled JOIN splits USING (table_id) WHERE is_test = 0),
  nv AS (SELECT split_id, k, seniority, count(raw) AS n_variants FROM asked LEFT JOIN seen USING (split_id, k, seniority) GROUP BY ALL)"""


def _spelled(spark, sf, *more):
    return people(spark, sf, "table_id", "fine_title", "job_title", "seniority", *more).withColumn(
        "raw", F.concat_ws("|", "job_title", "fine_title")).withColumnRenamed("fine_title", "k")


@query("n_variants", f"{P}, {_VARIANTS} SELECT split_id, k, seniority, n_variants FROM nv")
def n_variants(spark, sf):
    return ev.n_variants(_spelled(spark, sf), splits(spark, _RARE), ["k", "seniority"], ["raw", "seniority"]).select(
        "split_id", "k", "seniority", "n_variants")


@query("error_by_variants", f"""{P}, {_VARIANTS}, tr AS (SELECT split_id, fine_title AS k, seniority, salary FROM people JOIN splits USING (table_id) WHERE is_test = 0),
  f AS (SELECT split_id, k, seniority, avg(salary) AS e FROM tr GROUP BY ALL), x AS (SELECT split_id, seniority, avg(salary) AS e FROM tr GROUP BY ALL),
  a AS (SELECT split_id, avg(salary) AS e FROM tr GROUP BY ALL),
  err AS (SELECT split_id, n_variants, abs(salary - coalesce(f.e, x.e, a.e)) AS error FROM (SELECT split_id, fine_title AS k, seniority, salary
    FROM people JOIN splits USING (table_id) WHERE is_test = 1) LEFT JOIN f USING (split_id, k, seniority) LEFT JOIN x USING (split_id, seniority)
    LEFT JOIN a USING (split_id) JOIN nv USING (split_id, k, seniority))
  SELECT split_id, CASE n_variants WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS seen,
  round(sqrt(avg(error * error)), 4) AS rmse, round(avg(error), 4) AS mae, count(*) AS n FROM err GROUP BY ALL""")
def error_by_variants(spark, sf):
    found = ev.error_by_variants(_spelled(spark, sf, "salary"), splits(spark, _RARE), "k", "seniority", "salary", "raw")
    return found.select("split_id", "seen", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), "n")


@query("mae_salary", f"{P}, {_SALARY} SELECT split_id, round(avg(error), 4) AS mae, count(*) AS n FROM err GROUP BY ALL")
def mae_salary(spark, sf):
    """Absolute errors of the salary from running sums over its distinct values."""
    p = people(spark, sf, "table_id", "matched_title", "seniority", "salary")
    sums = ev.error_sums(p, splits(spark, SHUFFLED), "matched_title", "seniority", "salary", absolute=True)
    return ev.mean_errors(sums, ["split_id"]).select("split_id", F.round("mae", 4).alias("mae"), "n")


@query("partial_matching", f"""{P}, {_train('matched_title, title, seniority')}, v AS (SELECT DISTINCT matched_title, title FROM people),
  known AS (SELECT split_id, title, seniority, avg(y) AS e FROM train GROUP BY ALL),
  picked AS (SELECT split_id, matched_title, seniority, arg_min(e, md5(title || '|' || seniority || '|0')) AS e
    FROM (SELECT DISTINCT matched_title, title, seniority FROM people) JOIN known USING (title, seniority) GROUP BY ALL)
  SELECT split_id, round(sqrt(avg((y - coalesce(e, -1)) ** 2)), 4) AS rmse, count(*) AS n FROM test LEFT JOIN picked
  USING (split_id, matched_title, seniority) GROUP BY ALL""")
def partial_matching(spark, sf):
    p = people(spark, sf, "table_id", "matched_title", "title", "seniority", "salary")
    sums = ev.partial_matching(p, splits(spark, SHUFFLED), "matched_title", "title", "seniority", "salary")
    return ev.mean_errors(sums, ["split_id"]).select("split_id", F.round("rmse", 4).alias("rmse"), "n")


_K = f"""fine AS (SELECT split_id, fine_title AS title, seniority, avg(salary) AS e, count(*) AS n FROM people JOIN splits USING (table_id)
    WHERE is_test = 0 GROUP BY ALL),
  x AS (SELECT split_id, seniority, sum(e * n) / sum(n) AS e FROM fine GROUP BY ALL),
  k AS (SELECT split_id, s.title, seniority, sum({Q.kernel(T)} * n * e) / sum({Q.kernel(T)} * n) AS e FROM near_titles s
    JOIN fine f ON s.other = f.title WHERE {Q.kernel(T)} > 0 GROUP BY ALL)"""


@query("fuzzy_estimator", f"""{P}, {Q.similar(T, 'fine_title')}, {splits_sql(SHUFFLED)}, {_K}
  SELECT split_id, round(sqrt(avg((salary - coalesce(k.e, x.e)) ** 2)), 4) AS rmse, count(*) AS n
  FROM (SELECT split_id, fine_title AS title, seniority, salary FROM people JOIN splits USING (table_id) WHERE is_test = 1)
  LEFT JOIN k USING (split_id, title, seniority) JOIN x USING (split_id, seniority) GROUP BY ALL""")
def fuzzy_estimator(spark, sf):
    p = fine(spark, sf, "table_id", "seniority", "salary")
    sums = ev.error_sums(p, splits(spark, SHUFFLED), "title", "seniority", "salary",
                         similar=similar_titles(spark, sf, "fine_title"), threshold=T)
    return ev.mean_errors(sums, ["split_id"]).select("split_id", F.round("rmse", 4).alias("rmse"), "n")


_TS = [0.9, 0.8, 0.7, 0.6, 0.5]


@query("tune_threshold", f"""{P}, {Q.similar(0.5, 'matched_title')}, {splits_sql(LEFT_OUT)},
  fine AS (SELECT split_id, matched_title AS title, seniority, avg(salary) AS e, count(*) AS n FROM people JOIN splits USING (table_id)
    WHERE is_test = 0 GROUP BY ALL),
  x AS (SELECT split_id, seniority, sum(e * n) / sum(n) AS e FROM fine GROUP BY ALL), ts AS (SELECT unnest({_TS}) AS t),
  k AS (SELECT t, split_id, s.title, seniority, sum((cos - t) / (1 - t) * n * e) / sum((cos - t) / (1 - t) * n) AS e FROM near_titles s
    JOIN fine f ON s.other = f.title CROSS JOIN ts WHERE cos > t GROUP BY ALL)
  SELECT CAST(t AS DOUBLE) AS t, round(sqrt(avg((salary - coalesce(k.e, x.e)) ** 2)), 4) AS rmse, count(*) AS n FROM (SELECT split_id,
    matched_title AS title, seniority, salary FROM people JOIN splits USING (table_id) WHERE is_test = 1) CROSS JOIN ts
  LEFT JOIN k USING (t, split_id, title, seniority) JOIN x USING (split_id, seniority) GROUP BY t""")
def tune_threshold(spark, sf):
    p = people(spark, sf, "table_id", "matched_title", "seniority", "salary").withColumnRenamed("matched_title", "title")
    near = similar_titles(spark, sf, "matched_title", 0.5)
    return ev.tune_threshold(p, splits(spark, LEFT_OUT), near, _TS, "title", "seniority", "salary").withColumn(
        "rmse", F.round("rmse", 4))


_SUBSET_CELLS = cells_sql("people JOIN splits USING (table_id) WHERE is_test = 1", "title", "split_id, ")


@query("subset_runs", f"{P}, {splits_sql(SUBSETS)}, {_SUBSET_CELLS} {gap_sql(True, 'split_id, ')} GROUP BY split_id")
def subset_runs(spark, sf):
    p = people(spark, sf, "table_id", "title", "seniority", "employer", "ethnicity", "gender", "salary")
    return ev.subset_gaps(p, splits(spark, SUBSETS)).withColumn("ate", F.round("ate", 4))


SIZES = [sampling.group_shuffle_split(GROUPS, 2, n, seed=n) for n in (1, 7)] + [[GROUPS]]
BY_SIZE = [tables for runs in SIZES for tables in runs]


@query("subset_sizes", f"{P}, {splits_sql(BY_SIZE)}, {_SUBSET_CELLS} {gap_sql(True, 'split_id, ')} GROUP BY split_id")
def subset_sizes(spark, sf):
    """The exact gap over 1, 7 and all 14 tables."""
    p = people(spark, sf, "table_id", "title", "seniority", "employer", "ethnicity", "gender", "salary")
    return ev.subset_gaps(p, splits(spark, BY_SIZE)).withColumn("ate", F.round("ate", 4))


@query("subset_fuzzy", f"""{P}, {Q.similar(T, 'title')}, {splits_sql(BY_SIZE)}, {_SUBSET_CELLS}, {smooth_sql('split_id')}
  SELECT split_id, round(sum(n * {EFFECT}) / sum(n), 4) AS ate, CAST(sum(n) AS BIGINT) AS n_rows FROM smooth GROUP BY split_id""")
def subset_fuzzy(spark, sf):
    """The fuzzy doubly robust gap over 1, 7 and all 14 tables."""
    p = people(spark, sf, "table_id", "title", "seniority", "employer", "ethnicity", "gender", "salary")
    out = ev.subset_fuzzy(p, splits(spark, BY_SIZE), similar_titles(spark, sf, "title"), T)
    return out.select("split_id", F.round("ate", 4).alias("ate"), "n_rows")


MANY = sampling.group_shuffle_split(GROUPS, 40, 7, seed=3)


def _learned(spark, sf, task, exp, y):
    """Errors of shallow trees over forty splits, whose models grow together, beside those of the mean of the test rows."""
    p = people(spark, sf, "table_id", "title", *([exp] if exp else []), y)
    vectors = materialize(title_vectors(spark, sf, "title"), "vectors")
    s = splits(spark, MANY)
    answers = ev.learned_answers(p, s, vectors, "title", exp, y, task, rounds=3, depth=3)
    errors = ev.squared_error_sums(answers, ev.table_sums(p, "title", exp, y), s, "title", exp, spread=True)
    rows = errors.groupBy("split_id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("squared").isNotNull(), F.col("n"))).alias("n_known"),
                                          F.sum("squared").alias("squared"), F.sum("_s").alias("_s"), F.sum("_ss").alias("_ss"))
    mean = F.col("_ss") - F.col("_s") * F.col("_s") / F.col("n")
    return rows.select("split_id", "n", "n_known", (F.col("squared") < 1.05 * mean).alias("near_or_below_mean"))


_LEARNED = f"""{P}, {splits_sql(MANY)} SELECT split_id, count(*) AS n, count(*) AS n_known, true AS near_or_below_mean
  FROM people JOIN splits USING (table_id) WHERE is_test = 1 GROUP BY split_id"""


@query("cv_errors_learned", _LEARNED)
def cv_errors_learned(spark, sf):
    return _learned(spark, sf, "salary", "seniority", "salary")


@query("cv_errors_learned_sex", _LEARNED)
def cv_errors_learned_sex(spark, sf):
    return _learned(spark, sf, "sex", None, "gender")


@query("cv_errors_learned_quantile", f"""{P}, {splits_sql(SHUFFLED)} SELECT split_id, count(*) AS n, count(*) AS n_known, true AS near_share
  FROM people JOIN splits USING (table_id) WHERE is_test = 1 GROUP BY split_id""")
def cv_errors_learned_quantile(spark, sf):
    """About three quarters of the test salaries lie below the learned quantile."""
    p = people(spark, sf, "table_id", "title", "salary")
    vectors = materialize(title_vectors(spark, sf, "title"), "vectors")
    out = ev.cv_errors_learned(p, splits(spark, SHUFFLED), vectors, "title", None, "salary", "quantile")
    below = F.avg((F.col("salary") <= F.col("estimate")).cast("double"))
    return out.groupBy("split_id").agg(F.count("*").alias("n"), F.count("error").alias("n_known"), below.between(0.65, 0.85).alias("near_share"))


RUNS = [(r * 10 + k, rate, g, int(g in men)) for r, rate in enumerate((0.3, 0.75, 1.0))
        for k, men in enumerate(sampling.group_shuffle_split(GROUPS, 3, 7, seed=r)) for g in GROUPS]
_RUNS_SQL = "runs(run_id, rate, table_id, men) AS (SELECT * FROM (VALUES " + ", ".join(
    f"({r}, {rate}::DOUBLE, {g}, {m})" for r, rate, g, m in RUNS) + "))"


@query("sensitivity_sweep", f"""{P}, {_RUNS_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY run_id, men, gender ORDER BY
    {hashing.mixed_hash_sql('row_id', 'run_id')}, row_id) AS r, count(*) OVER (PARTITION BY run_id, men, gender) AS size
    FROM people JOIN runs USING (table_id)),
  down AS (SELECT * FROM numbered WHERE r > CASE WHEN (men = 1) = (gender = 0) THEN floor(size * rate) ELSE 0 END),
  {cells_sql('down', 'title', 'run_id, rate, ')} {gap_sql(True, 'run_id, rate, ')} GROUP BY run_id, rate""")
def sensitivity_sweep(spark, sf):
    p = people(spark, sf, "row_id", "table_id", "title", "seniority", "employer", "ethnicity", "gender", "salary")
    runs = spark.createDataFrame(RUNS, "run_id INT, rate DOUBLE, table_id INT, men INT")
    out = ev.sensitivity_sweep(p, runs, "row_id", hashing.widened(hashing.mixed_hash(F.col("row_id"), F.col("run_id"))),
                               lambda cells, by: gap.gap_of_cells(cells, by=by))
    return out.withColumn("ate", F.round("ate", 4))


MANY_RUNS = [(r * 100 + k, rate, g, int(g in men)) for r, rate in enumerate((0.0, 0.3, 0.55, 0.75, 0.88, 1.0))
             for k, men in enumerate(sampling.group_shuffle_split(GROUPS, 20, 7, seed=10 + r)) for g in GROUPS]
_MANY_SQL = "runs(run_id, rate, table_id, men) AS (SELECT * FROM (VALUES " + ", ".join(
    f"({r}, {rate}::DOUBLE, {g}, {m})" for r, rate, g, m in MANY_RUNS) + "))"
_WIDTH = -(-hashing.MODULUS // ev.PLACES)


@query("sensitivity_sweep_sums", f"""{P}, {_MANY_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY run_id, men, gender ORDER BY
    ({hashing.mixed_hash_sql('row_id')} - (run_id * 389) % {ev.PLACES} * {_WIDTH} + {ev.PLACES * _WIDTH}) % {ev.PLACES * _WIDTH}, row_id) AS r,
    count(*) OVER (PARTITION BY run_id, men, gender) AS size FROM people JOIN runs USING (table_id)),
  down AS (SELECT * FROM numbered WHERE r > CASE WHEN (men = 1) = (gender = 0) THEN floor(size * rate) ELSE 0 END),
  {cells_sql('down', 'title', 'run_id, rate, ')} {gap_sql(True, 'run_id, rate, ')} GROUP BY run_id, rate""")
def sensitivity_sweep_sums(spark, sf):
    """Twenty runs for each of six rates, from sums per hash bucket."""
    p = people(spark, sf, "row_id", "table_id", "title", "seniority", "employer", "ethnicity", "gender", "salary")
    runs = spark.createDataFrame(MANY_RUNS, "run_id INT, rate DOUBLE, table_id INT, men INT")
    out = ev.sensitivity_sweep_sums(p, runs, "row_id", hashing.mixed_hash(F.col("row_id")), hashing.MODULUS,
                                    lambda cells, by: gap.gap_of_cells(cells, by=by))
    return out.withColumn("ate", F.round("ate", 4))


@query("sensitivity_opposite", f"""{P}, {Q.similar(T, 'title')}, {_RUNS_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY run_id, men, gender ORDER BY
    {hashing.mixed_hash_sql('row_id', 'run_id')}, row_id) AS r, count(*) OVER (PARTITION BY run_id, men, gender) AS size
    FROM people JOIN runs USING (table_id)),
  down AS (SELECT * FROM numbered WHERE r > CASE WHEN (men = 1) = (gender = 0) THEN floor(size * rate) ELSE 0 END),
  {cells_sql('down', 'title', 'run_id, rate, ')}, {opposite_sql('run_id, rate')},
  used AS (SELECT run_id, rate, n, gap FROM fuzzy UNION ALL SELECT run_id, rate, n, y1 - y0 FROM cells WHERE n1 > 0 AND n0 > 0),
  whole AS (SELECT run_id, rate, sum(n) AS total FROM cells GROUP BY ALL)
  SELECT run_id, rate, round(sum(gap * n) / sum(n), 4) AS ate, CAST(any_value(total) AS BIGINT) AS n_rows, coalesce(sum(n), 0) / any_value(total) AS share_kept
  FROM whole LEFT JOIN used USING (run_id, rate) GROUP BY run_id, rate""")
def sensitivity_opposite(spark, sf):
    """The sweep with the estimator that borrows from similar cells of the other sex."""
    p = people(spark, sf, "row_id", "table_id", "title", "seniority", "employer", "ethnicity", "gender", "salary")
    runs = spark.createDataFrame(RUNS, "run_id INT, rate DOUBLE, table_id INT, men INT")
    near = similar_titles(spark, sf, "title")
    out = ev.sensitivity_sweep(p, runs, "row_id", hashing.widened(hashing.mixed_hash(F.col("row_id"), F.col("run_id"))),
                               lambda cells, by: gap.fuzzy_opposite_gap_of_cells(cells, near, T, by))
    return out.select("run_id", "rate", F.round("ate", 4).alias("ate"), "n_rows", "share_kept")


# score of a document: the last two digits of its length, against its label
_SCORED = """SELECT quality AS y, CAST(n_chars % 100 AS DOUBLE) / 100 AS score FROM labels JOIN documents USING (doc_id)"""


def _scored(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(
        F.col("quality").alias("y"), (F.pmod("n_chars", F.lit(100)).cast("double") / 100).alias("score"))


@query("average_precision", f"""WITH s AS ({_SCORED}), g AS (SELECT score, sum(y) AS pos, count(*) AS n FROM s GROUP BY ALL),
  c AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS hits, sum(n) OVER (ORDER BY score DESC) AS seen FROM g)
  SELECT round(sum(hits / seen * pos / (SELECT sum(y) FROM s)), 8) AS average_precision FROM c""")
def average_precision(spark, sf):
    return ev.average_precision(_scored(spark, sf), "y", "score").select(
        F.round("average_precision", 8).alias("average_precision"))


@query("accuracy", f"SELECT avg(CAST(y = CAST(score >= 0.5 AS INTEGER) AS DOUBLE)) AS accuracy FROM ({_SCORED})")
def accuracy(spark, sf):
    return ev.accuracy(_scored(spark, sf).withColumn("p", (F.col("score") >= 0.5).cast("int")), "y", "p")


@query("r2", f"""{P}, g AS (SELECT title, avg(salary) AS p FROM people GROUP BY ALL)
  SELECT round(1 - sum((salary - p) ** 2) / (var_pop(salary) * count(*)), 8) AS r2 FROM people JOIN g USING (title)""")
def r2(spark, sf):
    p = people(spark, sf, "title", "salary")
    means = p.groupBy("title").agg(F.avg("salary").alias("p"))
    return ev.r2(p.join(means, "title"), "salary", "p").withColumn("r2", F.round("r2", 8))

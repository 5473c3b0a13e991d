"""Aggregations, top-k, sets and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql as Q
from catalog.registry import query
from motley.functions import hashing
from motley.functions.grams import ngram_set
from motley.operators import aggregates as agg
from motley.operators import dictionary as dic
from motley.operators import sampling
from motley.sources.people import people, table, titles

P = f"WITH {Q.PEOPLE}"


@query("group_mean", f"""{P} SELECT title, seniority, avg(salary) AS estimate, count(*) AS n FROM people GROUP BY ALL""")
def group_mean(spark, sf):
    return agg.group_mean(people(spark, sf, "title", "seniority", "salary"), ["title", "seniority"], "salary")


@query("group_quantile", f"""{P} SELECT title, round(quantile_cont(salary, 0.75), 4) AS estimate, count(*) AS n
  FROM people GROUP BY ALL""")
def group_quantile(spark, sf):
    return agg.group_quantile(people(spark, sf, "title", "salary"), ["title"], "salary", 0.75).withColumn(
        "estimate", F.round("estimate", 4))


@query("group_quantile_large", f"""{P} SELECT employer, round(quantile_cont(salary, 0.75), 4) AS estimate, count(*) AS n
  FROM people GROUP BY ALL""")
def group_quantile_large(spark, sf):
    """The two-step path for keys with many distinct values."""
    return agg.group_quantile(people(spark, sf, "employer", "salary"), ["employer"], "salary", 0.75,
                              buckets=64).withColumn("estimate", F.round("estimate", 4))


@query("mean_by_experience", f"{P} SELECT seniority, avg(salary) AS estimate, count(*) AS n FROM people GROUP BY ALL")
def mean_by_experience(spark, sf):
    return agg.group_mean(people(spark, sf, "seniority", "salary"), ["seniority"], "salary")


@query("weighted_global", f"""{P} SELECT round(sum(e * n) / sum(n), 4) AS estimate, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT title, quantile_cont(salary, 0.75) AS e, count(*) AS n FROM people GROUP BY ALL)""")
def weighted_global(spark, sf):
    groups = agg.group_quantile(people(spark, sf, "title", "salary"), ["title"], "salary", 0.75)
    return agg.weighted_global(groups).withColumn("estimate", F.round("estimate", 4))


@query("multi_grain_estimates", f"""{P} SELECT title, seniority, avg(salary) AS estimate, count(*) AS n,
  CASE GROUPING(title, seniority) WHEN 0 THEN 'key_exp' WHEN 2 THEN 'exp' ELSE 'all' END AS grain FROM people
  GROUP BY GROUPING SETS ((title, seniority), (seniority), ())""")
def multi_grain_estimates(spark, sf):
    return agg.multi_grain_estimates(people(spark, sf, "title", "seniority", "salary"), "title", "seniority", "salary")


@query("value_counts", f"{P} SELECT job_title, count(*) AS n FROM people GROUP BY ALL")
def value_counts(spark, sf):
    return agg.value_counts(people(spark, sf, "job_title"), "job_title")


@query("count_distinct", f"""{P} SELECT unnest(['job_title', 'title', 'matched_title', 'fine_title']) AS "column", unnest([
  count(DISTINCT job_title), count(DISTINCT title), count(DISTINCT matched_title), count(DISTINCT fine_title)]) AS n FROM people""")
def count_distinct(spark, sf):
    names = ["job_title", "title", "matched_title", "fine_title"]
    return agg.count_distinct(people(spark, sf, *names), names)


@query("list_variants", f"""{P}, v AS (SELECT DISTINCT matched_title, job_title FROM people)
  SELECT matched_title, job_title, count(*) OVER (PARTITION BY matched_title) AS n_variants FROM v""")
def list_variants(spark, sf):
    return dic.list_variants(people(spark, sf, "matched_title", "job_title"), "matched_title", "job_title")


@query("variant_map", f"{P} SELECT DISTINCT matched_title, seniority, title FROM people")
def variant_map(spark, sf):
    return dic.variants(people(spark, sf, "matched_title", "seniority", "title"), ["matched_title", "seniority"], ["title"])


@query("target_stats", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def target_stats(spark, sf):
    return agg.target_stats(table(spark, sf, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


@query("target_stats_multiclass", f"""{P} SELECT title, count(*) AS n, """ + ", ".join(
    f"avg(CAST(employer = '{c}' AS INTEGER)) AS share_{c}" for c in "ANR") + " FROM people GROUP BY ALL")
def target_stats_multiclass(spark, sf):
    return agg.target_stats(people(spark, sf, "title", "employer"), "title", "employer", classes=["A", "N", "R"])


_COVARIATES = ["title", "seniority", "ethnicity", "employer"]


@query("propensity_by_group", f"{P} SELECT {', '.join(_COVARIATES)}, avg(gender) AS propensity, count(*) AS n FROM people GROUP BY ALL")
def propensity_by_group(spark, sf):
    return agg.propensity_by_group(people(spark, sf, *_COVARIATES, "gender"), _COVARIATES)


@query("conditional_means", f"""{P} SELECT {', '.join(_COVARIATES)}, count(*) AS n, count(*) FILTER (gender = 1) AS n1,
  count(*) FILTER (gender = 0) AS n0, avg(salary) FILTER (gender = 1) AS y1, avg(salary) FILTER (gender = 0) AS y0
  FROM people GROUP BY ALL""")
def conditional_means(spark, sf):
    return agg.cells(people(spark, sf, *_COVARIATES, "gender", "salary"), _COVARIATES)


@query("mean_curve", f"""{P}, v AS (SELECT matched_title, title, seniority, avg(salary) AS mean, count(*) AS n FROM people GROUP BY ALL)
  SELECT matched_title, title AS variant, seniority, round(mean, 4) AS mean, n FROM v UNION ALL
  SELECT matched_title, 'all', seniority, round(sum(mean * n) / sum(n), 4), CAST(sum(n) AS BIGINT) FROM v GROUP BY matched_title, seniority""")
def mean_curve(spark, sf):
    p = people(spark, sf, "title", "matched_title", "seniority", "salary")
    each, pooled = agg.mean_curve(p, "title", "seniority", "salary", ["matched_title"])
    both = each.withColumnRenamed("title", "variant").unionByName(pooled.withColumn("variant", F.lit("all")))
    return both.withColumn("mean", F.round("mean", 4))


# runs: one value per user and event type, some of them not finite
_RUNS_SQL = """SELECT event_type AS model, user_id, CASE WHEN event_id % 97 = 0 THEN 'NaN'::DOUBLE
  WHEN event_id % 89 = 0 THEN 'Infinity'::DOUBLE ELSE value END AS ate FROM events"""


def _runs(spark, sf):
    ate = (F.when(F.pmod("event_id", F.lit(97)) == 0, float("nan"))
           .when(F.pmod("event_id", F.lit(89)) == 0, float("inf")).otherwise(F.col("value")))
    return table(spark, sf, "events").select(F.col("event_type").alias("model"), "user_id", ate.alias("ate"))


@query("run_summary", f"""SELECT model, round(avg(ate), 6) AS mean, round(quantile_cont(ate, 0.75), 6) AS upper,
  round(quantile_cont(ate, 0.25), 6) AS lower, count(*) AS runs FROM ({_RUNS_SQL}) WHERE isfinite(ate) GROUP BY ALL""")
def run_summary(spark, sf):
    out = agg.run_summary(_runs(spark, sf), ["model"], "ate")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "upper", "lower")})


@query("box_stats", f"""SELECT model, CAST(user_id % 4 AS INTEGER) AS tables, min(ate) AS low,
  round(quantile_cont(ate, 0.25), 6) AS q1, round(quantile_cont(ate, 0.5), 6) AS median,
  round(quantile_cont(ate, 0.75), 6) AS q3, max(ate) AS high, count(*) AS runs
  FROM ({_RUNS_SQL}) WHERE isfinite(ate) GROUP BY ALL""")
def box_stats(spark, sf):
    runs = _runs(spark, sf).withColumn("tables", F.pmod("user_id", F.lit(4)).cast("int"))
    out = agg.box_stats(runs, ["model", "tables"], "ate")
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("sorted_distinct", f"SELECT DISTINCT {Q.RAW} AS job_title FROM part ORDER BY 1")
def sorted_distinct(spark, sf):
    return titles(spark, sf).select("job_title").distinct().orderBy("job_title")


@query("top_k_frequent", f"{P} SELECT title, count(*) AS n FROM people GROUP BY ALL ORDER BY n DESC, title LIMIT 20")
def top_k_frequent(spark, sf):
    return agg.top_k_frequent(people(spark, sf, "title"), "title", 20)


@query("top_labels_per_topic", f"""{P} SELECT employer, title, n, rank FROM (SELECT employer, title, count(*) AS n,
  CAST(row_number() OVER (PARTITION BY employer ORDER BY count(*) DESC, title) AS INTEGER) AS rank
  FROM people GROUP BY employer, title) WHERE rank <= 3""")
def top_labels_per_topic(spark, sf):
    counts = people(spark, sf, "employer", "title").groupBy("employer", "title").agg(F.count("*").alias("n"))
    return agg.top_per_group(counts, ["employer"], [F.desc("n"), F.col("title")], 3)


@query("argmin_param", f"""{P}, g AS (SELECT seniority, matched_title, avg(salary) AS mean_error FROM people GROUP BY ALL)
  SELECT seniority, arg_min(matched_title, mean_error) AS matched_title, min(mean_error) AS mean_error FROM g GROUP BY ALL""")
def argmin_param(spark, sf):
    return agg.argmin_param(people(spark, sf, "seniority", "matched_title", "salary"), ["seniority"], "matched_title", "salary")


@query("first_n", "SELECT doc_id, lang FROM documents WHERE doc_id < 100")
def first_n(spark, sf):
    from motley.sources.files import row_slice
    return row_slice(table(spark, sf, "documents"), "doc_id", 0, 100).select("doc_id", "lang")


@query("union_tables", "SELECT 0 AS table_id, c_name AS name, c_acctbal AS amount FROM customer UNION ALL "
                       "SELECT 1, s_name, s_acctbal FROM supplier")
def union_tables(spark, sf):
    c = table(spark, sf, "customer").select(F.lit(0).alias("table_id"), F.col("c_name").alias("name"),
                                            F.col("c_acctbal").alias("amount"))
    s = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("amount"), F.lit(1).alias("table_id"),
                                            F.col("s_name").alias("name"))
    return c.unionByName(s)


@query("distinct_rows", f"{P} SELECT DISTINCT title, seniority, employer FROM people")
def distinct_rows(spark, sf):
    return people(spark, sf, "title", "seniority", "employer").distinct()


@query("except_values", f"{P} SELECT DISTINCT title FROM people WHERE title NOT IN (SELECT matched_title FROM people)")
def except_values(spark, sf):
    known = people(spark, sf, "matched_title").select(F.col("matched_title").alias("title")).distinct()
    return dic.anti_unseen(people(spark, sf, "title"), known, "title")


@query("anti_unseen", f"{P} SELECT DISTINCT fine_title FROM people WHERE table_id = 3 AND fine_title NOT IN "
                      "(SELECT fine_title FROM people WHERE seniority > 23)")
def anti_unseen(spark, sf):
    p = people(spark, sf, "fine_title", "table_id", "seniority")
    known = p.where("seniority > 23").select("fine_title").distinct()
    return dic.anti_unseen(p.where("table_id = 3"), known, "fine_title")


@query("semi_known", f"{P} SELECT row_id, title FROM people WHERE title IN (SELECT matched_title FROM titles)")
def semi_known(spark, sf):
    known = titles(spark, sf).select(F.col("matched_title").alias("title"))
    return dic.semi_known(people(spark, sf, "row_id", "title"), known, "title").select("row_id", "title")


@query("intersect_grams", f"""SELECT p_partkey, unnest(list_intersect(a, b)) AS gram FROM (SELECT p_partkey,
  list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3)) AS a,
  list_transform(range(1, length(y) - 1), lambda i: substr(y, i, 3)) AS b FROM (
  SELECT p_partkey, ' ' || lower({Q.RAW}) || ' ' AS x, ' ' || p_name || ' ' AS y FROM part))""")
def intersect_grams(spark, sf):
    t = titles(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")
    return t.select("p_partkey", F.explode(F.array_intersect(
        ngram_set(F.col("job_title"), 3), ngram_set(F.col("p_name"), 3))).alias("gram"))


@query("delete_rows", f"""SELECT o_orderkey FROM orders WHERE {hashing.mixed_hash_sql('o_orderkey', 5)} >= 300000""")
def delete_rows(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    drawn = orders.where(hashing.mixed_hash(F.col("o_orderkey"), 5) < 300000)
    return sampling.delete_rows(orders, drawn, ["o_orderkey"])


@query("dict_encode_join", f"{P}, d AS (SELECT title, row_number() OVER (ORDER BY title) AS id FROM (SELECT DISTINCT title FROM people)) "
                           "SELECT row_id, title, id FROM people JOIN d USING (title)")
def dict_encode_join(spark, sf):
    return dic.dict_encode_join(people(spark, sf, "row_id", "title"), "title", order="value").select("row_id", "title", "id")


@query("ordinal_encode", "WITH d AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM "
                         "(SELECT DISTINCT c_mktsegment FROM customer)) SELECT c_custkey, code FROM customer JOIN d USING (c_mktsegment)")
def ordinal_encode(spark, sf):
    return dic.ordinal_encode(table(spark, sf, "customer"), "c_mktsegment").select("c_custkey", "code")


@query("label_titles", f"""{P}, r AS (SELECT title, matched_title, count(*) AS n FROM people GROUP BY ALL)
  SELECT title, matched_title, n, true AS one_id, true AS raw_dense, true AS matched_dense FROM r""")
def label_titles(spark, sf):
    """Random positive integer per raw and per matched title; checked to be one per title and without gaps."""
    p = people(spark, sf, "row_id", "title", "matched_title")
    raw = dic.dict_encode_join(p, "title", "raw_id", order="hash", seed=3)
    rows = dic.dict_encode_join(raw, "matched_title", "matched_id", order="hash", seed=4)

    def dense(column, of):
        ends = (F.min(column) == 1) & (F.max(column) == F.count_distinct(of)) & (F.max(column) == F.count_distinct(column))
        return rows.agg(ends.alias("dense")).scalar()

    same = (F.min("raw_id") == F.max("raw_id")) & (F.min("matched_id") == F.max("matched_id"))
    return rows.groupBy("title", "matched_title").agg(F.count("*").alias("n"), same.alias("one_id")).withColumns(
        {"raw_dense": dense("raw_id", "title"), "matched_dense": dense("matched_id", "matched_title")})


@query("canonicalize_by_vector", f"""SELECT p_partkey, title, max(title) OVER (PARTITION BY list_sort(string_split(title, ' ')))
  AS canonical FROM (SELECT p_partkey, {Q.clean(Q.RAW)} AS title FROM part)""")
def canonicalize_by_vector(spark, sf):
    return dic.canonicalize_by_words(titles(spark, sf).select("p_partkey", "title"), "title").select(
        "p_partkey", "title", "canonical")

"""Sources, projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql as Q
from catalog.registry import query
from motley.functions import hashing, text, vectors
from motley.sources import files, ingest
from motley.sources.people import people, table, titles, word_vectors
from motley.sources.specs import EMPLOYER_TYPES, ETHNICITY_CODES, catalog_specs
from motley.workdir import fresh_path, materialize

SUPPLIER = "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE"


@query("scan_csv", "SELECT * FROM supplier")
def scan_csv(spark, sf):
    path = fresh_path(spark, "csv")
    files.write_delimited(table(spark, sf, "supplier"), path)
    return files.read_delimited(spark, path, schema=SUPPLIER)


@query("scan_csv_latin1", "SELECT p_partkey, upper(p_name) || ' é' AS title FROM part")
def scan_csv_latin1(spark, sf):
    path = fresh_path(spark, "latin1")
    accented = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.upper("p_name"), F.lit(" é")).alias("title"))
    files.write_delimited(accented, path, encoding="ISO-8859-1")
    return files.read_delimited(spark, path, encoding="ISO-8859-1", schema="p_partkey BIGINT, title STRING")


@query("scan_tsv", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey >= 10 AND c_custkey < 110")
def scan_tsv(spark, sf):
    path = fresh_path(spark, "tsv")
    files.write_delimited(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, sep="\t")
    whole = files.read_delimited(spark, path, sep="\t", schema="c_custkey BIGINT, c_name STRING, c_mktsegment STRING")
    return files.row_slice(whole, "c_custkey", 10, 100)


@query("scan_multi_file", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def scan_multi_file(spark, sf):
    paths = {n: fresh_path(spark, n) for n in ("nation", "region")}
    for name, path in paths.items():
        files.write_delimited(table(spark, sf, name), path)
    found = files.read_many(spark, paths, "nation")
    return found["nation"].join(found["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("int"), "n_name", "r_name")


@query("recode_files", "SELECT s_suppkey, s_name || ' ü' AS s_name FROM supplier")
def recode_files(spark, sf):
    raw, utf = fresh_path(spark, "raw"), fresh_path(spark, "utf8")
    files.write_delimited(
        table(spark, sf, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" ü")).alias("s_name")),
        raw, encoding="ISO-8859-1")
    files.recode_files(spark, raw, utf, "ISO-8859-1")
    return files.read_delimited(spark, utf, schema="s_suppkey BIGINT, s_name STRING")


def raw_sources(spark, sf, folder):
    """Write the people as the raw files of the catalogued sources."""
    df = materialize(
        people(spark, sf, "table_id", "salary", "job_title", "seniority", "gender", "ethnicity"), "people")
    for i, spec in enumerate(catalog_specs()):
        year = (F.lit(2019) - F.col("seniority")).cast("string")
        money = F.col("salary").cast("decimal(12,2)").cast("string")
        columns = {
            spec.salary: money if spec.numeric_salary else F.replace(money, F.lit("."), F.lit(",")),
            spec.title: F.col("job_title"),
            spec.hired: F.concat(F.lit("01/02/"), year, F.lit(" 00:00" if spec.layout == "at6" else "")),
            spec.gender: F.when(F.col("gender") == 1, spec.male).otherwise("other"),
            spec.ethnicity: F.col("ethnicity"),
        }
        if spec.hours:
            columns[spec.hours] = F.lit("2080")
        if spec.full_time:
            columns[spec.full_time[0]] = F.when(F.col("seniority") == 20, "part").otherwise(spec.full_time[1])
        files.write_delimited(
            df.where(F.col("table_id") == i).select(*[c.alias(k) for k, c in columns.items()]),
            f"{folder}/{spec.name}.csv", encoding=spec.encoding)


@query("load_catalog", f"""WITH {Q.PEOPLE} SELECT table_id, title AS job_title, seniority, gender, ethnicity,
  count(*) AS n, CAST(sum(salary) AS DOUBLE) AS total FROM people
  WHERE seniority <> 20 OR table_id IN (5, 6) GROUP BY ALL""")
def load_catalog(spark, sf):
    folder = fresh_path(spark, "catalog")
    raw_sources(spark, sf, folder)
    return ingest.load_catalog(spark, folder).groupBy(
        "table_id", "job_title", "seniority", "gender", "ethnicity").agg(
        F.count("*").alias("n"), F.sum("salary").alias("total"))


@query("sink_merged_csv", f"""WITH {Q.PEOPLE} SELECT title AS "Job Title", seniority AS "Seniority", gender AS "Gender",
  ethnicity AS "Ethnicity", salary AS "Annual Salary", table_id AS "Database_ID" FROM people""")
def sink_merged_csv(spark, sf):
    path = fresh_path(spark, "merged")
    ingest.sink_merged_csv(
        people(spark, sf, "title", "seniority", "gender", "ethnicity", "salary", "table_id")
        .withColumnRenamed("title", "job_title"), path)
    return files.read_delimited(
        spark, path, schema="`Job Title` STRING, Seniority INT, Gender INT, Ethnicity STRING, "
                            "`Annual Salary` DOUBLE, Database_ID INT")


@query("sink_results", f"""WITH {Q.PEOPLE} SELECT 'salary' AS task, employer AS model, row_id, salary AS error
  FROM people""")
def sink_results(spark, sf):
    path = fresh_path(spark, "results")
    rows = people(spark, sf, "row_id", "salary", "employer").select(
        F.lit("salary").alias("task"), F.col("employer").alias("model"), "row_id", F.col("salary").alias("error"))
    files.write_results(rows, path, ["task", "model"])
    return spark.read.parquet(path)


@query("merge_result_chunks", "SELECT event_type AS model, event_id AS run, value AS ate FROM events")
def merge_result_chunks(spark, sf):
    path = fresh_path(spark, "chunks")
    runs = table(spark, sf, "events").select(
        F.col("event_type").alias("model"), F.col("event_id").alias("run"), F.col("value").alias("ate"))
    for k in range(3):
        files.write_results(runs.where(F.pmod("run", F.lit(3)) == k), path, ["model"])
    return files.merge_result_chunks(spark, path).select("model", "run", "ate")


@query("standardize_columns", """SELECT p_partkey AS "key", p_name AS job_title, p_retailprice AS salary FROM part""")
def standardize_columns(spark, sf):
    return ingest.standardize_columns(
        table(spark, sf, "part"), {"key": "p_partkey", "job_title": "p_name", "salary": "p_retailprice"})


@query("drop_null_rows", "SELECT event_id, CASE WHEN value < 5 THEN NULL ELSE event_type END AS kind FROM events "
                         "WHERE value >= 5")
def drop_null_rows(spark, sf):
    holes = table(spark, sf, "events").select(
        "event_id", F.when(F.col("value") >= 5, F.col("event_type")).alias("kind"))
    return ingest.drop_null_rows(holes, ["event_id", "kind"])


@query("filter_equals", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def filter_equals(spark, sf):
    return ingest.filter_equals(table(spark, sf, "events"), "event_type", "purchase").select("event_id", "user_id")


@query("filter_isin", "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click')")
def filter_isin(spark, sf):
    return ingest.filter_isin(table(spark, sf, "events"), "event_type", ["view", "click"]).select(
        "event_id", "event_type")


@query("clean_title", f"SELECT p_partkey, {Q.clean(Q.RAW)} AS title FROM part")
def clean_title(spark, sf):
    return titles(spark, sf).select("p_partkey", text.clean_title(F.col("job_title")).alias("title"))


@query("clean_matched_title",
       f"""SELECT p_partkey, regexp_replace({Q.clean("'(' || p_name || ')  '")}, '^\\s|\\s$', '', 'g') AS title FROM part""")
def clean_matched_title(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.clean_matched_title(
        F.concat(F.lit("("), F.col("p_name"), F.lit(")  "))).alias("title"))


@query("split_camel", r"""SELECT doc_id, length(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g')) AS n,
  md5(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g')) AS digest FROM documents""")
def split_camel(spark, sf):
    split = text.split_camel(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.length(split).cast("bigint").alias("n"), F.md5(split).alias("digest"))


_RULES = dict(text.ABBREVIATIONS, hcpc="", i=text.ROMAN_ONE)
_RULES_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _RULES.items()) + "}"
_ABBREV = "list_extract(['Sr ', 'Asst. ', 'vp,', 'HCPC ', '12 mgmt/'], CAST(p_partkey % 5 AS INTEGER) + 1) || p_name || ' I'"


@query("expand_abbrev", rf"""SELECT p_partkey, array_to_string(list_transform(
  regexp_extract_all(regexp_replace({_ABBREV}, '[0-9]+', '', 'g'), '\w+|\W+'),
  lambda w: coalesce({_RULES_SQL}[lower(w)], w)), '') AS title FROM part""")
def expand_abbrev(spark, sf):
    heads = F.array(*[F.lit(x) for x in ("Sr ", "Asst. ", "vp,", "HCPC ", "12 mgmt/")])
    raw = F.concat(F.get(heads, F.pmod("p_partkey", F.lit(5)).cast("int")), F.col("p_name"), F.lit(" I"))
    return table(spark, sf, "part").select("p_partkey", text.expand_abbrev(raw).alias("title"))


@query("decimal_comma", "SELECT c_custkey, c_acctbal AS amount FROM customer")
def decimal_comma(spark, sf):
    written = F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(","))
    return table(spark, sf, "customer").select("c_custkey", text.decimal_comma(written).alias("amount"))


@query("money_strip", "SELECT c_custkey, c_acctbal AS amount FROM customer")
def money_strip(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", text.money_strip(F.concat(F.lit("$"), F.col("c_acctbal").cast("string"))).alias("amount"))


@query("hourly_to_annual", "SELECT event_id, CASE WHEN value < 50 THEN value * 2080 ELSE value END AS salary FROM events")
def hourly_to_annual(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", text.hourly_to_annual(F.col("value"), F.lit(2080), 50).alias("salary"))


@query("seniority_from_date", """SELECT o_orderkey, CAST(2019 - year(o_orderdate) AS INTEGER) AS tail,
  CAST(2019 - year(o_orderdate) AS INTEGER) AS last4, CAST(2019 - year(o_orderdate) AS INTEGER) AS at6,
  CAST((19 - year(o_orderdate) % 100 + 100) % 100 AS INTEGER) AS two_digit FROM orders""")
def seniority_from_date(spark, sf):
    day = F.date_format("o_orderdate", "MM/dd/yyyy")
    as_of = lambda c, layout: text.seniority_from_date(c, layout).alias(layout)
    return table(spark, sf, "orders").select(
        "o_orderkey", as_of(day, "tail"), as_of(F.date_format("o_orderdate", "d MMM yyyy"), "last4"),
        as_of(F.concat(day, F.lit(" 08:30")), "at6"), as_of(F.date_format("o_orderdate", "dd-MM-yy"), "two_digit"))


@query("year_of_date", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS hired FROM orders")
def year_of_date(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", text.year_of_date(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("hired"))


@query("binarize", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS gender FROM orders")
def binarize(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.binarize(F.col("o_orderstatus"), "F").alias("gender"))


_SPELLINGS = list(ETHNICITY_CODES)


@query("recode_map", f"""SELECT c_custkey, list_extract({_SPELLINGS!r}, CAST(c_custkey % {len(_SPELLINGS)} AS INTEGER) + 1)
  AS ethnicity, CAST(list_extract({list(ETHNICITY_CODES.values())!r}, CAST(c_custkey % {len(_SPELLINGS)} AS INTEGER) + 1)
  AS INTEGER) AS code FROM customer""")
def recode_map(spark, sf):
    spelling = F.get(F.array(*[F.lit(s) for s in _SPELLINGS]),
                     F.pmod("c_custkey", F.lit(len(_SPELLINGS))).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", spelling.alias("ethnicity")).withColumn(
        "code", ingest.ethnicity_code(F.col("ethnicity")))


def _employer_type():
    return F.get(F.array(*[F.lit(k) for k in EMPLOYER_TYPES]), F.pmod("s_nationkey", F.lit(4)).cast("int"))


@query("entity_one_hot", "SELECT s_suppkey, " + ", ".join(
    f"CAST(s_nationkey % 4 = {i} AS INTEGER) AS is_{k}" for i, k in enumerate(EMPLOYER_TYPES)) + " FROM supplier")
def entity_one_hot(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", *ingest.entity_one_hot(_employer_type()))


@query("one_hot_to_code", "SELECT s_suppkey, CAST(s_nationkey % 4 + 1 AS INTEGER) AS code FROM supplier")
def one_hot_to_code(spark, sf):
    return table(spark, sf, "supplier").select(
        "s_suppkey", ingest.one_hot_to_code(ingest.entity_one_hot(_employer_type())).alias("code"))


@query("row_shuffle", f"SELECT o_orderkey, {hashing.mixed_hash_sql('o_orderkey', 42)} AS place FROM orders")
def row_shuffle(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", hashing.mixed_hash(F.col("o_orderkey"), 42).alias("place")).orderBy("place", "o_orderkey")


@query("hstack_features", """SELECT vec_id, CAST(len(f) AS INTEGER) AS width, round(list_sum(f), 6) AS total, f[1] AS first, f[len(f)] AS last FROM (
  SELECT vec_id, list_concat(CAST(embedding AS DOUBLE[]), [CAST(label AS DOUBLE), CAST(vec_id AS DOUBLE)]) AS f FROM embeddings)""")
def hstack_features(spark, sf):
    stacked = vectors.hstack(F.col("embedding").cast("array<double>"), vectors.scalar_block(F.col("label")),
                             vectors.scalar_block(F.col("vec_id")))
    return table(spark, sf, "embeddings").select("vec_id", stacked.alias("f")).select(
        "vec_id", F.size("f").alias("width"),
        F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.element_at("f", 1).alias("first"), F.element_at("f", -1).alias("last"))


@query("l2_normalize", """SELECT vec_id, i, round(x / sqrt(s), 6) AS x FROM (
  SELECT vec_id, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x, list_inner_product(v, v) AS s
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))""")
def l2_normalize(spark, sf):
    unit = vectors.l2_normalize(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(unit).alias("i", "x")).select(
        "vec_id", (F.col("i") + 1).cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@query("cast_float32", "SELECT event_id, CAST(CAST(value / 3 AS FLOAT) AS DOUBLE) AS x FROM events")
def cast_float32(spark, sf):
    encoded = vectors.cast_float32(F.array(F.col("value") / 3))
    return table(spark, sf, "events").select("event_id", F.element_at(encoded, 1).cast("double").alias("x"))

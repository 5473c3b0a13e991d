"""The canonical employee table, derived from a star schema.

The order lines play the employees: a part name, spelled in five ways, is the
job title, the supplier's nation names the source table and the order status
the sex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motley.functions.text import clean_title
from motley.functions.vectors import l2_normalize

N_TABLES = 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _word(i: int) -> Column:
    return F.element_at(F.split("p_name", " "), i)


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part with the spellings of its title."""
    variant = F.pmod("p_partkey", F.lit(5))
    raw = (
        F.when(variant == 0, F.col("p_name"))
        .when(variant == 1, F.upper("p_name"))
        .when(variant == 2, F.concat_ws(" ", _word(2), _word(1)))
        .when(variant == 3, F.concat(F.lit("9109 "), F.col("p_name")))
        .otherwise(F.concat_ws(", ", _word(1), _word(2)))
    )
    brand = F.replace(F.lower("p_brand"), F.lit("#"), F.lit(""))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        raw.alias("job_title"),
        clean_title(raw).alias("title"),
        F.concat_ws(" ", F.least(_word(1), _word(2)), F.greatest(_word(1), _word(2))).alias("matched_title"),
        F.concat_ws(" ", "p_name", brand).alias("fine_title"),
    )


TITLE_COLUMNS = {"job_title", "title", "matched_title", "fine_title"}


def people(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Canonical rows with the asked columns; only the joins they need are made.

    Every key of ``lineitem`` is present in its parent table, so leaving a
    parent out does not change the rows.
    """
    want = set(columns)
    df = table(spark, sf_dir, "lineitem").withColumns({
        # order and line number do not name a line alone; part and price complete the key
        "row_id": (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.pmod(
            F.round(F.col("l_extendedprice") * 100).cast("bigint") + F.col("l_partkey") * 7919, F.lit(1000000)),
        "salary": F.round("l_extendedprice"),
        "employer": F.col("l_returnflag"),
    })
    if want & TITLE_COLUMNS:
        df = df.join(titles(spark, sf_dir), df.l_partkey == F.col("p_partkey"))
    if "table_id" in want:
        supplier = table(spark, sf_dir, "supplier").select(
            "s_suppkey", F.pmod("s_nationkey", F.lit(N_TABLES)).alias("table_id"))
        df = df.join(supplier, df.l_suppkey == F.col("s_suppkey"))
    if want & {"seniority", "gender", "ethnicity"}:
        orders = table(spark, sf_dir, "orders").select(
            "o_orderkey", "o_custkey",
            (F.lit(2019) - F.year("o_orderdate")).alias("seniority"),
            (F.col("o_orderstatus") == "F").cast("int").alias("gender"),
        )
        if "ethnicity" in want:
            customer = table(spark, sf_dir, "customer").select(
                "c_custkey", F.col("c_mktsegment").alias("ethnicity"))
            orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        df = df.join(orders, df.l_orderkey == F.col("o_orderkey"))
    return df.select(*columns)


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, vector): each word of a title takes one of the given vectors.

    The word's smallest part key, modulo the number of vectors, picks it.
    """
    vectors = table(spark, sf_dir, "embeddings")
    n_vectors = vectors.count()
    spelled = titles(spark, sf_dir).select("p_partkey", F.explode(F.array_union(
        F.split("title", " "), F.split("fine_title", " "))).alias("word"))
    words = spelled.groupBy("word").agg(F.pmod(F.min("p_partkey"), F.lit(n_vectors)).alias("vec_id"))
    return words.join(vectors, "vec_id").select("word", l2_normalize(F.col("embedding")).alias("vector"))

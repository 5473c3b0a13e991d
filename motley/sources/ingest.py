"""From raw source tables to the canonical employee row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motley.functions import text
from motley.sources.files import read_delimited, write_delimited
from motley.sources.specs import EMPLOYER_TYPES, ETHNICITY_CODES, SourceSpec, catalog_specs


def drop_null_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def filter_equals(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def filter_isin(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isin(values))


def standardize_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Select the raw columns under their canonical names."""
    return df.select(*[F.col(f"`{raw}`").alias(name) for name, raw in mapping.items()])


def recode_map(c: Column, codes: dict[str, int], on_unmapped: str = "error") -> Column:
    """Code of a value; unmapped values raise, stay null or become -1."""
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    code = F.try_element_at(table, c)
    if on_unmapped == "null":
        return code
    if on_unmapped == "unknown":
        return F.coalesce(code, F.lit(-1))
    stop = F.raise_error(F.concat(F.lit("no code for value: "), c)).cast("int")
    return F.when(c.isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(code, stop))


def ethnicity_code(c: Column, on_unmapped: str = "error") -> Column:
    return recode_map(c, ETHNICITY_CODES, on_unmapped)


def entity_one_hot(employer: Column) -> list[Column]:
    return [(employer == k).cast("int").alias(f"is_{k}") for k in EMPLOYER_TYPES]


def one_hot_to_code(flags: list[Column]) -> Column:
    return sum(f * (i + 1) for i, f in enumerate(flags))


def clean_source(raw: DataFrame, spec: SourceSpec, table_id: int, clean: bool = True) -> DataFrame:
    """One raw table (all strings) as canonical rows.

    Rows with a null in any mapped column go first, then part-time rows; the
    remaining columns are cast to their canonical types.
    """
    df = drop_null_rows(raw, [f"`{c}`" for c in spec.columns().values()])
    if spec.full_time is not None:
        df = filter_equals(df, f"`{spec.full_time[0]}`", spec.full_time[1])
    df = standardize_columns(df, spec.columns())
    if spec.drop_salary is not None:
        df = df.where(F.col("salary") != spec.drop_salary)
    salary = F.col("salary").cast("double") if spec.numeric_salary else text.decimal_comma(F.col("salary"))
    if spec.hours is not None:
        salary = text.hourly_to_annual(salary, F.col("hours").cast("double"))
    title = text.clean_title(F.col("job_title")) if clean else F.col("job_title")
    ethnicity = F.col("ethnicity") if spec.ethnicity else F.lit(None).cast("string")
    return df.select(
        F.lit(table_id).alias("table_id"),
        salary.alias("salary"),
        title.alias("job_title"),
        text.seniority_from_date(F.col("hired"), spec.layout).alias("seniority"),
        text.binarize(F.col("gender"), spec.male).alias("gender"),
        ethnicity.alias("ethnicity"),
        F.lit(spec.employer).alias("employer"),
    )


def load_catalog(
    spark: SparkSession, folder: str, exclude: list[str] | None = None, clean: bool = True
) -> DataFrame:
    """All catalogued sources below ``folder`` as one canonical table."""
    parts = [
        clean_source(read_delimited(spark, f"{folder}/{s.name}.csv", encoding=s.encoding), s, i, clean)
        for i, s in enumerate(catalog_specs(exclude))
    ]
    return reduce(DataFrame.unionByName, parts)


def sink_merged_csv(df: DataFrame, path: str) -> None:
    """The merged table under its published column names."""
    write_delimited(
        df.select(
            F.col("job_title").alias("Job Title"), F.col("seniority").alias("Seniority"),
            F.col("gender").alias("Gender"), F.col("ethnicity").alias("Ethnicity"),
            F.col("salary").alias("Annual Salary"), F.col("table_id").alias("Database_ID"),
        ),
        path,
    )

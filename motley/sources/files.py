"""Readers and writers for delimited files and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_delimited(
    spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "UTF-8",
    schema: StructType | str | None = None, header: bool = True,
) -> DataFrame:
    """Delimited text as a DataFrame; without a schema every column is a string.

    Blanks are kept and quotes are doubled inside quoted fields.
    """
    reader = (
        spark.read.option("header", header).option("sep", sep).option("encoding", encoding)
        .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_many(spark: SparkSession, paths: dict[str, str], main: str, **options) -> dict[str, DataFrame]:
    """A data set of several files: the main file under ``main``, others by name."""
    if main not in paths:
        raise ValueError(f"main file {main!r} is not among {sorted(paths)}")
    return {name: read_delimited(spark, p, **options) for name, p in paths.items()}


def write_delimited(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8", mode: str = "errorifexists"):
    (df.write.mode(mode).option("header", True).option("sep", sep).option("encoding", encoding)
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def recode_files(spark: SparkSession, path: str, target: str, encoding: str, sep: str = ",") -> None:
    """Read files in their own encoding and write them again in UTF-8."""
    write_delimited(read_delimited(spark, path, sep, encoding), target, sep, "UTF-8")


def row_slice(df: DataFrame, row_id: str, start: int, rows: int) -> DataFrame:
    """Rows start .. start+rows-1 of a stable row number."""
    return df.where((F.col(row_id) >= start) & (F.col(row_id) < start + rows))


def write_results(df: DataFrame, path: str, by: list[str], mode: str = "append") -> None:
    """Result rows as Parquet, one folder per task and model."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def merge_result_chunks(spark: SparkSession, path: str) -> DataFrame:
    """All result chunks below a folder as one table."""
    return spark.read.option("recursiveFileLookup", False).parquet(path)

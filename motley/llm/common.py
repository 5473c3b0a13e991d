"""Column pieces the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motley.workdir import fresh_path, remove

# The characters that separate words, as a Java class body and as a plain string.
BLANK_CLASS = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often it is used.

    A lambda variable cannot be inlined by the optimizer, so a second use does not repeat the
    work. A filter on the result that is pushed down does, as it repeats the whole expression:
    an inner ``explode`` of it makes such a filter, ``explode_outer`` does not.
    """
    return F.transform(F.array(value), body)[0]


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters that are not blanks, in order."""
    return F.filter(F.split(text, f"[{BLANK_CLASS}]+"), lambda w: w != "")


def has_word(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS)) != ""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def temporary(columns: list[str], name: str) -> str:
    """A column name that none of ``columns`` has, compared without case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Tables:
    """Written tables that go when the last one that needs them is written."""

    def __init__(self, spark: SparkSession, of: str):
        self.spark, self.of, self.paths = spark, of, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = fresh_path(self.spark, f"{self.of}-{name}")
        df.write.parquet(self.paths[name])
        return self.spark.read.schema(df.schema).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.paths.pop(name))

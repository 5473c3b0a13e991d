"""From raw documents to packed training sequences, stage by stage.

Every stage works on all rows its predecessor kept and is written as Parquet before the next
one reads it, so a lost executor repeats parts of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motley.llm import fuzzy_lines, packing, quality_model, quality_rules, simhash
from motley.llm.common import has_word, table, temporary
from motley.workdir import fresh_path, remove


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier accepts."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass every quality rule."""
    return quality_rules.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that repeat an earlier one; ``n_chars`` follows the text.

    A document all of whose words stood in such lines is a copy and goes; one that had no
    word before stays.
    """
    removed = temporary(docs.columns, "_removed")
    cut = fuzzy_lines.drop_repeats(docs, removed_col=removed, short=True)
    cut = cut.where((F.col(removed) == 0) | has_word(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col(removed) == 0, F.col("n_chars"))
                             .otherwise(F.length("text")).cast(kind))
    return cut.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose fingerprints of three-word shingles lie within three bits."""
    return simhash.keep_first(docs, size=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every document, one token per UTF-8 byte, in the training sequences."""
    return packing.pack(docs, F.octet_length("text"))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_documents),
    ("best-fit packing", pack),
]
# SQL has no word hashes of this kind and no best-fit; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        if old:
            remove(spark, old)
        docs, old = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)

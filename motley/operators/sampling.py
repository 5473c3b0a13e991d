"""Folds, splits and exact samples, all chosen by hash or given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motley.functions.hashing import seeded
from motley.operators.joins import join_groups


def delete_rows(df: DataFrame, drawn: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` that were not drawn."""
    return join_groups(df, drawn.select(*keys), keys, "left_anti")


def group_shuffle_split(groups: list[int], n_splits: int, n_test: int, seed: int = 42) -> list[list[int]]:
    """Whole tables held out at random: the test tables of every split."""
    rng = np.random.RandomState(seed)
    return [sorted(int(g) for g in rng.permutation(groups)[:n_test]) for _ in range(n_splits)]


def leave_one_group_out(groups: list[int]) -> list[list[int]]:
    return [[int(g)] for g in sorted(groups)]


def split_table(spark: SparkSession, groups: list[int], tests: list[list[int]]) -> DataFrame:
    """(split_id, table_id, is_test): folds as a small table to join with."""
    rows = [(s, int(g), int(g in set(test))) for s, test in enumerate(tests) for g in groups]
    return spark.createDataFrame(rows, "split_id INT, table_id INT, is_test INT")


def kfold(df: DataFrame, row_id: str, k: int, seed: int = 0, name: str = "fold", hashed: Column | None = None) -> DataFrame:
    """Fold number of every row by hash of its id."""
    h = seeded(F.col(row_id), seed) if hashed is None else hashed
    return df.withColumn(name, F.pmod(h, F.lit(k)).cast("int"))


# Rows are ranked inside hash buckets of a stratum, never inside a whole stratum:
# the highest bits of a 64-bit hash name one of 4096 buckets, in the order of the hash.
_SHIFT = 52


def _place(row_id: str, hashed: Column | None) -> Column:
    return seeded(F.col(row_id)) if hashed is None else hashed


def stratum_rank(df: DataFrame, strata: list[str], row_id: str, hashed: Column | None = None) -> DataFrame:
    """Add ``_rank`` (1, 2, ...) in hash order inside each stratum, and ``_size``.

    The hash range is cut into buckets; a running total of bucket sizes gives
    the rank before each bucket, so a window only ever holds one bucket.  A hash
    given instead of the default should fill 64 bits.
    """
    tagged = df.withColumn("_h", _place(row_id, hashed)).withColumn("_bucket", F.shiftright("_h", _SHIFT))
    sizes = tagged.groupBy(*strata, "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select(
        *strata, "_bucket",
        (F.sum("_n").over(Window.partitionBy(*strata).orderBy("_bucket")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*strata)).alias("_size"),
    )
    inside = Window.partitionBy(*strata, "_bucket").orderBy("_h", row_id)
    return (
        join_groups(tagged.withColumn("_pos", F.row_number().over(inside)), before, [*strata, "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_pos"))
        .drop("_h", "_bucket", "_pos", "_before")
    )


def stratified_kfold(df: DataFrame, row_id: str, label: str, k: int, hashed: Column | None = None,
                     name: str = "fold") -> DataFrame:
    """Folds whose sizes differ by at most one row within each label."""
    ranked = stratum_rank(df, [label], row_id, hashed)
    return ranked.withColumn(name, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank", "_size")


def stratum_cuts(df: DataFrame, strata: list[str], row_id: str, share: Column,
                 hashed: Column | None = None) -> DataFrame:
    """(strata, cut): the last (hash, row id) among the first ``int(size * share)`` rows.

    A histogram of the hash tells which bucket holds the cut; only the rows of
    that bucket are ranked.  Strata that lose no row are absent.  There are few strata:
    the buckets, one per stratum, go to all tasks, so that no task gets a whole stratum.
    """
    tagged = df.select(*strata, F.col(row_id).alias("_id"), _place(row_id, hashed).alias("_h")).withColumn(
        "_bucket", F.shiftright("_h", _SHIFT))
    sizes = tagged.groupBy(*strata, "_bucket").agg(F.count("*").alias("_n"))
    # at most 4096 rows per stratum
    stratum = Window.partitionBy(*strata)
    placed = sizes.withColumns({
        "_upto": F.sum("_n").over(stratum.orderBy("_bucket")), "_size": F.sum("_n").over(stratum)})
    need = F.floor(F.col("_size") * share)
    holds = placed.where((F.col("_upto") >= need) & (F.col("_upto") - F.col("_n") < need)).select(
        *strata, "_bucket", (need - F.col("_upto") + F.col("_n")).alias("_need"))
    inside = Window.partitionBy(*strata, "_bucket").orderBy("_h", "_id")
    return (
        join_groups(tagged, F.broadcast(holds), [*strata, "_bucket"]).withColumn("_pos", F.row_number().over(inside))
        .where(F.col("_pos") == F.col("_need")).select(*strata, F.struct("_h", "_id").alias("_cut"))
    )


def stratified_downsample(df: DataFrame, strata: list[str], row_id: str, rate: Column,
                          hashed: Column | None = None) -> DataFrame:
    """Drop exactly ``int(size * rate)`` rows of each stratum, chosen by hash.

    ``rate`` may use the stratum columns.  Rows are kept or dropped by
    comparing them with the cut of their stratum, which all tasks get; they are not shuffled.
    """
    cuts = stratum_cuts(df, strata, row_id, rate, hashed)
    own = F.struct(_place(row_id, hashed).alias("_h"), F.col(row_id).alias("_id"))
    return join_groups(df, F.broadcast(cuts), strata, "left").where(F.col("_cut").isNull() | (own > F.col("_cut"))).drop("_cut")

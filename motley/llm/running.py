"""Running sums within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motley.workdir import materialize


def running_sums(df: DataFrame, group: list[str], order: list[str], measures: dict[str, str]) -> DataFrame:
    """``df`` with the exclusive running sum of each measure, as the column it maps to.

    Rows are range-partitioned by group and order, so a large group lies in many partitions.
    Each (group, partition) cell is summed; the offsets of cells and the sums within cells
    come from two windows, the first over one row per cell, the second over the rows of one
    cell. Ties of the order are broken by position; null groups and orders sort first.
    """
    tie, cell = "_tie", "_cell"
    spread = df.withColumn(tie, F.monotonically_increasing_id())
    placed = materialize(spread.repartitionByRange(*group, *order, tie).withColumn(cell, F.spark_partition_id()), "cells")
    sums = placed.groupBy(*group, cell).agg(*(F.sum(m).alias(m) for m in measures))
    cells = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col(cell).alias("_c"),
                       *(F.coalesce(F.sum(m).over(cells), F.lit(0)).alias(f"_b{i}") for i, m in enumerate(measures)))
    rows = Window.partitionBy(*group, cell).orderBy(*order, tie).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("*", *(F.coalesce(F.sum(m).over(rows), F.lit(0)).alias(f"_l{i}") for i, m in enumerate(measures)))
    same = F.col(cell) == F.col("_c")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return local.join(base, same).select(
        *df.columns, *((F.col(f"_b{i}") + F.col(f"_l{i}")).alias(name) for i, name in enumerate(measures.values())))

"""Estimates of the salary gap across sex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motley.operators.aggregates import cells as covariate_cells
from motley.operators.joins import join_groups
from motley.operators.lookups import fuzzy_band_join, fuzzy_opposite_join
from motley.workdir import materialize

COVARIATES = ["title", "seniority", "employer", "ethnicity"]


def gap_of_cells(cells: DataFrame, dismiss: bool = True, by: list[str] | None = None) -> DataFrame:
    """Exact-matching gap from a table of covariate cells.

    ``dismiss=True`` leaves out cells with known outcomes of one sex only,
    otherwise the missing side counts as 0.  ``share_kept`` is the share of rows in the kept cells.
    """
    by = by or []
    both = F.col("y1").isNotNull() & F.col("y0").isNotNull()
    kept = both if dismiss else F.lit(True)
    diff = (F.coalesce("y1", F.lit(0.0)) - F.coalesce("y0", F.lit(0.0))) * F.col("n")
    n_kept = F.sum(F.when(kept, F.col("n")).otherwise(0))
    return cells.groupBy(*by).agg(
        F.try_divide(F.sum(F.when(kept, diff)), n_kept).alias("ate"),
        F.sum("n").alias("n_rows"),
        (F.sum(F.when(both, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_kept"),
    )


def exact_matching_gap(df: DataFrame, covariates: list[str] | None = None, dismiss: bool = True,
                       by: list[str] | None = None) -> DataFrame:
    by = by or []
    return gap_of_cells(covariate_cells(df, [*by, *(covariates or COVARIATES)]), dismiss, by)


def fuzzy_aipw(df: DataFrame, similar: DataFrame, threshold: float = 0.8, by: list[str] | None = None) -> DataFrame:
    """Doubly robust gap with kernel-smoothed propensity and outcomes."""
    by = by or []
    return fuzzy_aipw_of_cells(covariate_cells(df, [*by, *COVARIATES]), similar, threshold, by)


def fuzzy_aipw_of_cells(table: DataFrame, similar: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """The same from covariate cells.

    The row-wise formula only needs sizes and mean outcomes of a cell.  Where
    all neighbours have one sex the estimate is the one-sided weighting one.
    """
    table = materialize(table, "cells")
    smooth = fuzzy_band_join(table, similar, threshold, exact=("employer", "ethnicity", *by))
    n, n1, n0 = F.col("n"), F.col("n1"), F.col("n0")
    y1, y0 = F.coalesce("y1", F.lit(0.0)), F.coalesce("y0", F.lit(0.0))
    e = F.col("propensity")
    # rows without a known outcome stand for the known ones of their cell and sex; without any they move nothing
    men = F.when(F.col("y1").isNull(), 0.0).otherwise(F.try_divide(n1 * (y1 - F.col("mu1")), e))
    women = F.when(F.col("y0").isNull(), 0.0).otherwise(F.try_divide(n0 * (y0 - F.col("mu0")), 1 - e))
    robust = (men - women) / n + F.col("mu1") - F.col("mu0")
    effect = (
        F.when(F.col("men_cells") == 0, -n0 * y0 / n)
        .when(F.col("women_cells") == 0, n1 * y1 / n)
        .otherwise(robust)
    )
    return smooth.groupBy(*by).agg((F.sum(effect * n) / F.sum("n")).alias("ate"), F.sum("n").alias("n_rows"))


def fuzzy_opposite_gap(df: DataFrame, similar: DataFrame, threshold: float = 0.8,
                       by: list[str] | None = None) -> DataFrame:
    """Exact gap where both sexes meet, nearest opposite-sex cells elsewhere."""
    by = by or []
    return fuzzy_opposite_gap_of_cells(covariate_cells(df, [*by, *COVARIATES]), similar, threshold, by)


def fuzzy_opposite_gap_of_cells(table: DataFrame, similar: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """The same from covariate cells, as runs and subsets have them."""
    table = materialize(table, "cells")
    met = table.where(F.col("y1").isNotNull() & F.col("y0").isNotNull()).select(*by, "n", (F.col("y1") - F.col("y0")).alias("gap"))
    fuzzy = fuzzy_opposite_join(table, similar, threshold, by=by).select(*by, "n", "gap")
    used = met.unionByName(fuzzy).groupBy(*by).agg(
        (F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ate"), F.sum("n").alias("n_used"))
    total = table.groupBy(*by).agg(F.sum("n").alias("n_rows"))
    if by:
        out = join_groups(total, used, by, "left")
    else:
        out = used.withColumn("n_rows", total.scalar())
    return out.select(*by, "ate", "n_rows", (F.coalesce("n_used", F.lit(0)) / F.col("n_rows")).alias("share_kept"))

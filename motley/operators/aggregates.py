"""Group estimates, counts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motley.operators.dictionary import range_bounds
from motley.operators.joins import join_groups
from motley.workdir import materialize


def group_mean(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(y).alias("estimate"), F.count("*").alias("n"))


def group_quantile(df: DataFrame, keys: list[str], y: str, q: float = 0.75, buckets: int = 128,
                   weight: str | None = None) -> DataFrame:
    """Exact quantile per key with linear interpolation; null values do not count.

    Without ``weight`` rows are counted per (key, value) first; with it they are taken as counted,
    and a value may come in several rows. Values are cut at bounds common to all keys, sums per (key, bucket)
    tell which buckets hold the wanted ranks, and only their values are ranked, so a hot key is spread
    over all tasks and rows are not shuffled. Bounds only decide how even the buckets are, never the result.
    """
    known = df.where(F.col(y).isNotNull())
    if weight is None:
        rows = materialize(known.groupBy(*keys, y).agg(F.count("*").alias("_c")), "counted")
    else:
        rows = known.select(*keys, y, F.col(weight).alias("_c")).where("_c > 0")
    tagged = rows.withColumn("_b", _bucket(F.col(y), sorted(set(range_bounds(rows.select(y).distinct(), y, buckets)))))
    # at most `buckets` rows per key
    hist = tagged.groupBy(*keys, "_b").agg(F.sum("_c").cast("bigint").alias("_w"))
    upto, whole = Window.partitionBy(*keys).orderBy("_b"), Window.partitionBy(*keys)
    hist = hist.withColumns({"n": F.sum("_w").over(whole), "_before": F.sum("_w").over(upto) - F.col("_w")})
    first, last = F.floor((F.col("n") - 1) * q), F.ceil((F.col("n") - 1) * q)
    hits = materialize(hist.where((F.col("_before") <= last) & (first < F.col("_before") + F.col("_w"))).select(
        *keys, "_b", "_before", "n"), "ranks")
    wanted = join_groups(tagged, hits, [*keys, "_b"]).groupBy(*keys, "_b", "_before", "n", y).agg(
        F.sum("_c").cast("bigint").alias("_c"))
    inside = Window.partitionBy(*keys, "_b").orderBy(y)
    ranked = wanted.withColumn("_below", F.col("_before") + F.sum("_c").over(inside) - F.col("_c"))
    at = lambda r: F.max(
        F.when((F.col("_below") <= r) & (r < F.col("_below") + F.col("_c")), F.col(y)))
    ends = ranked.groupBy(*keys, "n").agg(at(first).alias("_a"), at(last).alias("_z"))
    part = (F.col("n") - 1) * q - first
    between = F.when(F.col("_a") == F.col("_z"), F.col("_a").cast("double")).otherwise(
        F.col("_a") + (F.col("_z") - F.col("_a")) * part)
    return ends.select(*keys, between.alias("estimate"), "n")


def _bucket(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds lie below the value, by halving."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    listed = F.array(*[F.lit(b) for b in bounds])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(listed, n + step - 1) < value, n + step).otherwise(n))


def quantile_sketches(df: DataFrame, keys: list[str], y: str, k: int = 200) -> DataFrame:
    """(keys, sketch): a KLL sketch of the known values of each key, of a size that rows do not move.

    Sketches of finer keys can be merged, so splits and subsets need one scan. The rank of an
    estimate is off by about 1.65 per cent of the rows with k = 200, less in proportion with a larger k.
    """
    return df.where(F.col(y).isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(y).cast("double"), F.lit(k)).alias("sketch"))


def sketched_quantile(sketches: DataFrame, keys: list[str], q: float = 0.75) -> DataFrame:
    """(keys, estimate, n) like ``group_quantile``, from merged sketches; the estimate is one of the values."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("_s"))
    return merged.select(*keys, F.kll_sketch_get_quantile_double("_s", F.lit(q)).alias("estimate"), F.kll_sketch_get_n_double("_s").alias("n"))


def multi_grain_estimates(df: DataFrame, key: str, exp: str, y: str) -> DataFrame:
    """Means at grains (key, exp), (exp) and ().

    The rows are added up per (key, exp) once; only those sums are expanded
    to the coarser grains.  ``n`` counts all rows, means only those with a value.
    """
    fine = df.groupBy(key, exp).agg(F.sum(y).alias("_s"), F.count(y).alias("_c"), F.count("*").alias("_n"))
    return (
        fine.groupingSets([[key, exp], [exp], []], key, exp)
        .agg(F.try_divide(F.sum("_s"), F.sum("_c")).alias("estimate"), F.sum("_n").alias("n"),
             F.grouping_id(key, exp).alias("grain"))
        .withColumn("grain", F.when(F.col("grain") == 0, "key_exp").when(F.col("grain") == 2, "exp")
                    .otherwise("all"))
    )


def weighted_global(groups: DataFrame, estimate: str = "estimate", n: str = "n") -> DataFrame:
    """Mean of group statistics weighted by group size."""
    return groups.agg((F.sum(F.col(estimate) * F.col(n)) / F.sum(n)).alias("estimate"),
                      F.sum(n).alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def count_distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values per column, long form (column, n)."""
    counted = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    return counted.unpivot([], columns, "column", "n")


def top_k_frequent(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; equal counts in order of the value."""
    return value_counts(df, column).orderBy(F.desc("n"), column).limit(k)


def target_stats(df: DataFrame, column: str, y: str, classes: list | None = None) -> DataFrame:
    """Per category: size and mean target, or the share of each class."""
    if classes is None:
        means = [F.avg(y).alias("mean")]
    else:
        means = [F.avg((F.col(y) == F.lit(c)).cast("double")).alias(f"share_{c}") for c in classes]
    return df.groupBy(column).agg(F.count("*").alias("n"), *means)


CELL_SUMS = ("n", "n1", "n0", "s1", "s0", "c1", "c0")


def cell_sums(df: DataFrame, covariates: list[str], y: str = "salary", treated: str = "gender") -> DataFrame:
    """Covariate cells as sums, which add up over tables and runs.

    ``n``, ``n1`` and ``n0`` count rows, ``c1`` and ``c0`` those with a known outcome.
    """
    men, women = F.col(treated) == 1, F.col(treated) == 0
    return df.groupBy(*covariates).agg(
        F.count("*").alias("n"),
        F.count(F.when(men, 1)).alias("n1"),
        F.count(F.when(women, 1)).alias("n0"),
        F.sum(F.when(men, F.col(y))).alias("s1"),
        F.sum(F.when(women, F.col(y))).alias("s0"),
        F.count(F.when(men, F.col(y))).alias("c1"),
        F.count(F.when(women, F.col(y))).alias("c0"),
    )


def merge_cells(sums: DataFrame, covariates: list[str]) -> DataFrame:
    """Add up cell sums to coarser cells."""
    return sums.groupBy(*covariates).agg(*[F.sum(c).alias(c) for c in CELL_SUMS])


def cell_means(sums: DataFrame) -> DataFrame:
    """Cells with the mean outcome of each sex; null where a sex has no known outcome."""
    return sums.withColumns({
        "y1": F.try_divide("s1", "c1"), "y0": F.try_divide("s0", "c0")}).drop("s1", "s0", "c1", "c0")


def cells(df: DataFrame, covariates: list[str], y: str = "salary", treated: str = "gender") -> DataFrame:
    return cell_means(cell_sums(df, covariates, y, treated))


def propensity_by_group(df: DataFrame, covariates: list[str], treated: str = "gender") -> DataFrame:
    return df.groupBy(*covariates).agg(F.avg(treated).alias("propensity"), F.count("*").alias("n"))


def mean_curve(df: DataFrame, variant: str, exp: str, y: str, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Mean per experience for each variant, and pooled over the variants of a group."""
    by = by or []
    by_variant = df.groupBy(*by, variant, exp).agg(
        F.avg(y).alias("mean"), F.count("*").alias("n"), F.count(y).alias("_c"))
    pooled = by_variant.groupBy(*by, exp).agg(
        F.try_divide(F.sum(F.col("mean") * F.col("_c")), F.sum("_c")).alias("mean"), F.sum("n").alias("n"))
    return by_variant.drop("_c"), pooled


def finite(c: Column) -> Column:
    """True for values that are neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def run_summary(df: DataFrame, by: list[str], value: str, q: float = 0.75) -> DataFrame:
    """Mean and the q and 1-q quantiles over runs; NaN and infinity dropped."""
    return df.where(finite(F.col(value))).groupBy(*by).agg(
        F.avg(value).alias("mean"), F.percentile(value, F.lit(q)).alias("upper"),
        F.percentile(value, F.lit(1 - q)).alias("lower"), F.count("*").alias("runs"))


def box_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, ends and number of runs per group."""
    cut = lambda q: F.percentile(value, F.lit(q))
    return df.where(finite(F.col(value))).groupBy(*by).agg(
        F.min(value).alias("low"), cut(0.25).alias("q1"), cut(0.5).alias("median"),
        cut(0.75).alias("q3"), F.max(value).alias("high"), F.count("*").alias("runs"))


def error_summary(errors: DataFrame, by: list[str], error: str = "error") -> DataFrame:
    e = F.col(error)
    return errors.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mae"), F.avg(e * e).alias("brier"),
        F.count("*").alias("n"))


def error_by_variants(errors: DataFrame, by: list[str], error: str = "error",
                      n_variants: str = "n_variants") -> DataFrame:
    """Errors split by 0, 1 or more known variants of the test title."""
    kind = F.when(F.col(n_variants) == 0, "none").when(F.col(n_variants) == 1, "one").otherwise("many")
    return error_summary(errors.withColumn("seen", kind), [*by, "seen"], error)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of each group in the given order."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def argmin_param(df: DataFrame, by: list[str], param: str, error: str) -> DataFrame:
    """Parameter with the smallest mean error; equal errors take the smaller one."""
    means = df.groupBy(*by, param).agg(F.avg(error).alias("mean_error"))
    return means.groupBy(*by).agg(
        F.min(F.struct("mean_error", param)).alias("_best")).select(
        *by, F.col(f"_best.{param}").alias(param), F.col("_best.mean_error").alias("mean_error"))

"""Joins between questions and estimates: fallback, variants and kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motley.operators.joins import join_groups
from motley.operators.vector_join import kernel_weight, with_itself


def grain_estimates(df: DataFrame, key: str, exp: str | None, y: str, by: list[str] | None = None,
                    weight: str | None = None) -> dict[str, DataFrame]:
    """Mean estimates at the grains key(, exp), exp and all.

    The rows are reduced to (key, exp) sums once; the coarser grains are made
    from those sums.  ``by`` keeps estimates of several runs apart.  ``n`` counts
    the rows with a known outcome; a group without any has no estimate.
    """
    by = by or []
    keys = [key] + ([exp] if exp else [])
    n = F.count(y) if weight is None else F.sum(F.when(F.col(y).isNotNull(), F.col(weight)).otherwise(0))
    fine = df.groupBy(*by, *keys).agg(F.sum(y).alias("_s"), n.alias("n"))
    return grains_from_sums(fine, key, exp, by)


def grains_from_sums(fine: DataFrame, key: str, exp: str | None, by: list[str]) -> dict[str, DataFrame]:
    """Grains from a table of sums ``_s`` and sizes ``n`` per (by, key, exp)."""
    keys = [key] + ([exp] if exp else [])
    total = lambda cols: fine.groupBy(*cols).agg(
        F.try_divide(F.sum("_s"), F.sum("n")).alias("estimate"), F.sum("n").alias("n"))
    out = {"fine": fine.select(*by, *keys, F.try_divide("_s", "n").alias("estimate"), "n"), "all": total(by)}
    if exp:
        out["exp"] = total([*by, exp])
    return out


def estimate_lookup(queries: DataFrame, grains: dict[str, DataFrame], key: str, exp: str | None,
                    by: list[str] | None = None) -> DataFrame:
    """Estimate of each question from the finest grain that knows it.

    (key, exp), then (exp), then all; ``matched`` tells whether the finest one did.
    """
    by = by or []
    keys = [key] + ([exp] if exp else [])
    fine = grains["fine"].select(*by, *keys, F.col("estimate").alias("_fine"))
    out = join_groups(queries, fine, [*by, *keys], "left")
    levels = [F.col("_fine")]
    if exp:
        out = join_groups(out, grains["exp"].select(*by, exp, F.col("estimate").alias("_exp")), [*by, exp], "left")
        levels.append(F.col("_exp"))
    if by:
        out = join_groups(out, grains["all"].select(*by, F.col("estimate").alias("_all")), by, "left")
        levels.append(F.col("_all"))
    else:
        levels.append(grains["all"].select("estimate").scalar())
    return out.withColumns({
        "estimate": F.coalesce(*levels), "matched": F.col("_fine").isNotNull().cast("int"),
    }).drop("_fine", "_exp", "_all")


def variant_lookup(queries: DataFrame, variants: DataFrame, estimates: DataFrame, key: list[str], raw: list[str],
                   seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """Estimate of one known variant of the key, picked by hash; -1 when none is known.

    ``variants`` maps key columns to raw columns, ``estimates`` is per raw.
    """
    by = by or []
    place = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in raw], F.lit(str(seed))))
    picked = join_groups(variants, estimates, raw).groupBy(*by, *key).agg(F.min_by("estimate", place).alias("estimate"))
    return join_groups(queries, picked, [*by, *key], "left").fillna({"estimate": -1.0})


def variant_presence(queries: DataFrame, variants: DataFrame, train: DataFrame, key: list[str], raw: list[str],
                     by: list[str] | None = None) -> DataFrame:
    """Add ``n_variants``: how many variants of the key the training rows hold."""
    by = by or []
    present = join_groups(variants, train.select(*by, *[c for c in raw if c not in by]).distinct(), raw)
    counts = present.groupBy(*by, *key).agg(F.count("*").alias("n_variants"))
    return join_groups(queries, counts, [*by, *key], "left").fillna({"n_variants": 0})


def kernel_sums(cells: DataFrame, similar: DataFrame, threshold: float, key: str, exp: str | None,
                by: list[str] | None = None, complete: bool = False) -> DataFrame:
    """Kernel-weighted mean of the cells around every title of ``similar``.

    ``cells`` has (by, key, exp, estimate, n), ``similar`` has (key, other,
    cos) over distinct titles: only equi-joins touch the cells.  A title that
    ``similar`` does not know is only near itself; ``complete`` tells that all
    wanted titles are in it.
    """
    by = by or []
    known = similar if complete else with_itself(similar, cells, key)
    near = known.withColumn("_w", kernel_weight(threshold)).where(F.col("_w") > 0).select(
        F.col("other").alias("_other"), F.col(key), "_w")
    rest = [c for c in [exp] if c]
    train = cells.select(*by, F.col(key).alias("_other"), *rest, "estimate", "n")
    met = join_groups(train, near, ["_other"])
    share = F.col("_w") * F.col("n")
    return met.groupBy(*by, key, *rest).agg(F.try_divide(F.sum(share * F.col("estimate")), F.sum(share)).alias("_kernel"))


def kernel_join(queries: DataFrame, grains: dict[str, DataFrame], similar: DataFrame, threshold: float, key: str,
                exp: str | None, by: list[str] | None = None, alpha: float | None = None) -> DataFrame:
    """Kernel estimate of each question; without neighbours the fallback estimate.

    With ``alpha`` matched questions mix the exact and the kernel estimate,
    ``alpha * exact + (1 - alpha) * kernel``.
    """
    by = by or []
    wanted = queries.select(key).distinct()  # only these titles need neighbours
    near = join_groups(with_itself(similar, wanted, key), wanted, [key], "left_semi")
    sums = kernel_sums(grains["fine"], near, threshold, key, exp, by, complete=True)
    asked = estimate_lookup(queries, grains, key, exp, by)
    out = join_groups(asked, sums, [*by, key] + ([exp] if exp else []), "left")
    fuzzy = F.coalesce("_kernel", "estimate")
    if alpha is not None:
        fuzzy = F.when(F.col("matched") == 1, F.col("estimate") * alpha + fuzzy * (1 - alpha)).otherwise(fuzzy)
    return out.withColumn("estimate", fuzzy).drop("_kernel")


def fuzzy_band_join(cells: DataFrame, similar: DataFrame, threshold: float, title: str = "title",
                    exp: str = "seniority", exact: tuple[str, ...] = ("employer", "ethnicity"),
                    band: int = 2) -> DataFrame:
    """Kernel-smoothed propensity and outcomes of every covariate cell.

    Neighbours share the exact covariates, lie within ``band`` years and are
    weighted by the title kernel.  Each cell is first added to the years it can
    reach, so both the band and the title condition become equi-joins.  Null
    covariates are values of their own, and a title without a vector is near
    itself: every cell comes out.
    """
    p = F.col("n1") / F.col("n")
    reach = cells.withColumn(exp, F.explode_outer(F.sequence(F.col(exp) - band, F.col(exp) + band)))
    banded = reach.groupBy(F.col(title).alias("_other"), exp, *exact).agg(
        F.sum(p).alias("_p"), F.count("*").alias("_c"),
        F.sum("y1").alias("_y1"), F.count("y1").alias("_c1"),
        F.sum("y0").alias("_y0"), F.count("y0").alias("_c0"),
    )
    near = with_itself(similar, cells, title).withColumn("_w", kernel_weight(threshold)).where(F.col("_w") > 0).select(
        F.col("other").alias("_other"), F.col(title), "_w")
    w = lambda c: F.sum(F.col("_w") * F.col(c))
    smooth = join_groups(banded, near, ["_other"]).groupBy(title, exp, *exact).agg(
        (w("_p") / w("_c")).alias("propensity"),
        F.try_divide(w("_y1"), w("_c1")).alias("mu1"),
        F.try_divide(w("_y0"), w("_c0")).alias("mu0"),
        F.sum("_c1").alias("men_cells"), F.sum("_c0").alias("women_cells"),
    )
    return join_groups(cells, smooth, [title, exp, *exact])


def fuzzy_opposite_join(cells: DataFrame, similar: DataFrame, threshold: float, title: str = "title",
                        exact: tuple[str, ...] = ("seniority", "employer", "ethnicity"),
                        by: list[str] | None = None) -> DataFrame:
    """One-sex cells matched to cells of the other sex only.

    Titles must have cosine > threshold, or be the same, and the other covariates
    be equal, null ones included; the matched cells count equally.  A sex without
    known outcomes counts as absent.  Gives (cell columns, sex, n, gap).
    """
    by = by or []
    keys = [*by, *exact]
    one = cells.where(F.col("y1").isNull() != F.col("y0").isNull()).select(
        *keys, F.col(title), F.col("y0").isNull().cast("int").alias("sex"),
        F.coalesce("y1", "y0").alias("y"), "n")
    other = one.select(*keys, F.col(title).alias("_other"), (1 - F.col("sex")).alias("sex"), F.col("y").alias("_y"))
    near = with_itself(similar, cells, title).where(F.col("cos") > threshold).select(F.col(title), F.col("other").alias("_other"))
    met = join_groups(join_groups(one, near, [title]), other, [*keys, "_other", "sex"])
    means = met.groupBy(*keys, title, "sex", "y", "n").agg(F.avg("_y").alias("_y"))
    gap = F.when(F.col("sex") == 1, F.col("y") - F.col("_y")).otherwise(F.col("_y") - F.col("y"))
    return means.select(*keys, title, "sex", "n", gap.alias("gap"))

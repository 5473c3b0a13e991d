"""Salary-gap estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql as Q
from catalog.lookups import T, fine, similar_titles
from catalog.registry import query
from motley.functions import hashing
from motley.operators import lookups as look
from motley.operators import sampling
from motley.operators.aggregates import cells
from motley.plans import gap
from motley.sources.people import people

P = f"WITH {Q.PEOPLE}"
COV = ", ".join(gap.COVARIATES)


def cells_sql(source: str, title: str, by: str = "") -> str:
    """CTE cells over the covariates."""
    return f"""cells AS (SELECT {by}{title} AS title, seniority, employer, ethnicity, count(*) AS n,
  count(*) FILTER (gender = 1) AS n1, count(*) FILTER (gender = 0) AS n0,
  avg(salary) FILTER (gender = 1) AS y1, avg(salary) FILTER (gender = 0) AS y0 FROM {source} GROUP BY ALL)"""


def gap_sql(dismiss: bool, by: str = "") -> str:
    kept = "n1 > 0 AND n0 > 0" if dismiss else "true"
    return f"""SELECT {by}round(sum((coalesce(y1, 0) - coalesce(y0, 0)) * n) FILTER ({kept}) / sum(n) FILTER ({kept}), 4) AS ate,
  CAST(sum(n) AS BIGINT) AS n_rows, coalesce(sum(n) FILTER (n1 > 0 AND n0 > 0), 0) / sum(n) AS share_kept FROM cells"""


def rounded(df):
    return df.withColumn("ate", F.round("ate", 4))


@query("exact_matching_gap", f"{P}, {cells_sql('people', 'title')} {gap_sql(True)}")
def exact_matching_gap(spark, sf):
    return rounded(gap.exact_matching_gap(
        people(spark, sf, "title", "seniority", "employer", "ethnicity", "gender", "salary")))


@query("exact_matching_gap_all", f"{P}, {cells_sql('people', 'fine_title')} {gap_sql(False)}")
def exact_matching_gap_all(spark, sf):
    """One-sex cells kept, with 0 for the missing side."""
    return rounded(gap.exact_matching_gap(
        fine(spark, sf, "seniority", "employer", "ethnicity", "gender", "salary"), dismiss=False))


_SPELLED = "(SELECT *, unnest([title, 'all']) AS variant FROM people)"


@query("gap_by_variant", f"""{P}, {cells_sql(_SPELLED, 'matched_title', 'variant, ')}
  {gap_sql(False, 'title AS matched_title, variant, ')} GROUP BY title, variant""")
def gap_by_variant(spark, sf):
    """Gap of every spelling of a title, and of all its spellings merged."""
    p = people(spark, sf, "title", "matched_title", "seniority", "employer", "ethnicity", "gender", "salary")
    both = p.withColumn("variant", F.explode(F.array("title", F.lit("all"))))
    return rounded(gap.exact_matching_gap(both, ["seniority", "employer", "ethnicity"], False, ["matched_title", "variant"]))


_MEN = "table_id < 7"


def _down_sql(rate: float) -> str:
    return f"""down AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ({_MEN}), gender ORDER BY
    {hashing.mixed_hash_sql('row_id', 9)}, row_id) AS r, count(*) OVER (PARTITION BY ({_MEN}), gender) AS size FROM people)
    WHERE r > CASE WHEN ({_MEN}) = (gender = 0) THEN floor(size * {rate}) ELSE 0 END)"""


def down_sampled(df, rate: float):
    """Women leave the men tables and men the others, at the given rate."""
    side = df.withColumn("_men", F.expr(_MEN))
    drop = F.when(F.col("_men") == (F.col("gender") == 0), F.lit(rate)).otherwise(F.lit(0.0))
    return sampling.stratified_downsample(
        side, ["_men", "gender"], "row_id", drop, hashing.widened(hashing.mixed_hash(F.col("row_id"), 9))).drop("_men")


@query("stratified_downsample", f"{P}, {_down_sql(0.55)} SELECT row_id, table_id, gender FROM down")
def stratified_downsample(spark, sf):
    return down_sampled(people(spark, sf, "row_id", "table_id", "gender"), 0.55).select("row_id", "table_id", "gender")


def _depleted(spark, sf):
    return down_sampled(fine(spark, sf, "row_id", "table_id", "seniority", "employer", "ethnicity", "gender", "salary"), 1.0)


def opposite_sql(by: str = "") -> str:
    """CTE fuzzy: one-sex cells beside the mean of similar cells of the other sex, per run if there are any."""
    keys = [c.strip() for c in by.split(",") if c.strip()]
    own, same = "".join(f"a.{c}, " for c in keys), "".join(f" AND b.{c} = a.{c}" for c in keys)
    named = "".join(f"{c}, " for c in keys)
    return f"""one AS (SELECT *, CAST(n0 = 0 AS INTEGER) AS sex, coalesce(y1, y0) AS y FROM cells WHERE n1 = 0 OR n0 = 0),
  met AS (SELECT {own}a.title, a.seniority, a.employer, a.ethnicity, a.sex, a.n, a.y, avg(b.y) AS yy FROM one a JOIN near_titles s ON s.title = a.title
    JOIN one b ON b.title = s.other AND b.seniority = a.seniority AND b.employer = a.employer AND b.ethnicity = a.ethnicity
    AND b.sex = 1 - a.sex{same} GROUP BY ALL),
  fuzzy AS (SELECT {named}title, seniority, employer, ethnicity, sex, n, CASE sex WHEN 1 THEN y - yy ELSE yy - y END AS gap FROM met)"""


_OPPOSITE = opposite_sql()
_DEPLETED = f"""{P}, {Q.similar(T, 'fine_title')}, {_down_sql(1.0)}, {cells_sql('down', 'fine_title')}"""


@query("fuzzy_opposite_join", f"""{_DEPLETED}, {_OPPOSITE} SELECT title, seniority, employer, ethnicity, sex, n,
  round(gap, 4) AS gap FROM fuzzy""")
def fuzzy_opposite_join(spark, sf):
    out = look.fuzzy_opposite_join(cells(_depleted(spark, sf), gap.COVARIATES), similar_titles(spark, sf, "fine_title"), T)
    return out.withColumn("gap", F.round("gap", 4))


@query("fuzzy_opposite_gap", f"""{_DEPLETED}, {_OPPOSITE}, used AS (SELECT n, gap FROM fuzzy UNION ALL
  SELECT n, y1 - y0 FROM cells WHERE n1 > 0 AND n0 > 0)
  SELECT round(sum(gap * n) / sum(n), 4) AS ate, (SELECT CAST(sum(n) AS BIGINT) FROM cells) AS n_rows,
  sum(n) / (SELECT sum(n) FROM cells) AS share_kept FROM used""")
def fuzzy_opposite_gap(spark, sf):
    return rounded(gap.fuzzy_opposite_gap(_depleted(spark, sf), similar_titles(spark, sf, "fine_title"), T))


def smooth_sql(by: str = "") -> str:
    """CTE smooth: cells with the kernel means of similar cells, per subset if there are any."""
    own, same = (f"a.{by}, ", f" AND b.{by} = a.{by}") if by else ("", "")
    return f"""smooth AS (SELECT {own}a.title, a.seniority, a.employer, a.ethnicity, a.n, a.n1, a.n0, a.y1, a.y0,
  sum(w * b.n1 / b.n) / sum(w) AS e, sum(w * b.y1) / sum(w) FILTER (b.n1 > 0) AS mu1, sum(w * b.y0) / sum(w) FILTER (b.n0 > 0) AS mu0,
  CAST(sum(b.n1) AS BIGINT) AS men, CAST(sum(b.n0) AS BIGINT) AS women
  FROM cells a JOIN (SELECT title, other, {Q.kernel(T)} AS w FROM near_titles WHERE {Q.kernel(T)} > 0) s ON s.title = a.title
  JOIN cells b ON b.title = s.other AND b.employer = a.employer AND b.ethnicity = a.ethnicity
    AND abs(a.seniority - b.seniority) <= 2{same} GROUP BY ALL)"""


# doubly robust effect of a row of ``smooth``
EFFECT = """CASE WHEN men = 0 THEN -n0 * coalesce(y0, 0) / n WHEN women = 0 THEN n1 * coalesce(y1, 0) / n
  ELSE (n1 * (coalesce(y1, 0) - mu1) / e - n0 * (coalesce(y0, 0) - mu0) / (1 - e)) / n + mu1 - mu0 END"""
_SMOOTH = smooth_sql()
_FUZZY = f"{P}, {Q.similar(T, 'fine_title')}, {cells_sql('people', 'fine_title')}, {_SMOOTH}"


@query("fuzzy_band_join", f"""{_FUZZY} SELECT title, seniority, employer, ethnicity, n, round(e, 6) AS propensity,
  round(mu1, 4) AS mu1, round(mu0, 4) AS mu0 FROM smooth""")
def fuzzy_band_join(spark, sf):
    p = fine(spark, sf, "seniority", "employer", "ethnicity", "gender", "salary")
    out = look.fuzzy_band_join(cells(p, gap.COVARIATES), similar_titles(spark, sf, "fine_title"), T)
    return out.select(*gap.COVARIATES, "n", F.round("propensity", 6).alias("propensity"),
                      F.round("mu1", 4).alias("mu1"), F.round("mu0", 4).alias("mu0"))


@query("fuzzy_aipw", f"{_FUZZY} SELECT round(sum(n * {EFFECT}) / sum(n), 4) AS ate, CAST(sum(n) AS BIGINT) AS n_rows FROM smooth")
def fuzzy_aipw(spark, sf):
    p = fine(spark, sf, "seniority", "employer", "ethnicity", "gender", "salary")
    return rounded(gap.fuzzy_aipw(p, similar_titles(spark, sf, "fine_title"), T))

"""URL rules by expressions of host suffix and path prefix, joined on short hashes.

Every url is expanded into the suffixes of its host at label borders and the prefixes of
its path at the lengths the rules have. An expression meets a rule if the first 32 bits of
their SHA-256 agree; the full digest then confirms it, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motley.llm.common import lower_ascii

# Fixed values: (verdict, host, path).
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
DEFAULT = "allow"
PREFIX = 8


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _digest(host: Column, path: Column) -> Column:
    # A host holds no line feed that matters here, so host and path cannot run into each other.
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _length(host: Column, path: Column) -> Column:
    return F.length(host) + F.length(path)


def judge(pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
          default: str = DEFAULT) -> DataFrame:
    """(id, host, path, rule, verdict): one row per input row.

    ``rules`` has verdict, host and path; a rule fits its host and all subdomains if the path
    of the url starts with the rule's. The longest fitting rule wins, an equally long one by
    its longer host, then block before allow. Without a fitting rule ``rule`` is null and the
    verdict is ``default``. Urls that are null or hold no ``://`` have an empty host and path.
    Distinct urls are judged once, so that a hot host or url costs one judgement; repeated
    rows come out as often as they went in. Rules with a null part are ignored. An empty
    table of pages or of rules does no harm; other columns are not read.
    """
    spark = pages.sparkSession
    rules = rule_table(spark) if rules is None else rules
    rules = (rules.select("verdict", lower_ascii(F.col("host")).alias("host"), "path").dropna().distinct()
             .withColumn("digest", _digest(F.col("host"), F.col("path"))))
    short = F.substring("digest", 1, PREFIX).alias("short")
    listed = rules.select(short, F.col("digest").alias("full"), F.col("host").alias("rule_host"),
                          F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    # One small integer per length of a rule's path, so never more than the longest path has characters.
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())

    url = F.col(url_col)
    cut = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    places = cut.select("host", "path").distinct()
    prefixes = F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    spread = (places.withColumn("suffix", F.explode(_suffixes(F.col("host"))))
              .withColumn("cut", F.explode(prefixes))
              .withColumn("digest", _digest(F.col("suffix"), F.substring(F.col("path"), F.lit(1), F.col("cut"))))
              .withColumn("short", F.substring("digest", 1, PREFIX)))
    fits = spread.join(listed, "short").where("digest = full")
    best = F.max_by(
        F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")),
        F.struct(_length(F.col("rule_host"), F.col("rule_path")), F.length("rule_host"),
                 (F.col("rule_verdict") == "block").cast("int")))
    decided = fits.groupBy("host", "path").agg(best.alias("best"))
    return cut.join(decided, ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def oracle() -> str:
    """The same rows in DuckDB SQL over the table ``pages``."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lower.format(r"regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)', 1)")
    return rf"""
WITH rules(rule_verdict, rule_host, rule_path) AS (VALUES {values}),
cut AS (SELECT row_number() OVER () AS r, page_id, {host} AS host,
    regexp_extract(coalesce(url, ''), '(?s)\A.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fits AS (SELECT r, rule_host || rule_path AS rule, rule_verdict FROM cut, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC,
    rule_verdict DESC) = 1)
SELECT page_id, host, path, rule, coalesce(rule_verdict, '{DEFAULT}') AS verdict
FROM cut LEFT JOIN fits USING (r)"""

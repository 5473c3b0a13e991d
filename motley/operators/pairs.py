"""Similarity of value pairs, and similarity joins between two tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motley.functions.grams import padded, preprocess, range_grams, windows
from motley.functions.gram_batches import gram_counts as counted_grams
from motley.functions.similarity import METRICS
from motley.operators.dictionary import spread
from motley.operators.edit_join import string_candidates
from motley.operators.joins import join_groups
from motley.workdir import materialize


def pair_similarity(pairs: DataFrame, left: str, right: str, metric: str, name: str = "score", **options) -> DataFrame:
    """Score each distinct pair once and join the scores back."""
    fn = METRICS[metric]
    scored = pairs.select(left, right).na.drop().distinct().withColumn(
        name, fn(F.col(left), F.col(right), **options))
    return pairs.join(scored, [left, right], "left")


def gram_counts(df: DataFrame, value: str, lo: int, hi: int, hashing_dim: int | None = None,
                hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(value, gram, cnt) of the distinct values; safe for whole texts.

    With ``hashing_dim`` the gram is replaced by its bucket, the hash modulo that number.
    """
    # outer: an inner explode would compute the array twice, once as a filter
    grams = spread(df, value).select(
        value, F.explode_outer(range_grams(F.col(value), lo, hi)).alias("gram")).where("gram IS NOT NULL")
    if hashing_dim:
        grams = grams.withColumn("gram", F.pmod(hashed(F.col("gram")), F.lit(hashing_dim)))
    return grams.groupBy(value, "gram").agg(F.count("*").alias("cnt"))


def trigram_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, n): how often each 3-gram stands in the texts of a key; a null text counts for the gram null.

    The grams of a text are counted in its row. Only keys of several rows have counts to add up, so
    only theirs are shuffled.
    """
    repeated = materialize(df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key), "repeated")

    def counts(rows: DataFrame) -> DataFrame:
        cut = counted_grams(F.concat(F.lit("  "), F.col(text), F.lit("  ")), 3)
        each = rows.select(key, F.explode_outer(cut).alias("_g"))
        return each.select(key, "_g.gram", F.coalesce("_g.n", F.lit(1)).alias("n"))

    once = counts(join_groups(df, repeated, [key], "left_anti"))
    more = counts(join_groups(df, repeated, [key], "left_semi"))
    return once.unionByName(more.groupBy(key, "gram").agg(F.sum("n").alias("n")))


def _tokens(df: DataFrame, value: str, n: int) -> DataFrame:
    """(value, size, token): n-grams of the value's multiset, made distinct by number."""
    grams = spread(df, value).withColumn("_grams", windows(padded(preprocess(F.col(value))), n)).select(
        value, F.size("_grams").alias("size"), F.explode_outer("_grams").alias("gram")).where("gram IS NOT NULL")
    counted = grams.groupBy(value, "size", "gram").agg(F.count("*").cast("int").alias("cnt"))
    return counted.select(
        value, "size", F.explode(F.sequence(F.lit(1), F.col("cnt"))).alias("no"), "gram"
    ).select(value, "size", F.concat_ws("\u0001", "gram", "no").alias("token"))


def _ranked(tokens: DataFrame, order: DataFrame, value: str) -> DataFrame:
    """(value, size, tokens): the members of each value, rarest first."""
    return tokens.join(order, "token").groupBy(value, "size").agg(
        F.array_sort(F.collect_list(F.struct("freq", "token"))).alias("_t")).select(
        value, "size", F.col("_t.token").alias("tokens"))


def _prefixes(ranked: DataFrame, value: str, share: float) -> DataFrame:
    """The rarest members of each value, as many as the shared one must be among.

    Of two sets with at least ``share`` of their members in common, the first
    size - ceil(share * size) + 1 in a common order must meet.
    """
    keep = F.col("size") - F.ceil(F.col("size") * share - 1e-9).cast("int") + 1
    return ranked.select(value, "size", F.explode(F.slice("tokens", 1, F.greatest(keep, F.lit(1)))).alias("token"))


def _token_tables(left, right, lcol, rcol, n) -> tuple[DataFrame, DataFrame]:
    lt, rt = _tokens(left, lcol, n), _tokens(right, rcol, n)
    order = lt.select("token").unionByName(rt.select("token")).groupBy("token").agg(F.count("*").alias("freq"))
    return materialize(_ranked(lt, order, lcol), "left"), materialize(_ranked(rt, order, rcol), "right")


def candidate_pairs(left: DataFrame, right: DataFrame, lcol: str, rcol: str, share: float) -> DataFrame:
    """Distinct pairs of two token tables that can have ``share`` in common; none is missed.

    An equi-join on rare shared members (prefix filter) with a size filter.
    """
    lp = _prefixes(left, lcol, share).withColumnRenamed("size", "lsize")
    rp = _prefixes(right, rcol, share).withColumnRenamed("size", "rsize")
    met = lp.join(rp, "token").where(
        (F.col("lsize") >= F.col("rsize") * share - 1e-9) & (F.col("rsize") >= F.col("lsize") * share - 1e-9))
    return met.select(lcol, rcol).distinct()


def similarity_join(left: DataFrame, right: DataFrame, lcol: str, rcol: str, metric: str, min_score: float,
                    block_on: tuple[Column, Column] | None = None, n: int = 3, **options) -> DataFrame:
    """(left value, right value, score) for all pairs with score >= min_score.

    Candidates come from segments or common characters for edit metrics, from shared n-grams for
    ``ngram`` or, with ``block_on``, from equality of a key computed on each side; every
    candidate is then scored exactly, with the metric's ``options``. Null values take no part.
    """
    if lcol == rcol:
        raise ValueError("name the two columns differently")
    if block_on is not None:
        lv = left.select(lcol).na.drop().distinct().withColumn("_block", block_on[0])
        rv = right.select(rcol).na.drop().distinct().withColumn("_block", block_on[1])
        pairs = lv.join(rv, "_block").select(lcol, rcol)
        score = METRICS[metric](F.col(lcol), F.col(rcol), **({"n": n} if metric == "ngram" else options))
        return pairs.withColumn("score", score).where(F.col("score") >= min_score)
    # equal values without members (empty, or shorter than n) have nothing to meet by
    same = left.select(lcol).distinct().join(right.select(rcol).distinct(), F.col(lcol) == F.col(rcol)).select(lcol, rcol)
    if metric != "ngram":
        pairs = string_candidates(left, right, lcol, rcol, metric, min_score).unionByName(same).distinct()
        return pairs.withColumn("score", METRICS[metric](F.col(lcol), F.col(rcol), **options)).where(F.col("score") >= min_score)
    if min_score <= 0:
        raise ValueError(f"ngram >= {min_score} does not bound the shared n-grams: give block_on")
    lt, rt = _token_tables(left, right, lcol, rcol, n)
    pairs = candidate_pairs(lt, rt, lcol, rcol, min_score).unionByName(same).distinct()
    # the token lists are made once per value, each pair only counts the common ones
    pairs = pairs.join(lt.select(lcol, F.col("tokens").alias("_l")), lcol).join(
        rt.select(rcol, F.col("tokens").alias("_r")), rcol)
    common = F.size(F.array_intersect("_l", "_r"))
    score = common / (F.size("_l") + F.size("_r") - common)
    return pairs.withColumn("score", score).where(F.col("score") >= min_score).select(lcol, rcol, "score")

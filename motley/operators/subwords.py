"""Vectors for words that no table has, from the n-grams they share with words it has."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motley.functions.grams import windows
from motley.functions.vectors import l2_normalize, usable
from motley.operators.dictionary import spread
from motley.operators.encoders import words_of


def word_grams(word: Column, sizes: tuple[int, int] = (3, 5)) -> Column:
    """Distinct n-grams of a word between marks of its beginning and end."""
    return F.array_distinct(windows(F.concat(F.lit("<"), word, F.lit(">")), *range(sizes[0], sizes[1] + 1)))


def _mean(df: DataFrame, by: str, vec: str, name: str) -> DataFrame:
    """Mean vector per group; the sums of a group are made before the shuffle."""
    return df.groupBy(by).agg(vector_to_array(Summarizer.mean(array_to_vector(vec))).alias(name))


def gram_vectors(words: DataFrame, sizes: tuple[int, int] = (3, 5)) -> DataFrame:
    """(gram, vector): the mean of the unit vectors of the words that hold an n-gram.

    ``words`` has (word, vector) of one size; words that are null or have no whole vector take no part.
    """
    unit = words.where(usable(F.col("vector")) & F.col("word").isNotNull()).select("word", l2_normalize(F.col("vector")).alias("_v"))
    # outer: an inner explode would cut the words twice, once as a filter
    grams = unit.select(F.explode_outer(word_grams(F.col("word"), sizes)).alias("gram"), "_v").where("gram IS NOT NULL")
    return _mean(grams, "gram", "_v", "vector")


def vectors_of_words(asked: DataFrame, words: DataFrame, grams: DataFrame, column: str = "word",
                     sizes: tuple[int, int] = (3, 5)) -> DataFrame:
    """(word, vector, known): the unit vector of every distinct asked word.

    A word that ``words`` lacks takes the mean of the vectors of its n-grams, as far as ``grams``
    has them; one without any has null. ``known`` tells which have a vector of their own.
    """
    distinct = spread(asked, column).select(F.col(column).alias("word"))
    own = words.where(usable(F.col("vector")) & F.col("word").isNotNull()).groupBy("word").agg(
        F.min(l2_normalize(F.col("vector"))).alias("vector"))
    known = distinct.join(own, "word").select("word", "vector", F.lit(True).alias("known"))
    other = distinct.join(own, "word", "left_anti")
    pieces = other.select("word", F.explode_outer(word_grams(F.col("word"), sizes)).alias("gram"))
    made = _mean(pieces.join(grams.select("gram", F.col("vector").alias("_v")), "gram"), "word", "_v", "vector")
    guessed = other.join(made, "word", "left").select("word", l2_normalize(F.col("vector")).alias("vector"), F.lit(False).alias("known"))
    return known.unionByName(guessed)


def embed_with_subwords(titles: DataFrame, column: str, words: DataFrame, grams: DataFrame, name: str = "vector",
                        sizes: tuple[int, int] = (3, 5)) -> DataFrame:
    """(title, vector): mean of the unit vectors of the words of every distinct title, unknown words by their n-grams.

    A title none of whose words shares an n-gram with a known word has a null vector.
    """
    distinct = spread(titles, column)
    tokens = distinct.select(column, F.explode(F.split(F.trim(column), r"(?U)\s+")).alias("word"))
    each = vectors_of_words(tokens, words, grams, "word", sizes).where("vector IS NOT NULL").select("word", F.col("vector").alias("_v"))
    return distinct.join(_mean(tokens.join(each, "word"), column, "_v", name), column, "left")


def train_words(texts: DataFrame, column: str, size: int = 32, least: int = 1, window: int = 5, rounds: int = 5, seed: int = 0) -> DataFrame:
    """(word, vector) learnt from the words around each word of the texts; null texts teach nothing."""
    sentences = texts.where(F.col(column).isNotNull()).select(words_of(F.lower(column)).alias("_words"))
    model = Word2Vec(vectorSize=size, minCount=least, windowSize=window, maxIter=rounds, seed=seed, inputCol="_words").fit(sentences)
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))

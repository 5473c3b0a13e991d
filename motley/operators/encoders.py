"""Dirty categories to numeric columns.

Encoders are Spark ML estimators.  Each works on the distinct values of a
column and joins its result back to the rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motley.functions.binding import let
from motley.functions.gram_batches import NONE, portable_least
from motley.functions.grams import ngram_count, padded, preprocess, windows
from motley.functions.hashing import portable, reseeded, seeded
from motley.functions.similarity import METRICS
from motley.functions.vectors import usable
from motley.operators.aggregates import target_stats, top_k_frequent, value_counts
from motley.operators.components import components
from motley.operators.dictionary import check_known, dense_ids, spread
from motley.operators.joins import join_groups
from motley.operators.pairs import gram_counts
from motley.operators.vector_join import nearest_prototype
from motley.workdir import materialize, read_settings, write_settings

def kmeans_prototypes(df: DataFrame, column: str, k: int, dim: int = 128, ngram: tuple[int, int] = (3, 3),
                      seed: int = 0) -> list[str]:
    """Values nearest to the centres of weighted k-means on hashed n-gram counts."""
    grams = windows(F.lower(F.regexp_replace(column, r"(?U)\s\s+", " ")), *range(ngram[0], ngram[1] + 1))
    counted = value_counts(df.select(column).na.drop(), column).withColumn("_grams", grams)
    hashed = HashingTF(inputCol="_grams", outputCol="_v", numFeatures=dim).transform(counted)
    points = materialize(hashed.select(column, "n", vector_to_array("_v").alias("_v")), "kmeans")
    model = KMeans(k=k, seed=seed, weightCol="n", featuresCol="_f").fit(
        points.withColumn("_f", array_to_vector("_v")).orderBy(column))
    found = nearest_prototype(points, column, "_v", [list(c) for c in model.clusterCenters()])
    values = sorted({r["value"] for r in found.collect()})
    if len(values) < k:
        warnings.warn(f"k={k} centres share nearest values: {len(values)} prototypes of {column!r}")
    return values


class SimilarityEncoder(Estimator):
    """Similarity of each value to every prototype.

    ``categories`` is ``'auto'`` (all values), ``'most_frequent'``,
    ``'k-means'`` or a sorted list; ``similarity`` one of ngram,
    levenshtein-ratio, jaro, jaro-winkler.  With ``'auto'`` the prototypes stay a
    table; the model's ``long`` form has no row as wide as they are many.
    """

    def __init__(self, column: str, output: str = "encoded", categories="auto", n_prototypes: int | None = None,
                 similarity: str = "ngram", ngram_range: tuple[int, int] = (2, 4), hashing_dim: int | None = None,
                 handle_unknown: str = "ignore", seed: int = 0, as_vector: bool = False):
        super().__init__()
        if handle_unknown not in ("error", "ignore"):
            raise ValueError(f"handle_unknown={handle_unknown!r}: allowed are 'error' and 'ignore'")
        if similarity not in ("ngram", "levenshtein-ratio", "jaro", "jaro-winkler"):
            raise ValueError(f"similarity={similarity!r}: allowed are ngram, levenshtein-ratio, jaro and jaro-winkler")
        if hashing_dim is not None and not isinstance(hashing_dim, int):
            raise ValueError(f"hashing_dim={hashing_dim!r}: allowed are None and whole numbers")
        if categories in ("most_frequent", "k-means") and not (isinstance(n_prototypes, int) and n_prototypes > 0):
            raise ValueError(f"n_prototypes={n_prototypes!r}: {categories} needs a whole number above 0")
        if not isinstance(categories, str) and sorted(categories) != list(categories):
            raise ValueError("categories must be given in sorted order")
        self.column, self.output, self.categories, self.n_prototypes = column, output, categories, n_prototypes
        self.similarity, self.ngram_range, self.hashing_dim = similarity, ngram_range, hashing_dim
        self.handle_unknown, self.seed, self.as_vector = handle_unknown, seed, as_vector

    def _prototypes(self, df: DataFrame) -> list[str]:
        if self.categories == "most_frequent":
            top = top_k_frequent(df.select(self.column).na.drop(), self.column, self.n_prototypes)
            return [r[0] for r in top.collect()]
        if self.categories == "k-means":
            return kmeans_prototypes(df, self.column, self.n_prototypes, seed=self.seed)
        return list(self.categories)

    def _fit(self, df: DataFrame) -> "SimilarityModel":
        if isinstance(self.categories, str) and self.categories == "auto":
            ids = dense_ids(df.select(F.col(self.column).alias("_proto")), "_proto", order="value", start=0, name="ord")
            return SimilarityModel(self, materialize(ids.select(F.col("ord").cast("int"), "_proto"), "prototypes"))
        ordered = df.sparkSession.createDataFrame(list(enumerate(self._prototypes(df))), "ord INT, _proto STRING")
        model = SimilarityModel(self, ordered)
        if not isinstance(self.categories, str) and self.handle_unknown == "error":
            check_known(df.select(self.column).na.drop(), model.known(df), self.column, "fit")
        return model


class SimilarityModel(Model):
    """Prototypes as a table (ord, _proto), ord running from 0."""

    def __init__(self, params: SimilarityEncoder, ordered: DataFrame):
        super().__init__()
        self.params_, self.ordered_ = params, ordered

    def save(self, path: str) -> None:
        """Write settings and prototypes below ``path``."""
        self.ordered_.write.mode("overwrite").parquet(f"{path}/prototypes")
        p = self.params_
        write_settings(self.ordered_.sparkSession, {
            "column": p.column, "output": p.output, "similarity": p.similarity, "ngram_range": list(p.ngram_range),
            "hashing_dim": p.hashing_dim, "handle_unknown": p.handle_unknown, "as_vector": p.as_vector}, f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SimilarityModel":
        settings = read_settings(spark, f"{path}/settings")
        settings["ngram_range"] = tuple(settings["ngram_range"])
        return cls(SimilarityEncoder(**settings), spark.read.parquet(f"{path}/prototypes"))

    @property
    def categories_(self) -> list[str]:
        return [r["_proto"] for r in self.ordered_.orderBy("ord").collect()]

    def known(self, df: DataFrame) -> DataFrame:
        return self.ordered_.select(F.col("_proto").alias(self.params_.column))

    def long(self, df: DataFrame) -> DataFrame:
        """(value, ord, similarity) of the pairs with a common n-gram, per distinct value."""
        p = self.params_
        lo, hi = p.ngram_range
        ordered = self.ordered_
        mine = gram_counts(df, p.column, lo, hi, p.hashing_dim)
        theirs = gram_counts(ordered, "_proto", lo, hi, p.hashing_dim).withColumnRenamed("cnt", "_cnt")
        same = mine.join(theirs, "gram").groupBy(p.column, "_proto").agg(
            F.sum(F.least("cnt", "_cnt")).alias("_same"))
        size = lambda c: ngram_count(preprocess(F.col(c)), lo, hi)
        score = F.try_divide(F.col("_same"), size(p.column) + size("_proto") - F.col("_same"))
        return same.join(ordered, "_proto").select(
            p.column, "ord", F.coalesce(score, F.lit(0.0)).alias("similarity"))

    def _dense(self, df: DataFrame) -> DataFrame:
        p, k = self.params_, self.ordered_.count()
        if p.similarity != "ngram":
            protos = F.array(*[F.lit(c) for c in self.categories_])
            metric = METRICS[p.similarity]
            return spread(df, p.column).withColumn(
                p.output, F.transform(protos, lambda c: metric(F.col(p.column), c)))
        found = self.long(df).groupBy(p.column).agg(
            F.map_from_entries(F.collect_list(F.struct("ord", "similarity"))).alias("_m"))
        values = df.select(p.column).na.drop().distinct().join(found, p.column, "left")
        empty = F.coalesce("_m", F.create_map().cast("map<int,double>"))
        dense = let(empty, lambda m: F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)) if k else F.array().cast("array<int>"), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))))
        return values.select(p.column, dense.alias(p.output))

    def _transform(self, df: DataFrame) -> DataFrame:
        p = self.params_
        if p.handle_unknown == "error":
            check_known(df.select(p.column).na.drop(), self.known(df), p.column, "transform")
        out = df.join(self._dense(df), p.column, "left")
        return out.withColumn(p.output, array_to_vector(p.output)) if p.as_vector else out


class TargetMeanEncoder(Estimator):
    """Shrunk mean target per category; one value per class with ``classes``.

    weight * E[y | x] + (1 - weight) * E[y] with weight = n_x / (n_x + n / k)
    for n rows in k categories.  Unknown categories get E[y], or raise; rows
    without a target are not learnt from.
    """

    def __init__(self, column: str, y: str, output: str = "encoded", classes: list | None = None,
                 handle_unknown: str = "ignore", as_vector: bool = False):
        super().__init__()
        if handle_unknown not in ("error", "ignore"):
            raise ValueError(f"handle_unknown={handle_unknown!r}: allowed are 'error' and 'ignore'")
        self.column, self.y, self.output, self.classes = column, y, output, classes
        self.handle_unknown, self.as_vector = handle_unknown, as_vector

    def _fit(self, df: DataFrame) -> "TargetMeanModel":
        known = df.where(F.col(self.y).isNotNull())
        stats = materialize(target_stats(known, self.column, self.y, self.classes), "target")
        means = [c for c in stats.columns if c not in (self.column, "n")]
        whole = stats.agg(F.sum("n"), F.count("*"), *[F.sum(F.col(m) * F.col("n")) / F.sum("n") for m in means]).first()
        n, k, prior = whole[0], whole[1], list(whole[2:])
        weight = F.col("n") / (F.col("n") + F.lit(n / k))
        codes = F.array(*[weight * F.col(m) + (1 - weight) * F.lit(p) for m, p in zip(means, prior)])
        return TargetMeanModel(self, stats.select(self.column, codes.alias(self.output)), prior)


class TargetMeanModel(Model):
    def __init__(self, params: TargetMeanEncoder, table: DataFrame, prior: list[float]):
        super().__init__()
        self.params_, self.table_, self.prior_ = params, table, prior

    def save(self, path: str) -> None:
        """Write settings and codes below ``path``."""
        p = self.params_
        self.table_.write.mode("overwrite").parquet(f"{path}/codes")
        write_settings(self.table_.sparkSession, {
            "params": {"column": p.column, "y": p.y, "output": p.output, "classes": p.classes,
                       "handle_unknown": p.handle_unknown, "as_vector": p.as_vector}, "prior": self.prior_}, f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TargetMeanModel":
        settings = read_settings(spark, f"{path}/settings")
        return cls(TargetMeanEncoder(**settings["params"]), spark.read.parquet(f"{path}/codes"), settings["prior"])

    def _transform(self, df: DataFrame) -> DataFrame:
        p = self.params_
        if p.handle_unknown == "error":
            check_known(df, self.table_, p.column, "transform")
        out = join_groups(df, self.table_, [p.column], "left").withColumn(
            p.output, F.coalesce(p.output, F.array(*[F.lit(x) for x in self.prior_])))
        if p.as_vector:
            return out.withColumn(p.output, array_to_vector(p.output))
        return out if p.classes else out.withColumn(p.output, F.element_at(p.output, 1))


def minhash(c: Column, n_components: int, ngram_range: tuple[int, int] = (2, 4), hashing: str = "fast",
            minmax: bool = False, hashed: Callable[[Column], Column] | None = None) -> Column:
    """Smallest (and largest) hash of the n-grams under each of several seeds.

    ``fast`` hashes the n-grams of the text as it is and gives integers,
    ``murmur`` those of the padded text and gives values in [0, 1].  Equal
    components of two texts are as likely as their n-gram Jaccard similarity. Batches of texts hash
    each distinct n-gram once where ``hashed`` is the portable hash.
    """
    sizes = range(ngram_range[0], ngram_range[1] + 1)
    # a 32-bit hash given instead is made once per n-gram and mixed with every seed
    own = (lambda x, s: F.hash(s, x)) if hashed is None else reseeded

    def pieces(text):
        grams = F.array_distinct(windows(text, *sizes))
        return grams if hashed is None else F.transform(grams, hashed)

    if hashing == "fast":
        if minmax and n_components % 2:
            raise ValueError(f"n_components={n_components}: pairs of smallest and largest need an even number")
        seeds = n_components // 2 if minmax else n_components
        if hashed is portable:
            return portable_least(c, sizes, seeds, minmax)
        low = let(pieces(c), lambda g: F.transform(
            F.sequence(F.lit(0), F.lit(seeds - 1)),
            lambda s: let(F.transform(g, lambda x: own(x, s)), lambda h: F.array(
                F.coalesce(F.array_min(h), F.lit(2**31 - 1)), F.coalesce(F.array_max(h), F.lit(-(2**31)))))))
        return F.flatten(low) if minmax else F.transform(low, lambda p: F.element_at(p, 1))
    if hashing != "murmur":
        raise ValueError(f"hashing={hashing!r}: allowed are 'fast' and 'murmur'")
    if minmax:
        raise ValueError("minmax=True needs hashing='fast'")
    text = F.when(F.trim(padded(c)) == "", F.lit(" Na ")).otherwise(c)
    top = 2**32 - 1 if hashed is None else 2**31 - 2
    if hashed is portable:
        return F.transform(portable_least(padded(text), sizes, n_components), lambda x: F.when(x != NONE[0], x) / F.lit(top))
    return let(pieces(padded(text)), lambda g: F.transform(
        F.sequence(F.lit(0), F.lit(n_components - 1)),
        lambda s: F.array_min(F.transform(g, lambda x: F.pmod(own(x, s).cast("bigint"), F.lit(2**32)))) / F.lit(top)))


class MinHashEncoder(Transformer):
    """Min-hash columns of a text column; stateless, row by row, null for null."""

    def __init__(self, column: str, n_components: int, output: str = "encoded", **options):
        super().__init__()
        self.column, self.output, self.n_components, self.options = column, output, n_components, options

    def _transform(self, df: DataFrame) -> DataFrame:
        text = F.col(self.column)
        return df.withColumn(self.output, F.when(text.isNotNull(), minhash(text, self.n_components, **self.options)))

    def long(self, df: DataFrame, place: str = "place", value: str = "hash") -> DataFrame:
        """(text, place, hash): a row per component of every distinct non-null value.

        The outer explode matters: an inner one asks for arrays that are not empty, and that
        filter, with all hashes in it, would be pushed down to the rows before they are distinct.
        """
        encoded = self.transform(spread(df, self.column))
        return encoded.select(self.column, F.posexplode_outer(self.output).alias(place, value))


def minhash_candidates(df: DataFrame, column: str, bands: int = 10, rows: int = 2, ngram_range: tuple[int, int] = (3, 3),
                       hashed: Callable[[Column], Column] | None = None) -> DataFrame:
    """(value, representative, agreement): groups of near-duplicate spellings by min-hash.

    Values that share a band of hashes belong together, directly or over other values; the
    representative is the smallest value of the group.  No pair is lost and none is listed:
    each member of a band is only linked with its smallest one.  ``agreement`` is the share
    of hashes equal to the representative's, an estimate of their n-gram Jaccard similarity;
    ``pairs.similarity_join`` scores pairs.
    """
    signed = materialize(spread(df, column).select(
        F.col(column).alias("value"), minhash(F.col(column), bands * rows, ngram_range, hashed=hashed).alias("_h")), "minhash")
    keys = F.array(*[F.struct(F.lit(b).alias("band"), F.slice("_h", b * rows + 1, rows).alias("hashes")) for b in range(bands)])
    members = signed.select("value", F.explode(keys).alias("_k"))
    first = members.groupBy("_k").agg(F.min("value").alias("representative"), F.count("*").alias("_n")).where("_n > 1")
    met = members.join(first, "_k").where("value <> representative").select("value", "representative")
    found = components(met, "value", "representative").select(F.col("node").alias("value"), F.col("root").alias("representative"))
    both = found.join(signed, "value").join(
        signed.select(F.col("value").alias("representative"), F.col("_h").alias("_r")), "representative")
    equal = F.size(F.filter(F.zip_with("_h", "_r", lambda x, y: x == y), lambda z: z)) / F.lit(bands * rows)
    return both.select("value", "representative", equal.alias("agreement"))


def ngram_similarity_hashed(df: DataFrame, column: str, prototypes: list[str], ngram_range: tuple[int, int],
                            hashing_dim: int, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(value, proto, similarity) on hashed gram counts; no vocabulary is kept."""
    spark = df.sparkSession
    protos = spark.createDataFrame([(p,) for p in prototypes], "proto STRING")
    mine = gram_counts(df, column, *ngram_range, hashing_dim, hashed)
    theirs = gram_counts(protos, "proto", *ngram_range, hashing_dim, hashed).withColumnRenamed("cnt", "_cnt")
    same = mine.join(theirs, "gram").groupBy(column, "proto").agg(
        F.sum(F.least("cnt", "_cnt")).alias("_same"))
    nx = mine.groupBy(column).agg(F.sum("cnt").alias("_nx"))
    np_ = theirs.groupBy("proto").agg(F.sum("_cnt").alias("_np"))
    return same.join(nx, column).join(np_, "proto").select(
        column, "proto", (F.col("_same") / (F.col("_nx") + F.col("_np") - F.col("_same"))).alias("similarity"))


def count_ngrams(df: DataFrame, column: str, ngram_range: tuple[int, int] = (2, 4),
                 hashing_dim: int | None = None, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Vocabulary (or bucket) counts over all rows: values are cut once, then weighted."""
    sizes = value_counts(df.select(column).na.drop(), column)
    return gram_counts(df, column, *ngram_range, hashing_dim, hashed).join(sizes, column).groupBy("gram").agg(
        F.sum(F.col("cnt") * F.col("n")).alias("n"))


def words_of(c: Column) -> Column:
    """Lower-case words of two or more characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\b\w\w+\b)"), 1)


def count_words(df: DataFrame, column: str) -> DataFrame:
    sizes = value_counts(df.select(column).na.drop(), column)
    return sizes.select(F.explode(words_of(F.col(column))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))


def cluster_titles(vectors: DataFrame, key: str, vec: str, n_clusters: int, method: str = "kmeans",
                   seed: int = 0, max_iter: int = 20) -> DataFrame:
    """(key, label): titles grouped by the direction of their vectors.

    ``kmeans`` on unit vectors or ``bisecting`` for a hierarchy.  Labels are
    drawn from the seed so that near labels do not mean near titles.  Titles
    without a vector share the label 0.
    """
    unit = Normalizer(p=2.0, inputCol="_r", outputCol="_f").transform(
        vectors.where(F.col(vec).isNotNull()).select(key, array_to_vector(vec).alias("_r")))
    blank = vectors.where(F.col(vec).isNull()).select(key, F.lit(0).alias("label"))
    kind = KMeans if method == "kmeans" else BisectingKMeans
    model = kind(k=n_clusters, seed=seed, maxIter=max_iter, featuresCol="_f", predictionCol="_c").fit(unit)
    labels = F.array(*[F.lit(int(c) + 1) for c in np.random.RandomState(seed).permutation(n_clusters)])
    return model.transform(unit).select(key, F.element_at(labels, F.col("_c") + 1).alias("label")).unionByName(blank)


def rbf_features(df: DataFrame, vec: str, n_components: int, gamma: float, seed: int = 42,
                 output: str = "features") -> DataFrame:
    """Random Fourier features of a vector column: cos(x W + b) * sqrt(2 / D).

    The random matrix is drawn from the seed inside each task, so its size
    (dimensions x components) is all that any task holds. Rows without a vector, or with a null
    in it, have null features.
    """
    @F.pandas_udf("array<double>")
    def project(column: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(column), dtype=object)
        known = column.notna().to_numpy()
        if not known.any():
            return out
        x = np.stack(column[known].to_numpy()).astype(float)
        rng = np.random.RandomState(seed)
        w = np.sqrt(2 * gamma) * rng.normal(size=(x.shape[1], n_components))
        b = rng.uniform(0, 2 * np.pi, size=n_components)
        out[known] = pd.Series(list(np.sqrt(2.0 / n_components) * np.cos(x @ w + b)), index=out.index[known])
        return out

    return df.withColumn(output, project(F.when(usable(F.col(vec)), F.col(vec))))

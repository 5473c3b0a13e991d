"""Exact joins and nearest neighbours on embedding columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motley.functions.hashing import seeded
from motley.functions.vectors import l2_norm, l2_normalize, usable
from motley.operators.joins import join_groups
from motley.workdir import materialize


def embed_titles(titles: DataFrame, column: str, words: DataFrame, name: str = "vector") -> DataFrame:
    """(title, vector): mean of the unit vectors of its words, per distinct title.

    ``words`` holds (word, vector).  A title without any known word has a null vector.
    """
    distinct = titles.select(column).na.drop().distinct()
    tokens = distinct.select(
        column, F.explode(F.split(F.trim(column), r"(?U)\s+")).alias("word"))
    unit = words.select("word", array_to_vector(l2_normalize(F.col("vector"))).alias("_v"))
    known = tokens.join(unit, "word").groupBy(column).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias(name))
    return distinct.join(known, column, "left")


def with_itself(similar: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """``similar`` (key, other, cos) with a pair (x, x, 1.0) for every x of ``df`` it lacks, null included."""
    known = similar.where(F.col(key).eqNullSafe(F.col("other"))).select(key)
    lacking = join_groups(df.select(key).distinct(), known, [key], "left_anti")
    return similar.select(key, "other", "cos").unionByName(
        lacking.select(key, F.col(key).alias("other"), F.lit(1.0).alias("cos")))


# The rotation comes from a sample of fixed size. There are at most so many pivots, of a few numbers each.
_SAMPLE, _MOST_PIVOTS = 2_048, 65_536


def _rotation(unit: DataFrame, key: str) -> np.ndarray:
    """Orthogonal matrix whose first columns are the directions that vary most.

    Any rotation leaves cosines as they are, so a sample decides nothing but the pruning.
    """
    rows = unit.orderBy(seeded(F.col(key), 17), key).limit(_SAMPLE).select("_u").collect()
    x = np.array([r["_u"] for r in rows])
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


def _leading(unit: DataFrame, key: str, lead: int) -> DataFrame:
    """Unit vectors with their leading components and the length of the rest."""
    axes = _rotation(unit, key)[:, :lead]

    def rotate(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["_u"].to_numpy())
            front = x @ axes
            rest = np.sqrt(np.maximum((x * x).sum(axis=1) - (front * front).sum(axis=1), 0))
            yield pdf.assign(_front=list(front), _rest=rest)

    schema = T.StructType([*unit.schema, T.StructField("_front", T.ArrayType(T.DoubleType())),
                           T.StructField("_rest", T.DoubleType())])
    return materialize(unit.mapInPandas(rotate, schema), "leading")


def _in_cells(leading: DataFrame, key: str, n_cells: int) -> tuple[DataFrame, np.ndarray]:
    """Tag every vector with the cell of its nearest pivot, a k-means centre of the leading components."""
    n_cells = min(n_cells, _MOST_PIVOTS)
    some = leading.orderBy(seeded(F.col(key), 19), key).limit(64 * n_cells).select(array_to_vector("_front").alias("_f"))
    pivots = np.array(KMeans(k=n_cells, seed=1, maxIter=4, initSteps=2, featuresCol="_f").fit(some).clusterCenters())
    half = (pivots * pivots).sum(axis=1) / 2

    def assign(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            front = np.stack(pdf["_front"].to_numpy())
            best = np.concatenate([(front[a:a + 1024] @ pivots.T - half).argmax(axis=1) for a in range(0, len(front), 1024)])
            away = np.sqrt(((front - pivots[best]) ** 2).sum(axis=1))
            yield pdf.drop(columns="_front").assign(_cell=best.astype("int32"), _away=away)

    schema = T.StructType([f for f in leading.schema if f.name != "_front"] + [
        T.StructField("_cell", T.IntegerType()), T.StructField("_away", T.DoubleType())])
    return materialize(leading.mapInPandas(assign, schema), "cells"), pivots


def _cell_pairs(stats: DataFrame, pivots: np.ndarray, threshold: float, block_rows: int) -> DataFrame:
    """(a, na, b, nb): pairs of cells that may hold a pair above the threshold, with their numbers of blocks.

    Unit vectors are that near only if |x - y|^2 < 2 - 2 t. Their leading parts are at least
    as far apart as their pivots less the radii of the cells, the rest as far as the lengths.
    """
    cells = stats.orderBy("_cell").toPandas()  # a row per pivot
    name, centre = cells["_cell"].to_numpy(), pivots[cells["_cell"].to_numpy()]
    radius, lo, hi = (cells[c].to_numpy() for c in ("radius", "lo", "hi"))
    blocks = np.ceil(cells["n"].to_numpy() / block_rows).astype("int32")
    limit = 2 - 2 * threshold + 1e-9

    def near(batches):
        for pdf in batches:
            for i in pdf["i"]:
                apart = np.sqrt(((centre[i:] - centre[i]) ** 2).sum(axis=1))
                front = np.maximum(apart - radius[i] - radius[i:], 0)
                rest = np.maximum(np.maximum(lo[i] - hi[i:], lo[i:] - hi[i]), 0)
                j = np.flatnonzero(front * front + rest * rest <= limit) + i
                yield pd.DataFrame({"a": name[i], "na": blocks[i], "b": name[j], "nb": blocks[j]})

    spark = stats.sparkSession
    slots = max(1, min(len(name), spark.sparkContext.defaultParallelism * 4))
    numbers = spark.range(0, len(name), 1, slots).select(F.col("id").cast("int").alias("i"))
    return numbers.mapInPandas(near, "a int, na int, b int, nb int")


def similar_pairs(vectors: DataFrame, key: str, vec: str, threshold: float, block_rows: int = 2048,
                  cell_rows: int = 2048, lead: int = 32) -> DataFrame:
    """(key, other, cos) for all ordered pairs with cosine > threshold, itself included.

    Vectors are rotated to their main directions and cut into cells around pivots among the
    ``lead`` first of these, one per ``cell_rows`` vectors, and large cells into blocks
    of about ``block_rows``. Only block pairs that the bound of ``_cell_pairs`` cannot rule
    out are scored, each as one bounded matrix product. Exact for every threshold; hot cells
    become many blocks, not one large task. A key whose vector is null or zero only has the
    pair with itself.
    """
    unit = materialize(
        vectors.where(l2_norm(F.col(vec)) > 0).select(F.col(key), l2_normalize(F.col(vec)).alias("_u")), "unit")
    rows = unit.count()
    blank = vectors.where(F.col(key).isNotNull() & ~F.coalesce(l2_norm(F.col(vec)) > 0, F.lit(False))).select(
        key, F.col(key).alias("other"), F.lit(1.0).alias("cos"))
    if not rows:
        return blank
    n_cells = math.ceil(rows / cell_rows)
    if n_cells == 1:
        cells, pivots = unit.withColumns({"_rest": F.lit(1.0), "_cell": F.lit(0), "_away": F.lit(0.0)}), np.zeros((1, 1))
    else:
        cells, pivots = _in_cells(_leading(unit, key, lead), key, n_cells)
    stats = materialize(cells.groupBy("_cell").agg(
        F.count("*").alias("n"), F.max("_away").alias("radius"), F.min("_rest").alias("lo"), F.max("_rest").alias("hi")), "stats")
    parts = stats.select("_cell", F.ceil(F.col("n") / block_rows).cast("int").alias("_parts"))
    blocks = cells.join(parts, "_cell").withColumn(
        "_chunk", F.pmod(seeded(F.col(key), 23), F.col("_parts")).cast("int")).select(key, "_u", "_cell", "_chunk")
    # a row per pair of cells that may meet, spread into chunk pairs by the executors
    plan = (
        _cell_pairs(stats, pivots, threshold, block_rows)
        .withColumn("ca", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
        .withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .where((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb")))
        .select("a", "ca", "b", "cb")
    )
    itself = (F.col("a") == F.col("b")) & (F.col("ca") == F.col("cb"))
    first = blocks.join(plan, (blocks._cell == plan.a) & (blocks._chunk == plan.ca)).withColumn(
        "_side", F.when(itself, 2).otherwise(0))
    second = blocks.join(plan.where(~itself), (blocks._cell == F.col("b")) & (blocks._chunk == F.col("cb"))).withColumn(
        "_side", F.lit(1))
    keep = ["a", "ca", "b", "cb", "_side", key, "_u"]
    kind = dict(vectors.dtypes)[key]

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["_side"].to_numpy()
        left, right = pdf[side != 1], pdf[side != 0]
        if left.empty or right.empty:
            return pd.DataFrame({key: [], "other": [], "cos": []})
        cos = np.stack(left["_u"].to_numpy()) @ np.stack(right["_u"].to_numpy()).T
        i, j = np.nonzero(cos > threshold)
        x, y, c = left[key].to_numpy()[i], right[key].to_numpy()[j], cos[i, j]
        if side[0] == 2:
            return pd.DataFrame({key: x, "other": y, "cos": c})
        return pd.DataFrame({key: np.r_[x, y], "other": np.r_[y, x], "cos": np.r_[c, c]})

    found = first.select(*keep).unionByName(second.select(*keep)).groupBy("a", "ca", "b", "cb").applyInPandas(
        score, f"`{key}` {kind}, other {kind}, cos double")
    return found.unionByName(blank)


def kernel_weight(threshold: float):
    """Triangular kernel on the cosine: 0 at the threshold, 1 at equality."""
    a, b = 1 / (1 - threshold), -threshold / (1 - threshold)
    return F.greatest(F.lit(a) * F.col("cos") + F.lit(b), F.lit(0.0))


def _distances(points: np.ndarray, batch: np.ndarray) -> np.ndarray:
    """Euclidean distances (points x batch), by differences for exact zeros."""
    return np.stack([np.sqrt(((batch - p) ** 2).sum(axis=1)) for p in points])


def knn_values(vectors: DataFrame, key: str, vec: str, queries: list[tuple[str, list[float]]], k: int) -> DataFrame:
    """(query, value, dist, rank): the k rows nearest to each given point.

    ``queries`` is a short driver-side list.  Each partition keeps its k best
    per point, so only k rows per point and partition are shuffled. Rows without a vector, with a
    null in it, or of another size than the points take no part.
    """
    names = [q for q, _ in queries]
    points = np.array([p for _, p in queries], dtype=float)
    kind = dict(vectors.dtypes)[key]

    def best(batches):
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if pdf.empty:
                continue
            dist = _distances(points, np.stack(pdf[vec].to_numpy()).astype(float))
            for q, row in enumerate(dist):
                held.append(pd.DataFrame({"query": names[q], "value": pdf[key].to_numpy(), "dist": row}))
            both = pd.concat(held).sort_values(["query", "dist", "value"])
            held = [both.groupby("query").head(k)]
        yield from held

    known = vectors.select(key, F.col(vec).cast("array<double>").alias(vec)).where(usable(F.col(vec), points.shape[-1]))
    found = known.mapInPandas(best, f"query string, value {kind}, dist double")
    order = Window.partitionBy("query").orderBy("dist", "value")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_prototype(vectors: DataFrame, key: str, vec: str, centers: list[list[float]]) -> DataFrame:
    """(center, value, dist): the row nearest to each of a few centres."""
    named = [(str(i), list(map(float, c))) for i, c in enumerate(centers)]
    return knn_values(vectors, key, vec, named, 1).select(
        F.col("query").cast("int").alias("center"), "value", "dist")

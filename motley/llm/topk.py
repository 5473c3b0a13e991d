"""Exact top-k search: tiles of queries times shards of rows, merged query by query.

Vectors become integers. Rows are cut into shards and the stated queries into blocks of
bounded size; each block meets each shard once in one task, which multiplies them tile by
tile and keeps k per query. The kept lists are merged by Spark in a tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motley.workdir import materialize

SHARD, BLOCK, TILE, CHUNK = 8_192, 16_384, 4_096, 512
FAN_IN = 32
_EXACT = 2.0 ** 53


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component as double; null if the vector or a component is unusable."""
    as_double = vector.cast("array<double>")
    bad = F.exists(as_double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(bad | vector.isNull(), None).otherwise(F.transform(as_double, lambda x: F.floor(x * scale)))


def _numbered(df: DataFrame, size: int) -> tuple[DataFrame, int]:
    """The written rows with their position ``at``, ``part``, of about ``size`` rows each, and the number of parts.

    Parts are dealt by row position, so repeated rows and hot ids spread like any others.
    """
    kept = materialize(df.withColumn("at", F.monotonically_increasing_id()), "vectors")
    parts = max(1, -(-kept.count() // size))
    return kept.withColumn("part", F.pmod("at", F.lit(parts))), parts


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py():column.offsets[-1].as_py()]
    out = np.zeros((len(column), width), dtype=np.int64)
    if len(flat):
        out[np.repeat(np.arange(len(column)), sizes),
            np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where every sum is a whole number it can hold."""
    most = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(rows.astype(float)).max(initial=0)) * max(1, rows.shape[1])
    if most < 2.0 ** 24:
        return (queries.astype(np.float32) @ rows.astype(np.float32).T).astype(np.float64)
    if most < _EXACT / TILE:
        return queries.astype(np.float64) @ rows.astype(np.float64).T
    exact = queries.astype(object) @ rows.astype(object).T
    if exact.size and max(abs(int(exact.max())), abs(int(exact.min()))) >= 2 ** 63:
        raise OverflowError("an inner product does not fit into 64 bits")
    return exact


def _best(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query the columns of its k highest scores, ties to the earlier column, and a mask of real ones."""
    n, width = scores.shape
    if scores.dtype == object:
        order = np.array([sorted(np.flatnonzero(~own[i]), key=lambda j, r=scores[i]: (-r[j], j))[:k]
                          + [-1] * max(0, k - int((~own[i]).sum())) for i in range(n)], dtype=np.int64).reshape(n, -1)
        return np.maximum(order, 0), order >= 0
    ranked = scores * width + (width - 1 - np.arange(width))
    ranked[own] = -np.inf
    k = min(k, width)
    columns = np.argpartition(-ranked, k - 1, axis=1)[:, :k] if k < width else np.tile(np.arange(width), (n, 1))
    return columns, np.take_along_axis(ranked, columns, axis=1) > -np.inf


def _search(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of one shard for each query of one block."""
    empty = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]).empty_table()
    if not len(queries) or not len(rows):
        return empty
    rows = rows.combine_chunks().sort_by("id")
    queries = queries.combine_chunks()
    qv, rv = (t.column("v").combine_chunks() for t in (queries, rows))
    width = max(int(np.diff(c.offsets.to_numpy()).max(initial=0)) for c in (qv, rv))
    q, r = _matrix(qv, width), _matrix(rv, width)
    q_key, q_id, q_row = (queries.column(c).to_numpy() for c in ("q", "id", "row"))
    ids, places = (rows.column(c).to_numpy() for c in ("id", "at"))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(r), TILE):
        tile, tile_ids = r[lo:lo + TILE], ids[lo:lo + TILE]
        for top in range(0, len(q), CHUNK):
            part = slice(top, top + CHUNK)
            scores = _products(q[part], tile)
            own = np.zeros(scores.shape, dtype=bool)
            first, last = (np.searchsorted(tile_ids, q_id[part], side) for side in ("left", "right"))
            for i in np.flatnonzero(first < last):
                own[i, first[i]:last[i]] = places[lo + first[i]:lo + last[i]] == q_row[top + i]
            columns, real = _best(scores, own, k)
            values = np.take_along_axis(scores, columns, axis=1)
            where = np.nonzero(real)
            found.append((q_key[part][where[0]], tile_ids[columns[where]], values[where].astype(np.int64)))
    q_out, ids_out, scores_out = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids_out, -scores_out, q_out))
    q_out, ids_out, scores_out = q_out[order], ids_out[order], scores_out[order]
    start = np.flatnonzero(np.r_[True, q_out[1:] != q_out[:-1]]) if len(q_out) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(q_out)) - np.repeat(start, np.diff(np.r_[start, len(q_out)]))
    keep = rank < k
    return pa.table({"q": q_out[keep], "vec_id": ids_out[keep], "score": scores_out[keep]}, schema=empty.schema)


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row whose id ``every`` divides.

    Scores are inner products of floor(scale * x); ties go to the smaller id. A query meets
    every row but its own. Fewer than k other rows give fewer ranks. Rows with a null
    id, and vectors that are null or hold a null, NaN or infinite component, take no part.
    Shorter vectors count as if filled with zeros. Rows that repeat an id are rows like any
    others: each is a query with a list of its own, and a candidate of the others. Rows that repeat
    the vector too are searched once. Components beyond 64 bits count as the nearest 64-bit
    integer; a product beyond 64 bits stops the search with an OverflowError.
    An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"))
    rows, shards = _numbered(rows.where("id IS NOT NULL AND v IS NOT NULL"), SHARD)
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id", "v").agg(F.min("at").alias("row"), F.count("*").alias("copies"))
    asked, blocks = _numbered(asked, BLOCK)
    asked = asked.withColumnRenamed("at", "q")

    def spread(df, name, other, n):  # pairs blocks of the stated queries with shards, not rows with rows
        return df.withColumnRenamed("part", name).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    left = spread(asked.drop("copies"), "block", "shard", shards)
    right = spread(rows, "shard", "block", blocks)
    parts = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(
        lambda a, b: _search(a, b, k), "q bigint, vec_id bigint, score bigint")
    order = [F.col("score").desc(), F.col("vec_id")]
    if shards > FAN_IN:
        parts = parts.withColumn("fan", F.pmod(F.xxhash64("vec_id"), F.lit(shards // FAN_IN)))
        near = Window.partitionBy("q", "fan").orderBy(*order)
        parts = parts.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k).drop("n")
    last = Window.partitionBy("q").orderBy(*order)
    best = parts.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    each = asked.select("q", F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return best.join(each, "q").select("query_id", "rank", "vec_id", "score")


def oracle() -> str:
    """The same rows in DuckDB SQL over the table ``embeddings``."""
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS z
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.z AS DOUBLE[]), CAST(c.z AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20"""

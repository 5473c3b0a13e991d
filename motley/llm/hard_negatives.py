"""Hard negatives by anchor-clustered shared lists with certified termination.

Anchors are clustered by direction. For a cluster of which no member is further than an angle
t from its centre, a row of norm n at angle w from the centre has an inner product of at most
|anchor| * n * cos(max(0, w - t)) with every member. So the rows of a shard are sorted by
n * cos(max(0, w - t)) once, and every member walks this one list, tile by tile, until its
bound at the next tile is below what the member has already found: nothing later can count.

Rows are sharded by the same centres, so that the same bound, taken over a whole shard, rules
out shards before their rows are moved. Positives come first from the shards of the cluster's
own centre, then from those that may still beat them; negatives from all that may reach half
of the weakest positive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motley.llm.common import Tables
from motley.llm.topk import quantised

SHARD, BLOCK, TILE = 8_192, 1_024, 512
SAMPLE, CENTRES, ROUNDS = 4_096, 64, 5
PER_CENTRE = 64
POSITIVES, NEGATIVES = 5, 3
_ANGLE, _SHARE = 1e-6, 1e-9  # more than what rounding can move an angle, and a product in proportion
_NONE = np.iinfo(np.int64).min


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, cut or filled with zeros to a width."""
    out = np.zeros((len(column), width), dtype=np.int64)
    if not len(column):
        return out
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    row, place = np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = place < width
    out[row[kept], place[kept]] = flat[kept]
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products; one beyond 64 bits counts as the nearest 64-bit integer."""
    most = float(np.abs(left.astype(float)).max(initial=0)) * float(np.abs(right.astype(float)).max(initial=0)) * max(1, left.shape[1])
    if most < 2.0 ** 24:
        return (left.astype(np.float32) @ right.astype(np.float32).T).astype(np.int64)
    if most < 2.0 ** 53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    exact = left.astype(object) @ right.astype(object).T
    return np.clip(exact, -2 ** 63 + 1, 2 ** 63 - 1).astype(np.int64)


def angles(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angle of each vector to a unit centre, and its norm; 0 where either has no direction."""
    values = vectors.astype(np.float64)
    norms = np.sqrt((values * values).sum(axis=1))
    if not centre.any():
        return np.zeros(len(values)), norms
    cosine = np.divide(values @ centre, norms, out=np.ones(len(values)), where=norms > 0)
    return np.arccos(np.clip(cosine, -1, 1)), norms


def centres_of(sample: np.ndarray) -> np.ndarray:
    """Unit centres of a bounded sample by a few rounds of k-means on directions."""
    values = sample.astype(np.float64)
    norms = np.sqrt((values * values).sum(axis=1, keepdims=True))
    values = (values / np.where(norms > 0, norms, 1))[norms[:, 0] > 0]
    if not len(values):
        return np.zeros((1, sample.shape[1]))
    count = min(CENTRES, -(-len(values) // PER_CENTRE))
    centres = values[np.linspace(0, len(values) - 1, count).astype(int)]
    for _ in range(ROUNDS):
        nearest = (values @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, values)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 1e-12, sums / np.where(length > 0, length, 1), centres)
    return centres


def _assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """The rows with the number of the nearest centre, the angle to it and the norm."""
    width = centres.shape[1]

    def run(batches):
        for batch in batches:
            column = batch.column("v")
            wide = matrix(column, max(width, int(np.diff(column.offsets.to_numpy()).max(initial=0))))
            nearest = (wide[:, :width].astype(np.float64) @ centres.T).argmax(axis=1)
            angle, norm = np.zeros(len(wide)), np.zeros(len(wide))
            for c in np.unique(nearest):
                of = nearest == c
                angle[of], norm[of] = angles(wide[of], np.r_[centres[c], np.zeros(wide.shape[1] - width)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest), pa.array(angle), pa.array(norm)],
                                             names=[*batch.schema.names, "centre", "angle", "norm"])

    return rows.mapInArrow(run, "id bigint, label bigint, v array<bigint>, at bigint, centre bigint, angle double, norm double")


def _cut(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows with a part number; parts hold rows of one centre, about ``size`` at most, dealt by position."""
    sizes = dict(rows.groupBy("centre").count().collect())  # one row per centre
    number, base = None, 0
    for centre, count in sorted(sizes.items()):
        parts = -(-count // size)
        one = F.lit(base) + F.pmod(F.xxhash64("at"), F.lit(parts))
        number = F.when(F.col("centre") == centre, one) if number is None else number.when(F.col("centre") == centre, one)
        base += parts
    return rows.withColumn(name, (number if number is not None else F.lit(0)).cast("long"))


class _Best:
    """The k best (score, id) of each walker, higher scores first, ties to the smaller id."""

    def __init__(self, walkers: int, k: int, least: np.ndarray | None = None):
        """``least`` is a score that each walker's k-th is known to reach, if any."""
        self.k = k
        self.who, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.least = np.full(walkers, _NONE) if least is None else least.copy()

    def add(self, walkers: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """A tile of scores, ``_NONE`` where a row does not count."""
        width = scores.shape[1]
        floor = np.partition(scores, width - self.k, axis=1)[:, width - self.k] if width > self.k else np.full(len(scores), _NONE)
        floor = np.maximum(floor, self.least[walkers])
        at, column = np.nonzero((scores >= floor[:, None]) & (scores > _NONE))
        if not len(at):
            return
        who, score, own = (np.concatenate(x) for x in zip((self.who, self.score, self.id),
                                                          (walkers[at], scores[at, column], ids[column])))
        order = np.lexsort((own, -score, who))
        who, score, own = who[order], score[order], own[order]
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        rank = np.arange(len(who)) - np.repeat(starts, np.diff(np.r_[starts, len(who)]))
        kept = rank < self.k
        self.who, self.score, self.id = who[kept], score[kept], own[kept]
        full = rank[kept] == self.k - 1
        self.least[self.who[full]] = np.maximum(self.least[self.who[full]], self.score[full])


def _walk(anchors: dict, rows: dict, centre: np.ndarray, visit, done) -> int:
    """Let every anchor walk the shared list until ``done`` says so; the number of tiles they looked at."""
    width = max(anchors["v"].shape[1], rows["v"].shape[1], len(centre))
    wide = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
    own, other, centre = wide(anchors["v"]), wide(rows["v"]), np.pad(centre, (0, width - len(centre)))
    spread, length = angles(own, centre)
    angle, norm = angles(other, centre)
    reach = norm * (np.cos(np.maximum(0, angle - spread.max(initial=0) - _ANGLE)) + _SHARE)
    order = np.lexsort((rows["id"], -reach))
    other, reach, ids, labels = other[order], reach[order], rows["id"][order], rows["label"][order]
    active, looked = np.arange(len(own)), 0
    for lo in range(0, len(other), TILE):
        bound = length[active] * reach[lo]  # and a little more, for rounding; scores are whole numbers
        active = active[~done(active, bound + np.abs(bound) * _SHARE + 0.5)]
        if not len(active):
            break
        tile = slice(lo, lo + TILE)
        scores = products(own[active], other[tile])
        visit(active, scores, labels[tile][None, :] == anchors["label"][active][:, None], ids[tile])
        looked += len(active)
    return looked


def _columns(table: pa.Table, *more: str) -> dict:
    table = table.combine_chunks()
    column = table.column("v").combine_chunks() if len(table) else pa.array([], pa.list_(pa.int64()))
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    sizes = np.diff(column.offsets.to_numpy())
    found = {"v": matrix(column, int(sizes.max(initial=0)))}
    return found | {n: table.column(n).to_numpy() for n in ("id", "label", *more)}


def _positives(anchors: pa.Table, rows: pa.Table, centres: np.ndarray, k: int) -> pa.Table:
    """(q, row_id, score): the k best rows of one shard with the anchor's label that may be among its best of all."""
    schema = pa.schema([("q", pa.int64()), ("row_id", pa.int64()), ("score", pa.int64())])
    if not len(anchors) or not len(rows):
        return schema.empty_table()
    own, other = _columns(anchors, "q", "least"), _columns(rows)
    best = _Best(len(own["q"]), k, own["least"])

    def visit(active, scores, same, ids):
        best.add(active, np.where(same & (ids[None, :] != own["id"][active][:, None]), scores, _NONE), ids)

    _walk(own, other, centres[anchors.column("centre")[0].as_py()], visit, lambda active, bound: best.least[active] > bound)
    return pa.table([own["q"][best.who], best.id, best.score], schema=schema)


def bands(score: int) -> tuple[int, int]:
    """Least and greatest whole negative score n with 50 * score <= 100 * n <= 95 * score."""
    return -(-score // 2), 19 * score // 20


def _negatives(anchors: pa.Table, rows: pa.Table, centres: np.ndarray, k: int) -> pa.Table:
    """(q, p, row_id, score): the k best rows of one shard with another label in the band of each positive."""
    schema = pa.schema([("q", pa.int64()), ("p", pa.int32()), ("row_id", pa.int64()), ("score", pa.int64())])
    if not len(anchors) or not len(rows):
        return schema.empty_table()
    own, other = _columns(anchors, "q"), _columns(rows)
    lists = anchors.column("scores").to_pylist()
    most = max(map(len, lists))
    low, high = np.full((len(lists), most), np.iinfo(np.int64).max), np.full((len(lists), most), _NONE)
    for i, scores in enumerate(lists):
        for p, score in enumerate(scores):
            if score >= 0:  # below zero the band is empty
                low[i, p], high[i, p] = bands(score)
    best = _Best(len(lists) * most, k)

    def visit(active, scores, same, ids):
        for p in range(most):
            fits = ~same & (scores >= low[active, p][:, None]) & (scores <= high[active, p][:, None])
            best.add(active * most + p, np.where(fits, scores, _NONE), ids)

    def done(active, bound):
        least = best.least.reshape(-1, most)[active]
        return (np.maximum(least, low[active] - 1) > bound[:, None] - (least < low[active])).all(axis=1)

    _walk(own, other, centres[anchors.column("centre")[0].as_py()], visit, done)
    return pa.table([own["q"][best.who // most], (best.who % most).astype(np.int32), best.id, best.score], schema=schema)


def _visited(anchors: DataFrame, rows: DataFrame, pairs: DataFrame, found, schema: str) -> DataFrame:
    """What ``found`` makes of every wanted pair of a block of anchors and a shard of rows."""
    left = anchors.join(pairs, "block").groupBy("block", "shard")
    right = rows.select("shard", "id", "label", "v").join(pairs, "shard").groupBy("block", "shard")
    return left.cogroup(right).applyInArrow(found, schema)


def mine(vectors: DataFrame, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label", scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id ``every`` divides; scores are inner products of
    floor(scale * x). Positives are an anchor's best other rows with its label; for each of them
    come the best rows with another label that score between 50 and 95 per cent of it. Ties go
    to the smaller id.

    Rows with a null id, label or vector, or a null, NaN or infinite component, take no part.
    Rows that repeat id, label and vector are one row. An id with several vectors or labels is
    several rows, none of which is another's positive. Shorter vectors count as filled with
    zeros, components and scores beyond 64 bits as the nearest 64-bit integer. An anchor without
    positives, and a positive without negatives, give no rows, nor does an empty table; other
    columns are not read. The centres come from at most ``SAMPLE`` anchors, chosen by a hash;
    they decide how much is looked at, not what is found.
    """
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession, "negatives")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                          quantised(F.col(vector_col), scale).alias("v"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").dropDuplicates(["id", "label", "v"])
    rows = tables.write(rows.withColumn("at", F.monotonically_increasing_id()), "rows")
    is_anchor = F.pmod("id", F.lit(every)) == 0
    sample = rows.where(is_anchor).orderBy(F.xxhash64("id", "at")).limit(SAMPLE).select("v").toArrow()
    column = sample.column("v").combine_chunks() if len(sample) else pa.array([], pa.list_(pa.int64()))
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    centres = centres_of(matrix(column, max(1, int(np.diff(column.offsets.to_numpy()).max(initial=0)))))
    placed = tables.write(_assigned(rows, centres), "placed")
    tables.drop("rows")
    shards = tables.write(_cut(placed, SHARD, "shard"), "shards")
    anchors = tables.write(_cut(placed.where(is_anchor), BLOCK, "block").withColumnRenamed("at", "q")
                           .select("block", "q", "id", "label", "v", "centre", "angle", "norm"), "anchors")
    tables.drop("placed")

    def extent(df, name):
        return df.groupBy(name).agg(F.min("centre").alias(f"{name}_centre"), F.max("angle").alias(f"{name}_angle"),
                                    F.max("norm").alias(f"{name}_norm"))

    turns = np.arccos(np.clip(centres @ centres.T, -1, 1)) * (centres.any(axis=1)[:, None] & centres.any(axis=1)[None, :])
    between = spark.createDataFrame([(i, j, float(turns[i, j])) for i in range(len(centres)) for j in range(len(centres))],
                                    "block_centre bigint, shard_centre bigint, apart double")
    count = F.lit(int(shards.agg(F.max("shard")).first()[0] or 0))
    gap = F.greatest(F.lit(0.0), F.col("apart") - F.col("block_angle") - F.col("shard_angle") - 3 * _ANGLE)
    bound = F.col("block_norm") * F.col("shard_norm") * (F.greatest(F.lit(0.0), F.cos(gap)) + 3 * _SHARE) + 1
    # The blocks of the stated anchors meet the list of shards; neither holds a row of the table.
    pairs = tables.write(
        extent(anchors, "block").withColumn("shard", F.explode(F.sequence(F.lit(0), count))).withColumn("shard", F.col("shard").cast("long"))
        .join(extent(shards, "shard"), "shard").join(F.broadcast(between), ["block_centre", "shard_centre"])
        .select("block", "shard", (F.col("block_centre") == F.col("shard_centre")).alias("near"), bound.alias("bound")), "pairs")

    members = anchors.select("block", "q", "id", "label", "v", "centre")
    kind = "q bigint, row_id bigint, score bigint"
    order = [F.col("score").desc(), "row_id"]
    in_row = Window.partitionBy("q").orderBy(*order)

    def first(found):
        return found.withColumn("p", F.row_number().over(in_row) - 1).where(F.col("p") < positives)

    def pick(a, b):
        return _positives(a, b, centres, positives)

    none = F.lit(int(_NONE))
    near = tables.write(first(_visited(members.withColumn("least", none), shards, pairs.where("near").select("block", "shard"), pick, kind)),
                        "near-positives")
    reached = near.where(F.col("p") == positives - 1).select("q", F.col("score").alias("least"))
    known = members.join(reached, "q", "left").withColumn("least", F.coalesce("least", none))
    open_pairs = pairs.where("NOT near").join(known.groupBy("block").agg(F.min("least").alias("least")), "block")
    open_pairs = open_pairs.where("bound >= least").select("block", "shard")
    far = _visited(known, shards, open_pairs, pick, kind)
    best = tables.write(first(near.drop("p").unionByName(far)), "positives")

    lists = best.groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "score"))), lambda x: x["score"]).alias("scores"))
    asking = members.join(lists, "q").where(F.exists("scores", lambda x: x >= 0))
    floor = asking.groupBy("block").agg(F.min(F.array_min(F.filter("scores", lambda x: x >= 0))).alias("least"))
    wanted = pairs.join(floor, "block").where(F.col("bound") >= F.col("least") / 2).select("block", "shard")
    found = _visited(asking, shards, wanted, lambda a, b: _negatives(a, b, centres, negatives), "q bigint, p int, row_id bigint, score bigint")
    in_band = Window.partitionBy("q", "p").orderBy(*order)
    found = tables.write(found.withColumn("rank", F.row_number().over(in_band)).where(F.col("rank") <= negatives), "negatives")
    named = best.select("q", F.col("p").cast("int").alias("p"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = tables.write(found.join(named, ["q", "p"]).join(anchors.select("q", F.col("id").alias("anchor_id")), "q").select(
        "anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score")), "found")
    tables.drop("shards", "anchors", "pairs", "near-positives", "positives", "negatives")
    return out


def oracle() -> str:
    """The same rows in DuckDB SQL over the table ``embeddings``."""
    return f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS z FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.z, c.z) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= {NEGATIVES}"""

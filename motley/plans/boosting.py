"""Boosted trees of many models at once, grown level by level from histograms.

Splits, folds, subsets and learning rates only differ in the groups of rows a model learns from
and in a few numbers. So all models share one table of rows with binned features, and a level
of all their trees costs one pass: every task adds up gradients per (model, node, feature, bin),
Spark brings the sums of a (model, node) together and its best split comes back. Forty models
take as many jobs as one. What the driver holds are the trees, whose size the rows do not move.

Rows are cells: ``total`` is the sum of the outcome over the ``weight`` rows of the cell, which
squared and logistic loss need no more than. Quantiles are learnt from (outcome, weight) rows; the
outcomes of equal binned features are kept sorted in blocks, in which rounds look up places.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motley.operators.aggregates import group_quantile
from motley.workdir import fresh_path, read_settings, remove, write_settings

BINS = 32
ROOM = 1 << 23  # numbers in the histograms of one pass; more models take more passes
CHUNK, BLOCK = 1 << 20, 1 << 12  # rows that a task sorts into blocks at a time, outcomes in a block
FEW = 1 << 14  # so many sums per (distinct features, model) may come to the driver each round
POINTS = 32  # outcomes of a block that stand for the others while a quantile is narrowed down
ALL, MOST = 1 << 16, 1 << 21  # outcomes that are ranked without narrowing, and after it
LOSSES = ("squared", "logistic", "quantile")


def _as_array(df: DataFrame, column: str) -> Column:
    return vector_to_array(column) if isinstance(df.schema[column].dataType, VectorUDT) else F.col(column).cast("array<double>")


def _stacked(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of numbers; a null row or number, or a row that is too short, counts as zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    if not column.null_count and len(sizes) and (sizes == width).all():
        flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py():column.offsets[-1].as_py()]
        return np.nan_to_num(flat.astype(float).reshape(len(column), width))
    out = np.zeros((len(column), width))
    for i, row in enumerate(column.to_pylist()):
        if row:
            values = np.array(row[:width], dtype=float)
            out[i, :len(values)] = np.nan_to_num(values)
    return out


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of the rows, and the place of every row among them."""
    known: dict = {}
    place = np.fromiter((known.setdefault(r.tobytes(), len(known)) for r in rows), np.int64, len(rows))
    return np.frombuffer(b"".join(known), dtype=rows.dtype).reshape(len(known), rows.shape[1]), place


@dataclass
class Bins:
    """Upper edges of the bins of every feature; a value belongs to the first edge not below it."""

    edges: list[list[float]]

    @classmethod
    def fit(cls, df: DataFrame, features: str = "features", bins: int = BINS) -> "Bins":
        """Edges at even shares of the distinct feature rows, from mergeable sketches of one row per feature."""
        rows = df.select(_as_array(df, features).alias("x")).where("x IS NOT NULL").distinct()
        shares = [i / bins for i in range(1, bins)]
        found = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.percentile_approx("v", shares, 10_000).alias("e"))
        by = {r["i"]: sorted(set(r["e"])) for r in found.collect()}
        return cls([by.get(i, []) for i in range(max(by, default=0) + 1)])

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(values.shape, dtype=np.uint8)
        for i, edges in enumerate(self.edges):
            out[:, i] = np.searchsorted(edges, values[:, i], side="left")
        return out


@dataclass
class Tree:
    """One round of all models: split feature and bin of every inner node (-1: none), and a value per leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray, levels: int) -> np.ndarray:
        """Place of every row in a level of each model's tree."""
        models = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for level in range(levels):
            at = (1 << level) - 1 + node
            f = self.feature[models, at]
            right = (f >= 0) & (np.take_along_axis(x, np.maximum(f, 0), axis=1) > self.cut[models, at])
            node = 2 * node + right
        return node


@dataclass
class Boosts:
    """Fitted models; ``start`` and ``rates`` have one number per model."""

    bins: Bins
    loss: str
    start: np.ndarray
    rates: np.ndarray
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def add(self, scores: np.ndarray, x: np.ndarray, first: int = 0) -> np.ndarray:
        """Scores after the trees from ``first`` on."""
        models = np.arange(len(self.start))[None, :]
        for tree in self.trees[first:]:
            scores = scores + self.rates[None, :] * tree.value[models, tree.leaves(x, self.depth)]
        return scores

    def predict(self, df: DataFrame, output: str = "prediction", model: str | None = None, features: str = "features") -> DataFrame:
        """Add the prediction of the model whose number is in ``model``, or else an array of all predictions.

        A number that no model has, or a null, gives null.
        """
        shared = df.sparkSession.sparkContext.broadcast(self)

        def scores(x: pd.Series) -> np.ndarray:
            mine = shared.value
            named, place = _distinct(_stacked(pa.Array.from_pandas(x, type=pa.list_(pa.float64())), len(mine.bins.edges)))
            out = mine.add(np.tile(mine.start, (len(named), 1)), mine.bins.of(named))
            return (1 / (1 + np.exp(-out)) if mine.loss == "logistic" else out)[place]

        @F.pandas_udf("double")
        def one(x: pd.Series, m: pd.Series) -> pd.Series:
            known = m.notna() & m.between(0, len(shared.value.start) - 1)
            picked = np.where(known, m, 0).astype(int)
            return pd.Series(scores(x)[np.arange(len(x)), picked]).where(known.to_numpy())

        @F.pandas_udf("array<double>")
        def every(x: pd.Series) -> pd.Series:
            return pd.Series(list(scores(x)))

        x = _as_array(df, features)
        return df.withColumn(output, every(x) if model is None else one(x, F.col(model).cast("double")))

    def save(self, spark, path: str) -> None:
        write_settings(spark, {
            "edges": self.bins.edges, "loss": self.loss, "start": self.start.tolist(), "rates": self.rates.tolist(), "depth": self.depth,
            "trees": [json.dumps([t.feature.tolist(), t.cut.tolist(), t.value.tolist()]) for t in self.trees]}, path)

    @classmethod
    def load(cls, spark, path: str) -> "Boosts":
        kept = read_settings(spark, path)
        trees = [Tree(np.array(f), np.array(c), np.array(v)) for f, c, v in map(json.loads, kept["trees"])]
        return cls(Bins(kept["edges"]), kept["loss"], np.array(kept["start"]), np.array(kept["rates"]), kept["depth"], trees)


def _gradients(loss: str, scores, total, weight):
    """First and second derivatives of a cell's loss by the score of each model."""
    if loss == "squared":
        return weight[:, None] * scores - total[:, None], np.broadcast_to(weight[:, None], scores.shape)
    p = 1 / (1 + np.exp(-scores))
    return weight[:, None] * p - total[:, None], weight[:, None] * p * (1 - p)


def _histograms(x: np.ndarray, leaves: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """g and h, of every x and model, added up per (feature, model and node, bin)."""
    models = leaves.shape[1]
    cell = ((np.arange(models)[None, :] * nodes + leaves) * width).ravel()
    bins = np.repeat(x, models, axis=0)
    return tuple(np.array([np.bincount(cell + bins[:, j], v, models * nodes * width) for j in range(x.shape[1])])
                 .reshape(x.shape[1], models * nodes, width) for v in (g, h))


def best_split(g: np.ndarray, h: np.ndarray, least: float) -> tuple[int, int, float, float, float, float]:
    """(feature, last bin to the left, g and h left, g and h right); the feature is -1 if no split gains anything."""
    left_g, left_h = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    all_g, all_h = g[0].sum(), h[0].sum()
    right_g, right_h = all_g - left_g, all_h - left_h
    fits = (left_h >= least) & (right_h >= least) & (left_h > 0) & (right_h > 0)
    whole = all_g * all_g / all_h if all_h > 0 else 0.0
    gain = np.where(fits, left_g ** 2 / np.where(fits, left_h, 1) + right_g ** 2 / np.where(fits, right_h, 1) - whole, -1.0)
    best = float(gain.max(initial=-1.0))
    if best <= 1e-9 * max(abs(whole), 1e-12):
        return -1, 0, all_g, all_h, 0.0, 0.0
    f, b = np.unravel_index(int(np.flatnonzero(gain.ravel() >= best * (1 - 1e-9))[0]), gain.shape)  # the first of equal ones
    return int(f), int(b), left_g[f, b], left_h[f, b], right_g[f, b], right_h[f, b]


class _Fit:
    """The rows with their scores in a written table, and the passes over them."""

    def __init__(self, cells: DataFrame, boosts: Boosts, members: np.ndarray, least: float, features: str):
        """``members`` tells for each group number and model whether the model learns from the group."""
        self.spark, self.boosts, self.members, self.least = cells.sparkSession, boosts, members, least
        self.done, self.path = 0, None
        first = cells.select("group", _as_array(cells, features).alias("x"), F.col("total").cast("double").alias("total"),
                             F.col("weight").cast("double").alias("weight"))
        self._begin(first)

    def _begin(self, first: DataFrame) -> None:
        bins, start = self.boosts.bins, self.boosts.start

        def run(batches):
            for batch in batches:
                x = bins.of(_stacked(batch.column("x"), len(bins.edges)))
                scores = np.tile(start, (len(x), 1))
                yield _rows(batch, pa.array([r.tobytes() for r in x], pa.binary()), scores)

        self._write(first.mapInArrow(run, _STATE))

    def _write(self, df: DataFrame) -> None:
        old, self.path = self.path, fresh_path(self.spark, "boosting")
        df.write.parquet(self.path)
        if old:
            remove(self.spark, old)

    def close(self) -> None:
        remove(self.spark, self.path)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(_STATE).parquet(self.path)

    def _scored(self):
        """A function that gives (distinct x, place of each row's x, group, total, weight, scores with all trees so far) of a batch.

        Rows of one title share their features, so the trees are walked once per distinct x.
        """
        shared, first = self.spark.sparkContext.broadcast(self.boosts), self.done

        def of(batch):
            mine = shared.value
            named = batch.column("x").dictionary_encode()
            x = np.frombuffer(b"".join(named.dictionary.to_pylist()), dtype=np.uint8).reshape(len(named.dictionary), len(mine.bins.edges))
            place = named.indices.to_numpy()
            scores = np.frombuffer(b"".join(batch.column("scores").to_pylist()), dtype=float).reshape(batch.num_rows, len(mine.start))
            group, total, weight = (batch.column(n).to_numpy() for n in ("group", "total", "weight"))
            moved = mine.add(np.zeros((len(x), len(mine.start))), x, first)
            return x, place, group, total, weight, scores + moved[place]

        return of

    def _graded(self, models: np.ndarray):
        """A function that gives (distinct x, place of each row's x, group, g, h) of a batch for the given models."""
        scored, loss = self._scored(), self.boosts.loss

        def of(batch):
            x, place, group, total, weight, scores = scored(batch)
            return x, place, group, *_gradients(loss, scores[:, models], total, weight)

        return of

    def keep_scores(self) -> None:
        scored = self._scored()

        def run(batches):
            for batch in batches:
                yield _rows(batch, batch.column("x"), scored(batch)[-1])

        self._write(self._read().mapInArrow(run, _STATE))
        self.done = len(self.boosts.trees)

    def splits(self, tree: Tree, level: int, open_models: np.ndarray) -> list:
        """(model, node, *best_split) of every node of a level that the given models still grow."""
        nodes, (d, width) = 1 << level, (len(self.boosts.bins.edges), max(map(len, self.boosts.bins.edges), default=0) + 1)
        room = max(1, ROOM // (nodes * max(d, 1) * width))
        return [row for lo in range(0, len(open_models), room)
                for row in self._pass(tree, level, open_models[lo:lo + room], nodes, d, width)]

    def _pass(self, tree: Tree, level: int, models: np.ndarray, nodes: int, d: int, width: int) -> list:
        graded, members, least = self._graded(models), self.members[:, models], self.least
        part = Tree(tree.feature[models], tree.cut[models], tree.value[models])

        def sums(batches):
            g_sum, h_sum = np.zeros((2, d, len(models) * nodes, width))
            for batch in batches:
                x, place, group, g, h = graded(batch)
                row, model = np.nonzero(members[group])
                mine = place[row] * len(models) + model
                g, h = (np.bincount(mine, v[row, model], len(x) * len(models)) for v in (g, h))
                for whole, part_of in zip((g_sum, h_sum), _histograms(x, part.leaves(x, level), g, h, nodes, width)):
                    whole += part_of
            some = np.flatnonzero(h_sum[:1].any(axis=(0, 2)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(models[some // nodes], pa.int32()), pa.array(some % nodes, pa.int32()),
                 *(pa.array([np.ascontiguousarray(s[:, i]).tobytes() for i in some], pa.binary()) for s in (g_sum, h_sum))],
                names=["model", "node", "g", "h"])

        def best(table: pa.Table) -> pa.Table:
            g, h = (sum(np.frombuffer(b, dtype=float) for b in table.column(n).to_pylist()).reshape(d, width) for n in ("g", "h"))
            found = best_split(g, h, least)
            key = [table.column(n)[0].as_py() for n in ("model", "node")]
            return pa.Table.from_pylist([dict(zip(_SPLIT_NAMES, [*key, *found]))], schema=_SPLIT_SCHEMA)

        if not d:
            return []
        made = self._read().mapInArrow(sums, "model int, node int, g binary, h binary")
        return made.groupBy("model", "node").applyInArrow(best, _SPLIT).collect()  # a row per node


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where the lists begin and end, and their numbers one after the other."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return ends - ends[0], column.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each size, one after the other."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def _places(first: np.ndarray, last: np.ndarray, below) -> np.ndarray:
    """For each range of places the first one that is not ``below``, by halving; those below come first."""
    lo, hi = first.copy(), last.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        yes = below(np.where(open_, mid, 0))
        lo, hi = np.where(open_ & yes, mid + 1, lo), np.where(open_ & ~yes, mid, hi)
    return lo


def _bounds(r: np.ndarray, at_least: np.ndarray, at_most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct r in order, weight surely up to r, weight at most below r) from what each point adds to them."""
    order = np.argsort(r, kind="stable")
    r, upto, under = r[order], at_least[order].cumsum(), at_most[order].cumsum()
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    last = np.concatenate([first[1:], [len(r)]]) - 1
    return r[first], upto[last], np.concatenate([[0.0], under[last[:-1]]])


def _thinned(r: np.ndarray, at_least: np.ndarray, at_most: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``points`` and one of the points, at even shares of the weight; the bounds stay true."""
    whole = at_most.sum()
    r, upto, under = _bounds(r, at_least, at_most)
    kept = np.unique(np.minimum(np.searchsorted(upto, upto[-1] * np.arange(points + 1) / points), len(r) - 1))
    kept = np.union1d([0, len(r) - 1], kept)
    return r[kept], np.diff(upto[kept], prepend=0.0), np.diff(np.append(under[kept], whole))


class _Counted(_Fit):
    """The outcomes of quantile loss, sorted and counted in blocks of equal group and binned features.

    All rows of a block have the same scores, so the weight above a score is a place in the block. The
    quantile of a leaf's residuals is narrowed down by a few outcomes per block, which bound the ranks
    of the others; then only the outcomes between the bounds are ranked. The result is exact.
    """

    def __init__(self, cells: DataFrame, boosts: Boosts, members: np.ndarray, least: float, features: str, q: float):
        self.q = q
        super().__init__(cells, boosts, members, least, features)

    def _begin(self, first: DataFrame) -> None:
        bins, start, width = self.boosts.bins, self.boosts.start.tobytes(), len(self.boosts.bins.edges)

        def blocks(parts, named):
            group, code, y, weight = (np.concatenate(v) for v in zip(*parts))
            order = np.lexsort((y, code, group))
            group, code, y, weight = group[order], code[order], y[order], weight[order]
            other = np.concatenate([[True], (group[1:] != group[:-1]) | (code[1:] != code[:-1])])
            once = np.flatnonzero(other | np.concatenate([[True], y[1:] != y[:-1]]))
            group, code, y, weight, other = group[once], code[once], y[once], np.add.reduceat(weight, once), other[once]
            began = np.maximum.accumulate(np.where(other, np.arange(len(y)), 0))
            begin = np.flatnonzero((np.arange(len(y)) - began) % BLOCK == 0)
            sizes, upto = np.diff(begin, append=len(y)), weight.cumsum()
            upto = upto - np.repeat(upto[begin] - weight[begin], sizes)
            ends = pa.array(np.append(begin, len(y)), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(group[begin], pa.int32()), pa.array([named[c] for c in code[begin]], pa.binary()),
                 pa.ListArray.from_arrays(ends, pa.array(y)), pa.ListArray.from_arrays(ends, pa.array(upto)),
                 pa.array([start] * len(begin), pa.binary())], names=["group", "x", "y", "upto", "scores"])

        def run(batches):
            parts, named, rows = [], {}, 0
            for batch in batches:
                x, place = _distinct(_stacked(batch.column("x"), width))
                code = np.array([named.setdefault(r.tobytes(), len(named)) for r in bins.of(x)], dtype=np.int64)
                parts.append((batch.column("group").to_numpy(), code[place], *(batch.column(n).to_numpy() for n in ("total", "weight"))))
                rows += batch.num_rows
                if rows >= CHUNK:
                    yield blocks(parts, list(named))
                    parts, named, rows = [], {}, 0
            if rows:
                yield blocks(parts, list(named))

        self._write(first.mapInArrow(run, _BLOCKS))
        sizes = np.zeros(len(self.members))
        for r in self._read().groupBy("group").agg(F.sum(F.size("y")).alias("n")).collect():  # a row per group
            sizes[r["group"]] = r["n"]
        self.size, self.codes, self.weights = max(sizes @ self.members, default=0), None, None
        different = self._read().select("x").distinct()
        if different.limit(FEW // max(1, len(self.boosts.start)) + 1).count() * len(self.boosts.start) <= FEW:
            names = sorted(bytes(r["x"]) for r in different.collect())
            self.x = np.frombuffer(b"".join(names), dtype=np.uint8).reshape(len(names), width)
            self.codes = self.spark.sparkContext.broadcast({x: i for i, x in enumerate(names)})

    def _write(self, df: DataFrame) -> None:
        old, self.path = self.path, fresh_path(self.spark, "boosting")
        df.write.option("parquet.block.size", 4 << 20).parquet(self.path)  # so that a pass has tasks for all cores
        if old:
            remove(self.spark, old)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(_BLOCKS).parquet(self.path)

    def _scored(self):
        """A function that gives (distinct x, place of each block's x, group, scores, ends of the blocks, outcomes, weight up to each)."""
        mine, width = self.boosts, len(self.boosts.bins.edges)
        late = Boosts(Bins([]), mine.loss, mine.start, mine.rates, mine.depth, mine.trees[self.done:])

        def of(batch):
            named = batch.column("x").dictionary_encode()
            x = np.frombuffer(b"".join(named.dictionary.to_pylist()), dtype=np.uint8).reshape(len(named.dictionary), width)
            place = named.indices.to_numpy()
            scores = np.frombuffer(b"".join(batch.column("scores").to_pylist()), dtype=float).reshape(batch.num_rows, len(late.start))
            scores = scores + late.add(np.zeros((len(x), len(late.start))), x)[place]
            return x, place, batch.column("group").to_numpy(), scores, *_lists(batch.column("y")), _lists(batch.column("upto"))[1]

        return of

    def _graded(self, models: np.ndarray):
        scored, q = self._scored(), self.q

        def of(batch):
            x, place, group, scores, ends, y, upto = scored(batch)
            scores = scores[:, models]
            first, last = (np.repeat(e[:, None], len(models), axis=1) for e in (ends[:-1], ends[1:]))
            at = _places(first, last, lambda i: ~(y[i] > scores) & (y[i] == y[i]))
            under, whole = np.where(at > first, upto[at - 1], 0.0), np.repeat(upto[ends[1:] - 1][:, None], len(models), axis=1)
            return x, place, group, (1 - q) * under - q * (whole - under), whole

        return of

    def keep_scores(self) -> None:
        scored = self._scored()

        def run(batches):
            for batch in batches:
                scores = pa.array([r.tobytes() for r in np.ascontiguousarray(scored(batch)[3])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("group", "x", "y", "upto")), scores],
                                                 names=["group", "x", "y", "upto", "scores"])

        self._write(self._read().mapInArrow(run, _BLOCKS))
        self.done = len(self.boosts.trees)

    def splits(self, tree: Tree, level: int, open_models: np.ndarray) -> list:
        """As of any fit; of few distinct features the driver takes the sums once a round and grows all levels from them."""
        width = max(map(len, self.boosts.bins.edges), default=0) + 1
        if self.codes is None or not self.x.size:
            return super().splits(tree, level, open_models)
        if level == 0:
            self.sums = self._sums()
        nodes, (g, h), d, out = 1 << level, self.sums, self.x.shape[1], []
        leaves = tree.leaves(self.x, level)
        room = max(1, ROOM // (nodes * d * width))
        for lo in range(0, len(open_models), room):
            models = open_models[lo:lo + room]
            g_sum, h_sum = _histograms(self.x, leaves[:, models], g[:, models].ravel(), h[:, models].ravel(), nodes, width)
            for i in np.flatnonzero(h_sum[:1].any(axis=(0, 2))):
                out.append((int(models[i // nodes]), int(i % nodes), *best_split(g_sum[:, i], h_sum[:, i], self.least)))
        return out

    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        """g and h of every distinct x and model."""
        graded, members, codes = self._graded(np.arange(len(self.boosts.start))), self.members, self.codes
        shape, weighed = (len(self.x), len(self.boosts.start)), self.weights is not None

        def run(batches):
            whole = np.zeros((2, *shape))
            for batch in batches:
                x, place, group, *both = graded(batch)
                code = np.array([codes.value[r.tobytes()] for r in x])[place]
                row, model = np.nonzero(members[group])
                for i, v in enumerate(both):
                    whole[i] += np.bincount(code[row] * shape[1] + model, v[row, model], whole[i].size).reshape(shape)
            yield pa.RecordBatch.from_arrays([pa.array([whole[:1 if weighed else 2].tobytes()], pa.binary())], names=["s"])

        # a row per task; the weights are the same in every round
        sums = sum(np.frombuffer(r["s"], dtype=float).reshape(-1, *shape) for r in self._read().mapInArrow(run, "s binary").collect())
        if not weighed:
            self.weights = sums[1] if np.ndim(sums) else np.zeros(shape)
        return (sums[0] if np.ndim(sums) else np.zeros(shape)), self.weights

    def quantiles(self, tree: Tree) -> list:
        """(model, leaf, quantile of the residuals) of every leaf."""
        shape, ends, left = tree.value.shape, None, self.size
        while left > (ALL if ends is None else MOST):
            ends, left = self._narrow(tree, ends, shape, POINTS), left * 2 // POINTS
        lo, hi, n = self._narrow(tree, ends, shape, None)
        out = []
        for m, leaf in zip(*np.nonzero(n)):
            a, z, rank = lo[m, leaf], hi[m, leaf], (n[m, leaf] - 1) * self.q
            out.append((int(m), int(leaf), float(a if a == z else a + (z - a) * (rank - np.floor(rank)))))
        return out

    def _narrow(self, tree: Tree, ends, shape, points: int | None):
        """Arrays (lo, hi, n) per model and leaf: the wanted ranks lie from lo to hi. Without ``points`` these are their values.

        ``ends`` are the arrays of an earlier pass, outside of which nothing is looked at.
        """
        scored, members, depth, q, (models, leaves) = self._scored(), self.members, self.boosts.depth, self.q, shape

        def run(batches):
            for batch in batches:
                x, place, group, scores, begin, y, upto = scored(batch)
                block, model = np.nonzero(members[group])
                leaf, score = tree.leaves(x, depth)[place[block], model], scores[block, model]
                first, last = begin[block], begin[block + 1]
                base = np.zeros(len(block))
                if ends is not None:
                    low, high = (e[model, leaf] for e in ends[:2])
                    whole = first
                    first = _places(whole, last, lambda i: y[i] - score < low)
                    last = _places(first, last, lambda i: y[i] - score <= high)
                    base = np.where(first > whole, upto[first - 1], 0.0)
                sizes, step = last - first, np.ones(len(block), dtype=np.int64)
                if points:
                    step = np.maximum(1, sizes // points)
                taken = np.where(sizes > 0, -(-sizes // step) + (step > 1), 0)
                entry = np.repeat(np.arange(len(block)), taken)
                at = np.minimum(first[entry] + _ranges(np.zeros(len(block), dtype=np.int64), taken) * step[entry], last[entry] - 1)
                begins = np.concatenate([[True], entry[1:] != entry[:-1]])[:len(entry)]
                ended = np.concatenate([begins[1:], [True]])[:len(entry)]
                reached = upto[at] - base[entry]
                under = np.where(at > first[entry], upto[at - 1] - base[entry], 0.0)
                total = np.where(sizes > 0, upto[last - 1] - base, 0.0)
                at_least = reached - np.where(begins, 0.0, np.roll(reached, 1))
                at_most = np.where(ended, total[entry], np.roll(under, -1)) - under
                key, r = (model * leaves + leaf)[entry], y[at] - score[entry]
                order = np.argsort(key, kind="stable")
                cut = np.searchsorted(key[order], np.arange(models * leaves + 1))
                below = np.bincount(model * leaves + leaf, base, models * leaves)
                for k in np.flatnonzero((np.diff(cut) > 0) | (below > 0)):
                    mine = order[cut[k]:cut[k + 1]]
                    found = r[mine], at_least[mine], at_most[mine]
                    if points and len(mine):
                        found = _thinned(*found, 8 * points)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k // leaves], pa.int32()), pa.array([k % leaves], pa.int32()), pa.array([below[k]]),
                         *(pa.array([v.tobytes()], pa.binary()) for v in found)], names=_NARROWED)

        def ranks(table: pa.Table) -> pa.Table:
            r, at_least, at_most = (np.frombuffer(b"".join(table.column(n).to_pylist()), dtype=float) for n in _NARROWED[3:])
            model, leaf, below = table.column("model")[0].as_py(), table.column("leaf")[0].as_py(), sum(table.column("below").to_pylist())
            n = max(1, int(at_least.sum())) if ends is None else int(ends[2][model, leaf])
            r, upto, under = _bounds(r, at_least, at_most)
            first, last = np.floor((n - 1) * q), np.ceil((n - 1) * q)
            lo = r[max(np.searchsorted(below + under, first, side="right") - 1, 0)]
            hi = r[min(np.searchsorted(below + upto, last, side="right"), len(r) - 1)]
            return pa.Table.from_pylist([dict(model=model, leaf=leaf, lo=lo, hi=hi, n=n)], schema=_ENDS_SCHEMA)

        made = self._read().mapInArrow(run, "model int, leaf int, below double, r binary, at_least binary, at_most binary")
        found = made.groupBy("model", "leaf").applyInArrow(ranks, "model int, leaf int, lo double, hi double, n bigint").collect()  # a row per leaf
        lo, hi, n = np.zeros(shape), np.zeros(shape), np.zeros(shape, dtype=np.int64)
        for row in found:
            lo[row["model"], row["leaf"]], hi[row["model"], row["leaf"]], n[row["model"], row["leaf"]] = row["lo"], row["hi"], row["n"]
        return lo, hi, n


_STATE = "group int, x binary, total double, weight double, scores binary"
_BLOCKS = "group int, x binary, y array<double>, upto array<double>, scores binary"
_NARROWED = ["model", "leaf", "below", "r", "at_least", "at_most"]
_ENDS_SCHEMA = pa.schema([("model", pa.int32()), ("leaf", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int64())])
_SPLIT = "model int, node int, feature int, cut int, left_g double, left_h double, right_g double, right_h double"
_SPLIT_NAMES = [c.split()[0] for c in _SPLIT.split(", ")]
_SPLIT_SCHEMA = pa.schema([(n, pa.int32() if i < 4 else pa.float64()) for i, n in enumerate(_SPLIT_NAMES)])


def _rows(batch, x: pa.Array, scores: np.ndarray):
    return pa.RecordBatch.from_arrays(
        [batch.column("group"), x, batch.column("total"), batch.column("weight"),
         pa.array([r.tobytes() for r in np.ascontiguousarray(scores)], pa.binary())], names=["group", "x", "total", "weight", "scores"])


def _starts(cells: DataFrame, members: np.ndarray, loss: str, q: float) -> np.ndarray:
    """Best constant score of each model; 0 for a model without rows."""
    models = members.shape[1]
    if loss == "quantile":
        belongs = cells.sparkSession.createDataFrame(
            [(int(g), int(m)) for g, m in zip(*np.nonzero(members))], "group int, model int")
        found = group_quantile(cells.join(F.broadcast(belongs), "group"), ["model"], "total", q, weight="weight").collect()
        out = np.zeros(models)
        for r in found:
            out[r["model"]] = r["estimate"]
        return out
    sums = np.zeros((len(members), 2))
    for r in cells.groupBy("group").agg(F.sum("total").alias("t"), F.sum("weight").alias("w")).collect():  # a row per group
        sums[r["group"]] = float(r["t"]), float(r["w"])
    total, weight = sums[:, 0] @ members, sums[:, 1] @ members
    mean = np.divide(total, weight, out=np.zeros(models), where=weight > 0)
    if loss == "squared":
        return mean
    p = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.where(weight > 0, np.log(p / (1 - p)), 0.0)


def fit_many(cells: DataFrame, members: list[set], rates: list[float], loss: str = "squared", rounds: int = 100, depth: int = 5,
             depths: list[int] | None = None, q: float = 0.75, least: float = 1e-6, group: str = "group", features: str = "features",
             bins: Bins | None = None, save_every: int = 8) -> Boosts:
    """One boosted model per entry of ``members``, the values of ``group`` it learns from.

    ``cells`` has ``features`` (a vector or an array), ``group``, ``weight`` (rows of the cell) and
    ``total`` (the sum of their outcomes, or for quantiles the outcome). Cells with a null total
    or no weight teach nothing. ``rates`` are the learning rates, ``depths`` the depths of single
    models, ``least`` the least weight (for logistic loss: curvature) of a side of a split.
    Groups are few, such as tables and folds: the driver knows them all. The scores of rows
    are written every ``save_every`` rounds and otherwise follow from the trees since then.
    """
    if loss not in LOSSES:
        raise ValueError(f"loss={loss!r}: allowed are {', '.join(LOSSES)}")
    known = cells.where(F.col("total").isNotNull() & (F.col("weight") > 0))
    named = sorted({x for m in members for x in m}, key=str)
    number = {x: i for i, x in enumerate(named)}
    numbers = cells.sparkSession.createDataFrame(list(number.items()), f"_g {cells.schema[group].dataType.simpleString()}, _number int")
    known = known.join(F.broadcast(numbers), F.col(group).eqNullSafe(F.col("_g"))).select(
        F.col("_number").alias("group"), features, "total", "weight")
    table = np.zeros((len(named), len(members)), dtype=bool)
    for m, groups in enumerate(members):
        table[[number[x] for x in groups], m] = True
    bins = bins or Bins.fit(known, features)
    boosts = Boosts(bins, loss, _starts(known, table, loss, q), np.array(rates, dtype=float), depth)
    limits = np.array(depths if depths is not None else [depth] * len(members))
    fit = _Counted(known, boosts, table, least, features, q) if loss == "quantile" else _Fit(known, boosts, table, least, features)
    for i in range(rounds):
        tree = _grown(fit, boosts, limits)
        if loss == "quantile":
            for m, leaf, value in fit.quantiles(tree):
                tree.value[m, leaf] = value
        boosts.trees.append(tree)
        if (i + 1) % save_every == 0 and i + 1 < rounds:
            fit.keep_scores()
    fit.close()
    return boosts


def _grown(fit: _Fit, boosts: Boosts, limits: np.ndarray) -> Tree:
    """The next tree of every model, one level at a time."""
    models, inner = len(boosts.start), (1 << boosts.depth) - 1
    tree = Tree(np.full((models, inner), -1), np.zeros((models, inner), dtype=np.int64), np.zeros((models, inner + 1)))
    growing = limits > 0
    for level in range(boosts.depth):
        rows = fit.splits(tree, level, np.flatnonzero(growing & (limits > level)))
        span = 1 << (boosts.depth - level - 1)  # leaves below each side of a node of this level
        growing = np.zeros(models, dtype=bool)
        for m, node, f, cut, left_g, left_h, right_g, right_h in rows:
            at = 2 * node * span
            value = lambda g, h: -g / h if h > 0 else 0.0
            if f < 0:
                tree.value[m, at:at + 2 * span] = value(left_g, left_h)
                continue
            tree.feature[m, (1 << level) - 1 + node], tree.cut[m, (1 << level) - 1 + node] = f, cut
            tree.value[m, at:at + span], tree.value[m, at + span:at + 2 * span] = value(left_g, left_h), value(right_g, right_h)
            growing[m] = True
        if not growing.any():
            break
    return tree

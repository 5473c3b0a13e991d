"""Gamma-Poisson topics of n-gram counts, fitted over distinct values.

A value's n-gram counts are explained as a mixture of a few topics. The weights of topics are
a table with a row per n-gram; nothing that grows with the vocabulary or the values is
held by the driver. A value meets the weights of its own n-grams in a join, its activations
are found from these, and what it adds to each n-gram is summed by Spark. The driver knows
sums per topic only.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from motley.functions.grams import windows
from motley.functions.hashing import seeded
from motley.operators.aggregates import top_per_group, value_counts
from motley.operators.dictionary import spread
from motley.operators.encoders import kmeans_prototypes, words_of
from motley.workdir import fresh_path, materialize, read_settings, remove, write_settings


@dataclass(frozen=True)
class TopicParams:
    """``hashing`` counts n-grams in ``dim`` buckets, without it every n-gram has weights of its own."""

    n_topics: int = 10
    shape_prior: float = 1.1
    scale_prior: float = 1.0
    r: float | None = 0.7
    rho: float | None = 0.99
    hashing: bool = True
    dim: int = 2**14
    init: str = "k-means++"
    tol: float = 1e-4
    min_iter: int = 2
    max_iter: int = 5
    ngram_range: tuple[int, int] = (2, 4)
    add_words: bool = False
    rescale: bool = True
    inner_iter: int = 20
    n_batches: int = 2
    seed: int = 0

    def decay(self) -> float:
        """rho when given, else r spread over the batches of an epoch."""
        return self.rho if self.rho is not None else self.r ** (1 / self.n_batches)


@dataclass
class TopicModel:
    """``weights`` is (gram, w, a), an array entry per topic; w and a count after division by ``size``.

    ``b`` has the running sums of activations per topic.
    """

    params: TopicParams
    weights: DataFrame
    size: np.ndarray
    b: np.ndarray
    history: list[float] = field(default_factory=list)
    path: str | None = None

    def mass(self) -> np.ndarray:
        """Sum of the weights of each topic."""
        return np.ones(len(self.size)) if self.params.rescale else self.size

    def divisor(self) -> np.ndarray:
        return self.size if self.params.rescale else np.ones(len(self.size))


def _gram_name(gram: Column, p: TopicParams) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(p.dim)).cast("string") if p.hashing else gram


def _grams(df: DataFrame, column: str, p: TopicParams) -> DataFrame:
    """(value, gram, cnt) of the distinct values; with hashing a gram is its bucket."""
    text = F.lower(F.regexp_replace(column, r"(?U)\s\s+", " "))
    pieces = windows(text, *range(p.ngram_range[0], p.ngram_range[1] + 1))
    if p.add_words:
        pieces = F.concat(pieces, F.transform(words_of(F.col(column)), lambda w: F.concat(F.lit("\u0002"), w)))
    found = spread(df, column).select(column, F.explode_outer(pieces).alias("gram")).where("gram IS NOT NULL")
    return found.groupBy(column, _gram_name(F.col("gram"), p).alias("gram")).agg(F.count("*").cast("double").alias("cnt"))


def _documents(df: DataFrame, column: str, p: TopicParams) -> DataFrame:
    """(value, n, grams): each distinct value with its row count and its (gram, cnt)."""
    values = value_counts(df.where(F.col(column).isNotNull()), column)
    rows = _grams(values, column, p).groupBy(column).agg(F.array_sort(F.collect_list(F.struct("gram", "cnt"))).alias("grams"))
    return values.join(rows, column, "left").select(
        F.col(column).alias("value"), "n", F.coalesce("grams", F.array().cast("array<struct<gram:string,cnt:double>>")).alias("grams"))


def _long(docs: DataFrame, *more) -> DataFrame:
    return docs.select("value", *more, F.explode("grams").alias("g")).select("value", *more, "g.gram", "g.cnt")


def _per_topic(numbers: np.ndarray) -> Column:
    return F.array(*(F.lit(float(x)) for x in numbers))


def _weighed(docs: DataFrame, model: TopicModel, *more) -> DataFrame:
    """The documents with ``met``, the (gram, cnt, w) of their n-grams that the model knows."""
    w = F.zip_with("w", _per_topic(model.divisor()), lambda x, y: x / y)
    met = _long(docs).join(model.weights.select("gram", "w"), "gram")
    rows = met.groupBy("value").agg(F.collect_list(F.struct("gram", "cnt", w.alias("w"))).alias("met"))
    none = F.array().cast("array<struct<gram:string,cnt:double,w:array<double>>>")
    return docs.select("value", "n", *more).join(rows, "value", "left").withColumn("met", F.coalesce("met", none))


def _flat(column: pa.ListArray, k: int):
    """Row numbers, n-grams, counts and weights of a batch, flattened."""
    gram, cnt, w = column.flatten().flatten()
    rows = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    return rows, gram, cnt.to_numpy(zero_copy_only=False), w.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _activations(rows, vals, w, m: int, p: TopicParams, mass: np.ndarray, max_iter: int) -> np.ndarray:
    """Topic activations of m documents by multiplicative updates until they settle."""
    k = len(mass)
    total = np.bincount(rows, weights=vals, minlength=m)
    h = np.repeat(np.maximum(1e-10, total)[:, None] / k, k, axis=1)
    scale = mass + 1 / p.scale_prior
    floor = (p.shape_prior - 1) / scale
    active = np.arange(m)
    for _ in range(max_iter):
        live = np.zeros(m, bool)
        live[active] = True
        on = live[rows]
        r, weight = rows[on], w[on]
        ratio = vals[on] / (h[r] * weight).sum(axis=1)
        step = np.stack([np.bincount(r, weights=weight[:, j] * ratio, minlength=m) for j in range(k)], axis=1)
        new = h[active] * (step[active] / scale) + floor
        change = ((new - h[active]) ** 2).sum(axis=1) / (h[active] ** 2).sum(axis=1)
        h[active] = new
        active = active[change > 1e-6]
        if not len(active):
            break
    return h


def _step_sums(docs: DataFrame, model: TopicModel, batch: int) -> tuple[DataFrame, np.ndarray, str]:
    """What a batch adds: a written (gram, x0, x1, ...), the sums per topic, and the path of the table."""
    p, mass, k = model.params, model.mass(), len(model.size)
    # the parts of n given to the batches add up to n
    part = F.floor((F.col("n") + F.pmod(seeded(F.col("value"), p.seed) + batch, F.lit(p.n_batches))) / p.n_batches)
    names = [f"x{j}" for j in range(k)]

    def sums(batches):
        for rows in batches:
            rows = rows.filter(pc.greater(rows.column("part"), 0))
            if not rows.num_rows:
                continue
            at, grams, vals, w = _flat(rows.column("met"), k)
            h = _activations(at, vals, w, rows.num_rows, p, mass, p.inner_iter)
            n = rows.column("part").to_numpy(zero_copy_only=False).astype(float)
            x = h[at] * (n[at] * vals / (h[at] * w).sum(axis=1))[:, None]
            yield pa.RecordBatch.from_arrays([grams, *(pa.array(x[:, j]) for j in range(k))], names=["gram", *names])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), *(pa.array([v]) for v in n @ h)], names=["gram", *names])

    parts = _weighed(docs, model, part.alias("part")).select("part", "met").mapInArrow(
        sums, "gram string, " + ", ".join(f"{x} double" for x in names))
    path = fresh_path(docs.sparkSession, "topic-step")
    parts.groupBy("gram").agg(*(F.sum(x).alias(x) for x in names)).write.parquet(path)
    made = docs.sparkSession.read.parquet(path)
    topic = made.where("gram IS NULL").first()  # one row
    return made.where("gram IS NOT NULL"), np.array([topic[x] for x in names]) if topic else np.zeros(k), path


def _written(model: TopicModel, weights: DataFrame, k: int) -> tuple[TopicModel, dict]:
    """The model with a new table of weights, and sums of w over the n-grams, gathered while it is written.

    ``weights`` has ``old`` beside w: the weights that it takes the place of.
    """
    seen, path = Observation(), fresh_path(weights.sparkSession, "topic-weights")
    one = lambda name, x: F.sum(x).alias(name)
    w, old = (lambda j: F.get("w", F.lit(j))), (lambda j: F.get("old", F.lit(j)))
    found = weights.observe(seen, F.count(F.lit(1)).alias("n"), *(x for j in range(k) for x in (
        one(f"w{j}", w(j)), one(f"ww{j}", w(j) * w(j)), one(f"wo{j}", w(j) * old(j)), one(f"oo{j}", old(j) * old(j)))))
    found.select("gram", "w", "a").write.parquet(path)
    sums = {name: np.array([seen.get.get(f"{name}{j}") or 0.0 for j in range(k)]) for name in ("w", "ww", "wo", "oo")}
    table = weights.sparkSession.read.schema("gram string, w array<double>, a array<double>").parquet(path)
    return replace(model, weights=table, size=np.where(sums["w"] > 0, sums["w"], 1.0), path=path), sums


def _advance(model: TopicModel, made: DataFrame, topic: np.ndarray) -> tuple[TopicModel, float]:
    """Decay the running sums, add the batch and renew the topics; tells how far the weights moved."""
    k, rho, divisor = len(model.size), model.params.decay(), model.divisor()
    b = model.b * rho + topic
    both = model.weights.join(made, "gram", "left")
    old = [F.get("w", F.lit(j)) / float(divisor[j]) for j in range(k)]
    a = [F.get("a", F.lit(j)) / float(divisor[j]) * float(rho) + old[j] * F.coalesce(F.col(f"x{j}"), F.lit(0.0)) for j in range(k)]
    new = both.select("gram", F.array(*(a[j] / float(b[j]) for j in range(k))).alias("w"), F.array(*a).alias("a"), F.array(*old).alias("old"))
    after, sums = _written(replace(model, b=b), new, k)
    by = after.divisor()
    moved = sums["ww"] / by ** 2 - 2 * sums["wo"] / by + sums["oo"]
    return after, float(np.sqrt(max(0.0, moved.sum()) / max(sums["oo"].sum(), 1e-300)))


def _stepped(model: TopicModel, docs: DataFrame, batch: int) -> tuple[TopicModel, float]:
    made, topic, path = _step_sums(docs, model, batch)
    after = _advance(model, made, topic)
    remove(docs.sparkSession, path)
    return after


def _spread_values(docs: DataFrame, chosen: list, k: int, seed: int) -> list:
    """k values drawn one after the other, far ones more likely (k-means++); a job for each.

    A draw with probability proportional to a weight is the smallest of
    independent exponential times, one per value, taken from its hash.
    """
    unit = (F.pmod(seeded(F.col("value"), seed), F.lit(2**40)) + 1) / F.lit(2.0**40 + 2)
    norm = F.aggregate("grams", F.lit(0.0), lambda s, g: s + g["cnt"] * g["cnt"])
    known = docs.where(F.col("value").isin(chosen)).select("value", norm).collect() if chosen else []  # a row per topic at most
    squares = {r[0]: float(r[1]) for r in known}
    for i in range(k - len(squares)):
        weighed = docs.select("value", "n", unit.alias("_u"), norm.alias("own"))
        if squares:
            # sum (x - c)^2 is x.x + c.c - 2 x.c; centres without a common n-gram are c.c beyond x.x
            centres = _long(docs.where(F.col("value").isin(list(squares)))).select(F.col("value").alias("c"), "gram", F.col("cnt").alias("_c"))
            cc = F.element_at(F.create_map(*(F.lit(x) for pair in squares.items() for x in pair)), F.col("c"))
            least = F.lit(min(squares.values()))
            met = (_long(docs).join(centres, "gram").groupBy("value", "c").agg(F.sum(F.col("cnt") * F.col("_c")).alias("dot"))
                   .groupBy("value").agg(F.min(cc - 2 * F.col("dot")).alias("near")))
            near = F.least(F.coalesce("near", least), least)
            weighed = weighed.join(met, "value", "left").withColumn("d", F.greatest(F.col("own") + near, F.lit(0.0)))
        else:
            weighed = weighed.withColumn("d", F.lit(1.0))
        spin = F.pmod(F.col("_u") + i * 0.6180339887498949, F.lit(1.0)) + 1e-12
        time = -F.log(spin) / (F.col("n") * F.col("d"))
        drawn = weighed.where(F.col("d") > 1e-9).agg(F.min_by(F.struct("value", "own"), time).alias("v")).first()["v"]
        if drawn is None:
            break
        squares[drawn["value"]] = float(drawn["own"])
    return list(squares)


def _drawn(grams: DataFrame, p: TopicParams, seeds: int, name: str) -> DataFrame:
    """(gram, name): gamma-distributed numbers per n-gram and topic that depend on the n-gram and the seed only."""
    def run(batches):
        for pdf in batches:
            draw = [np.random.RandomState(int(h) % 2**32).gamma(p.shape_prior, p.scale_prior, seeds).tolist() for h in pdf["h"]]
            yield pd.DataFrame({"gram": pdf["gram"], name: draw})

    return grams.select("gram", seeded(F.col("gram"), p.seed).alias("h")).mapInPandas(run, f"gram string, {name} array<double>")


def init_weights(docs: DataFrame, df: DataFrame, column: str, p: TopicParams) -> DataFrame:
    """(gram, w): starting weights of all n-grams of the documents, from spread values, prototypes or at random."""
    grams = _long(docs).select("gram").distinct()
    if p.init == "random":
        return _drawn(grams, p, p.n_topics, "w")
    if p.init not in ("k-means++", "k-means"):
        raise ValueError(f"init={p.init!r}: allowed are 'k-means++', 'k-means' and 'random'")
    chosen = sorted(kmeans_prototypes(df, column, p.n_topics, ngram=(2, 4), seed=p.seed)) if p.init == "k-means" else []
    chosen = _spread_values(docs, chosen[:p.n_topics], p.n_topics, p.seed)
    place = F.create_map(*(F.lit(x) for i, v in enumerate(chosen) for x in (v, i))) if chosen else F.lit(None).cast("map<string,int>")
    own = _long(docs.where(F.col("value").isin(chosen))).groupBy("gram").agg(
        F.map_from_entries(F.collect_list(F.struct(F.element_at(place, F.col("value")).alias("j"), "cnt"))).alias("own"))
    rows = grams.join(own, "gram", "left")
    have = [F.coalesce(F.try_element_at("own", F.lit(j)), F.lit(0.0)) + 0.1 for j in range(len(chosen))]
    more = p.n_topics - len(chosen)  # fewer distinct values than topics
    if more:
        rows = rows.join(_drawn(grams, p, more, "_more"), "gram")
        have += [F.get("_more", F.lit(j)) + 0.1 for j in range(more)]
    return rows.select("gram", F.array(*have).alias("w"))


def given_topics(weights: DataFrame, params: TopicParams) -> TopicModel:
    """A model that starts from given (gram, w) weights, which need not sum to 1."""
    k = params.n_topics
    small = F.array(*[F.lit(1e-10)] * k)
    # the first weights are divided by their sums, the running sums that start with them are not
    model = TopicModel(replace(params, rescale=True), weights, np.ones(k), np.full(k, 1e-10))
    model, sums = _written(model, weights.select("gram", "w", small.alias("a"), "w").toDF("gram", "w", "a", "old"), k)
    scaled = model.weights.select("gram", F.zip_with("w", _per_topic(model.size), lambda x, y: x / y).alias("w"), small.alias("a"))
    path = fresh_path(weights.sparkSession, "topic-weights")
    scaled.write.parquet(path)
    remove(weights.sparkSession, model.path)
    return TopicModel(params, weights.sparkSession.read.schema("gram string, w array<double>, a array<double>").parquet(path),
                      np.ones(k), np.full(k, 1e-10), [], path)


def _start(df: DataFrame, column: str, p: TopicParams) -> tuple[TopicModel, DataFrame]:
    docs = materialize(_documents(df, column, p), "documents")
    return given_topics(init_weights(docs, df, column, p), p), docs


def _grown(model: TopicModel, docs: DataFrame) -> TopicModel:
    """The model with the n-grams it has not met yet, at the mean weight of the others."""
    k, divisor = len(model.size), model.divisor()
    known = model.weights.select("gram", F.zip_with("w", _per_topic(divisor), lambda x, y: x / y).alias("w"),
                                 F.zip_with("a", _per_topic(divisor), lambda x, y: x / y).alias("a"))
    mean = _per_topic(model.mass() / max(1, model.weights.count()))
    new = _long(docs).select("gram").distinct().join(known, "gram", "left_anti")
    if new.isEmpty():
        return model
    both = known.unionByName(new.select("gram", mean.alias("w"), F.array(*[F.lit(1e-10)] * k).alias("a")))
    grown, sums = _written(model, both.withColumn("old", F.col("w")), k)
    # only the weights are divided by their new sums
    scaled = grown.weights.select("gram", F.zip_with("w", _per_topic(sums["w"] if model.params.rescale else np.ones(k)), lambda x, y: x / y).alias("w"), "a")
    path = fresh_path(docs.sparkSession, "topic-weights")
    scaled.write.parquet(path)
    remove(docs.sparkSession, grown.path)
    table = docs.sparkSession.read.schema("gram string, w array<double>, a array<double>").parquet(path)
    return replace(grown, weights=table, size=np.ones(k) if model.params.rescale else sums["w"], path=path)


def fit_topics(df: DataFrame, column: str, params: TopicParams | None = None) -> TopicModel:
    """Fit by passes over hash-chosen batches until the topics stop moving."""
    p = params or TopicParams()
    model, docs = _start(df, column, p)
    for epoch in range(p.max_iter):
        for batch in range(p.n_batches):
            old = model.path
            model, change = _stepped(model, docs, batch)
            remove(df.sparkSession, old)
        model.history.append(change)
        if change < p.tol and epoch >= p.min_iter - 1:
            break
    return model


def step_topics(model: TopicModel, df: DataFrame, column: str, batch: int = 0) -> TopicModel:
    """The model after one step with a batch of the rows; n-grams that the model does not know count for nothing."""
    return _stepped(model, _documents(df, column, model.params), batch)[0]


def partial_fit_topics(model: TopicModel | None, df: DataFrame, column: str, params: TopicParams | None = None) -> TopicModel:
    """One step with one batch of rows; the model grows by the n-grams the batch brings."""
    if model is None:
        model, docs = _start(df, column, replace(params or TopicParams(), n_batches=1))
    else:
        docs = materialize(_documents(df, column, model.params), "documents")
        model = _grown(model, docs)
    return _stepped(model, docs, 0)[0]


def _with_activations(model: TopicModel, docs: DataFrame, max_iter: int) -> DataFrame:
    """(value, n, h)."""
    p, mass, k = model.params, model.mass(), len(model.size)

    def run(batches):
        for rows in batches:
            at, _, vals, w = _flat(rows.column("met"), k)
            h = _activations(at, vals, w, rows.num_rows, p, mass, max_iter)
            yield pa.RecordBatch.from_arrays([rows.column("value"), rows.column("n"), pa.array(list(h), pa.list_(pa.float64()))],
                                             names=["value", "n", "h"])

    kind = dict(docs.dtypes)["value"]
    return _weighed(docs, model).mapInArrow(run, f"value {kind}, n long, h array<double>")


def transform_topics(model: TopicModel, df: DataFrame, column: str, output: str = "topics") -> DataFrame:
    """Add the topic activations of a column, found once per distinct value; a null value has null."""
    docs = _documents(df, column, model.params)
    codes = _with_activations(model, docs, 100).select(F.col("value").alias(column), F.col("h").alias(output))
    return df.join(codes, column, "left")


def score_topics(model: TopicModel, df: DataFrame, column: str) -> float:
    """Kullback-Leibler divergence between the counts and their mixture."""
    docs = _documents(df, column, model.params)
    p, mass, k = model.params, model.mass(), len(model.size)

    def divergence(batches):
        for rows in batches:
            at, _, vals, w = _flat(rows.column("met"), k)
            h = _activations(at, vals, w, rows.num_rows, p, mass, p.inner_iter)
            n = rows.column("n").to_numpy(zero_copy_only=False).astype(float)
            mixed = (h[at] * w).sum(axis=1)
            kl = (n[at] * (vals * np.log(vals / mixed) - vals)).sum() + (n * (h @ mass)).sum()
            yield pa.RecordBatch.from_arrays([pa.array([kl])], names=["kl"])

    return _weighed(docs, model).mapInArrow(divergence, "kl double").agg(F.sum("kl")).first()[0]


def save_topics(model: TopicModel, spark: SparkSession, path: str) -> None:
    """Write the model below ``path``: the weights and, as settings, what there is per topic."""
    model.weights.write.mode("overwrite").parquet(f"{path}/weights")
    write_settings(spark, {**asdict(model.params), "history": model.history, "size": model.size.tolist(), "b": model.b.tolist()},
                   f"{path}/settings")  # last, so that its presence tells that the model is whole


def load_topics(spark: SparkSession, path: str) -> TopicModel:
    settings = read_settings(spark, f"{path}/settings")
    history, size, b = (settings.pop(x) for x in ("history", "size", "b"))
    params = TopicParams(**{**settings, "ngram_range": tuple(settings["ngram_range"])})
    weights = spark.read.schema("gram string, w array<double>, a array<double>").parquet(f"{path}/weights")
    return TopicModel(params, weights, np.array(size), np.array(b), history)


def topic_table(model: TopicModel, column: str = "w") -> DataFrame:
    """(topic, gram, weight) of the fitted topics, or with ``column='a'`` of their running sums."""
    each = model.weights.select("gram", F.posexplode(F.zip_with(column, _per_topic(model.divisor()), lambda x, y: x / y)).alias("topic", "weight"))
    return each.select("topic", "gram", "weight")


def topic_labels(model: TopicModel, df: DataFrame, column: str, n_top: int = 3) -> DataFrame:
    """(topic, word, share, rank): the words each topic claims most of."""
    words = df.select(column).distinct().select(F.explode(words_of(F.col(column))).alias("word")).distinct()
    docs = _documents(words, "word", model.params)
    found = _with_activations(model, docs, 100).select("value", F.posexplode("h").alias("topic", "x"), F.aggregate(
        "h", F.lit(0.0), lambda s, x: s + x).alias("_all"))
    shares = found.select("topic", F.col("value").alias("word"), (F.col("x") / F.col("_all")).alias("share"))
    return top_per_group(shares, ["topic"], [F.desc("share"), F.col("word")], n_top)

"""Encoders against the pairwise functions and hand-computed values."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from motley.functions import hashing
from motley.functions import similarity as sim
from motley.operators import encoders as enc
from motley.operators import topics as top

TEST = ["Aa", "aAa", "aaa", "aaab", " aaa  c"]


def frame(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} STRING")


def encoded(model, spark, values):
    got = {r["v"]: list(r["encoded"]) for r in model.transform(frame(spark, values)).collect()}
    return [got[v] for v in values]


@pytest.mark.parametrize("similarity", ["levenshtein-ratio", "jaro", "jaro-winkler", "ngram"])
@pytest.mark.parametrize("categories,n", [("auto", None), ("most_frequent", 1), ("most_frequent", 2), ("most_frequent", 3),
                                          ("k-means", 2)])
def test_cells_equal_the_pairwise_function(spark, similarity, categories, n):
    fit = ["aac", "aaa", "aaab", "aaa", "aaab", "aaa", "aaab", "aaa"]
    model = enc.SimilarityEncoder("v", categories=categories, n_prototypes=n, similarity=similarity,
                                  ngram_range=(3, 3), seed=42).fit(frame(spark, fit))
    if categories == "most_frequent":
        assert model.categories_ == ["aaa", "aaab", "aac"][:n]
    rows = [(a, b) for a in TEST for b in model.categories_]
    fn = sim.METRICS[similarity]
    want = spark.createDataFrame(list(enumerate(rows)), "i INT, p STRUCT<a: STRING, b: STRING>").orderBy("i").select(
        fn(F.col("p.a"), F.col("p.b"))).collect()
    assert np.allclose(np.ravel(encoded(model, spark, TEST)), [r[0] for r in want])


def test_listed_equals_auto(spark):
    auto = enc.SimilarityEncoder("v", ngram_range=(2, 3)).fit(frame(spark, ["bar", "foo"]))
    listed = enc.SimilarityEncoder("v", categories=["bar", "foo"], ngram_range=(2, 3)).fit(frame(spark, ["bar", "foo"]))
    assert encoded(auto, spark, ["bar", "foo"]) == encoded(listed, spark, ["bar", "foo"])


def test_hashed_equals_plain_without_collisions(spark):
    plain = enc.SimilarityEncoder("v", categories=["bar", "foo"], ngram_range=(2, 2), hashing_dim=None)
    hashed = enc.ngram_similarity_hashed(frame(spark, ["foo", "baz"]), "v", ["bar", "foo"], (2, 2), 2**16)
    got = {(r["v"], r["proto"]): r["similarity"] for r in hashed.collect()}
    want = dict(zip(["foo", "baz"], encoded(plain.fit(frame(spark, ["foo"])), spark, ["foo", "baz"])))
    for v, row in want.items():
        for p, x in zip(["bar", "foo"], row):
            assert got.get((v, p), 0.0) == pytest.approx(x)


def test_unknown_and_bad_arguments(spark):
    with pytest.raises(ValueError):
        enc.SimilarityEncoder("v", categories=["foo", "bar"])
    with pytest.raises(ValueError):
        enc.SimilarityEncoder("v", categories="k-means", n_prototypes=0)
    with pytest.raises(ValueError):
        enc.SimilarityEncoder("v", categories=["bar"], handle_unknown="error").fit(frame(spark, ["foo"]))
    with pytest.raises(ValueError):
        enc.SimilarityEncoder("v", handle_unknown="error").fit(frame(spark, ["foo"])).transform(frame(spark, ["x"]))


def test_kmeans_prototypes(spark):
    assert enc.kmeans_prototypes(frame(spark, ["cbbba", "baaac", "accc"]), "v", 3) == ["accc", "baaac", "cbbba"]


def test_kmeans_prototypes_repeat(spark):
    chars = frame(spark, [f" {chr(i)} " for i in range(32, 127)])
    once = enc.kmeans_prototypes(chars, "v", 10, seed=435)
    assert once == enc.kmeans_prototypes(chars, "v", 10, seed=435)


COLOR = ["Red", "red", "green", "blue", "green", "green", "blue", "red"]


def test_target_encoding_binary(spark):
    rows = spark.createDataFrame(list(zip(COLOR, [1, 0, 0, 1, 0, 1, 0, 0])), "c STRING, y INT")
    model = enc.TargetMeanEncoder("c", "y").fit(rows)
    got = {r["c"]: r["encoded"] for r in model.transform(frame(spark, [*sorted(set(COLOR)), "new"], "c")).collect()}
    assert got == pytest.approx({"Red": 0.583333, "red": 0.1875, "green": 0.35, "blue": 0.4375, "new": 0.375}, abs=1e-6)
    with pytest.raises(ValueError):
        enc.TargetMeanEncoder("c", "y", handle_unknown="error").fit(rows).transform(frame(spark, ["new"], "c"))


def test_target_encoding_classes(spark):
    y = [1, 0, 2, 1, 0, 1, 0, 0]
    rows = spark.createDataFrame(list(zip(COLOR, y)), "c STRING, y INT")
    model = enc.TargetMeanEncoder("c", "y", classes=[0, 1, 2]).fit(rows)
    assert model.prior_ == pytest.approx([4 / 8, 3 / 8, 1 / 8])
    got = {r["c"]: r["encoded"] for r in model.transform(frame(spark, ["green", "new"], "c")).collect()}
    weight = 3 / (3 + 8 / 4)
    assert got["green"] == pytest.approx([weight / 3 + (1 - weight) * p for p in (4 / 8, 3 / 8, 1 / 8)])
    assert got["new"] == pytest.approx([4 / 8, 3 / 8, 1 / 8])


@pytest.mark.parametrize("hashing", ["fast", "murmur"])
def test_minhash_agreement_is_jaccard(spark, hashing):
    n = 600
    a, b = "senior project manager", "project manager assistant"
    rows = enc.MinHashEncoder("v", n, hashing=hashing).transform(frame(spark, [a, b]))
    got = {r["v"]: np.array(r["encoded"]) for r in rows.collect()}
    cut = lambda s: {s[i:i + k] for k in (2, 3, 4) for i in range(len(s) - k + 1)}
    ga, gb = (cut(a), cut(b)) if hashing == "fast" else (cut(f" {a} "), cut(f" {b} "))
    jaccard = len(ga & gb) / len(ga | gb)
    assert abs((got[a] == got[b]).mean() - jaccard) < 3 * (jaccard * (1 - jaccard) / n) ** 0.5 + 1e-9


def test_minhash_edges(spark):
    got = enc.MinHashEncoder("v", 4, hashing="murmur").transform(frame(spark, ["", " "])).collect()
    assert all(0 <= x <= 1 for r in got for x in r["encoded"])
    pairs = enc.MinHashEncoder("v", 4, minmax=True).transform(frame(spark, ["abcdef"])).first()["encoded"]
    assert len(pairs) == 4 and pairs[0] <= pairs[1] and pairs[2] <= pairs[3]
    with pytest.raises(ValueError):
        enc.MinHashEncoder("v", 3, minmax=True).transform(frame(spark, ["a"]))


WORDS = ["police officer", "police sergeant", "senior police officer", "bus driver", "bus operator", "truck driver"]


@pytest.mark.parametrize("init", ["k-means++", "random", "k-means"])
def test_topics(spark, init):
    rows = frame(spark, WORDS * 5)
    few = top.fit_topics(rows, "v", top.TopicParams(n_topics=3, max_iter=1, init=init, seed=2, hashing=False))
    many = top.fit_topics(rows, "v", top.TopicParams(n_topics=3, max_iter=6, init=init, seed=2, hashing=False))
    assert top.score_topics(many, rows, "v") <= top.score_topics(few, rows, "v") * 1.001
    assert np.allclose(numbers(many).groupby("topic").weight.sum(), 1)
    codes = top.transform_topics(many, rows, "v").collect()
    assert len(codes) == len(WORDS) * 5
    assert all(min(r["topics"]) >= 0 and len(r["topics"]) == 3 for r in codes)
    # an unknown value without known n-grams keeps only the prior
    odd = top.transform_topics(many, frame(spark, ["ΩΩΩ"]), "v").first()["topics"]
    assert odd == pytest.approx([0.05] * 3)


def numbers(model, column="w"):
    return top.topic_table(model, column).toPandas().sort_values(["topic", "gram"]).reset_index(drop=True)


def test_topic_batches_use_every_row_once(spark):
    rows = frame(spark, WORDS * 7)
    model, docs = top._start(rows, "v", top.TopicParams(n_topics=2, n_batches=3, init="random", hashing=True))

    def sums(batches):
        found = [top._step_sums(docs, top.replace(model, params=top.replace(model.params, n_batches=batches)), b) for b in range(batches)]
        grams = sum((f.toPandas().set_index("gram")[["x0", "x1"]] for f, *_ in found[1:]), found[0][0].toPandas().set_index("gram")[["x0", "x1"]])
        return grams.sort_index().to_numpy(), sum(t for _, t, _ in found)

    for parts, whole in zip(sums(3), sums(1)):
        assert np.allclose(parts, whole)


def test_a_step_by_hand(spark):
    """Two values, two n-grams, one round of activations, then a step; and again from where it ended."""
    rows = frame(spark, ["ab", "ab", "abc"])
    p = top.TopicParams(n_topics=2, hashing=False, ngram_range=(2, 2), inner_iter=1, n_batches=1, rho=0.5)
    start = {" a": (3.0, 1.0), "ab": (1.0, 1.0), "bc": (1.0, 2.0)}
    grams = {"ab": {"ab": 1}, "abc": {"ab": 1, "bc": 1}}
    model = top.given_topics(spark.createDataFrame([(g, list(w)) for g, w in start.items()], "gram STRING, w ARRAY<DOUBLE>"), p)
    w = np.array([start[g] for g in sorted(start)]).T
    w = w / w.sum(axis=1, keepdims=True)
    a, b = np.full_like(w, 1e-10), np.full(2, 1e-10)
    names = sorted(start)
    for _ in range(2):
        model = top.step_topics(model, rows, "v")
        x, t = np.zeros_like(w), np.zeros(2)
        for value, n in (("ab", 2), ("abc", 1)):
            v = np.array([grams[value].get(g, 0) for g in names], float)
            h = np.full(2, v.sum() / 2)
            h = h * (w @ (v / (h @ w))) / 2 + 0.1 / 2
            x += n * h[:, None] * (v / (h @ w))[None, :]
            t += n * h
        a, b = a * 0.5 + w * x, b * 0.5 + t
        w = a / b[:, None]
        a, w = a / w.sum(axis=1, keepdims=True), w / w.sum(axis=1, keepdims=True)
        assert np.allclose(numbers(model).weight, w.ravel()) and np.allclose(numbers(model, "a").weight, a.ravel()) and np.allclose(model.b, b)


def test_nothing_of_vocabulary_size_on_the_driver():
    source = inspect.getsource(top)
    assert "toPandas" not in source and "toArrow" not in source and source.count(".collect()") == 1  # the starting values


def test_partial_fit_and_labels(spark):
    model = None
    for _ in range(4):
        model = top.partial_fit_topics(model, frame(spark, WORDS), "v", top.TopicParams(n_topics=2))
    labels = top.topic_labels(model, frame(spark, WORDS), "v", 2).collect()
    assert {r["topic"] for r in labels} == {0, 1} and all(0 <= r["share"] <= 1 for r in labels)


def test_rbf_features_approximate_the_kernel(spark):
    x = np.random.RandomState(0).normal(size=(4, 5))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i INT, x ARRAY<DOUBLE>")
    z = {r["i"]: np.array(r["features"]) for r in enc.rbf_features(rows, "x", 20000, 0.1).collect()}
    want = np.exp(-0.1 * ((x[0] - x[1]) ** 2).sum())
    assert z[0] @ z[1] == pytest.approx(want, abs=0.05)


def test_min_hashes_are_made_once_per_value(spark):
    """No filter in the plan repeats the hashing, and it stands above the distinct."""
    rows = spark.createDataFrame([("ab cd",), ("ab cd",), (None,), ("",)], "job_title STRING")
    for options in ({"hashing": "murmur"}, {"minmax": True}):
        out = enc.MinHashEncoder("job_title", 4, **options).long(rows)
        plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert not any("Filter" in line and "transform" in line for line in plan)
        assert next(i for i, x in enumerate(plan) if "transform" in x) < next(i for i, x in enumerate(plan) if "Aggregate" in x)
        assert out.groupBy("job_title").count().orderBy("job_title").collect() == [("", 4), ("ab cd", 4)]


@pytest.mark.parametrize("options", [{}, {"minmax": True}, {"hashing": "murmur"}, {"ngram_range": (1, 1)}, {"ngram_range": (3, 5)}])
def test_minhash_by_batches_equals_the_columns(spark, options):
    """Texts of a batch with few and with many characters, short, empty, null and repeated ones."""
    rng = np.random.RandomState(0)
    texts = ["", None, "a", "ab", " ", "Aa  b\n\tc", "\U0001f600é中ß" * 5, "x" * 300, "ab", "ab" * 50,
             "".join(map(chr, rng.randint(0x4e00, 0x9fff, 3000)))]
    texts += ["".join(rng.choice(list("abcde "), rng.randint(0, 60))) for _ in range(50)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id INT, v STRING").coalesce(1)
    plain = lambda c: hashing.portable(c)
    both = rows.select("id", enc.minhash(F.col("v"), 6, hashed=plain, **options).alias("want"),
                       enc.minhash(F.col("v"), 6, hashed=hashing.portable, **options).alias("got")).collect()
    assert len(both) == len(texts) and all(r.got == r.want for r in both)


def test_minhash_hashes_a_repeated_gram_once(monkeypatch):
    from motley.functions import gram_batches as lh
    asked = []
    count = lambda piece: asked.append(piece) or hashing.portable_value(piece)
    texts = ["the same words", "same words", "words the same"] * 200
    whole = lh.least_hashes(texts, range(2, 5), 16, hashed=count)
    assert len(asked) == len(set(asked)) < 150
    monkeypatch.setattr(lh, "ROOM", 20)
    assert (lh.least_hashes(texts, range(2, 5), 16) == whole).all()

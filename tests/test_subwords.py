"""Vectors of unknown words from known ones."""

import numpy as np
import pytest

from motley.operators import subwords as sub

WORDS = [("manager", [2.0, 0.0]), ("driver", [0.0, 3.0]), ("", [1.0, 1.0]), (None, [1.0, 0.0]), ("lost", None), ("half", [1.0, None])]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame(WORDS, "word string, vector array<double>").cache()


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "word string")


def test_misspelt_words(spark, words):
    asked = frame(spark, ["manager", "manger", "drver", "zzz", "man", "manager", None, "lost", "mriver"])
    got = {r.word: (r.vector, r.known) for r in sub.vectors_of_words(asked, words, sub.gram_vectors(words)).collect()}
    assert set(got) == {"manager", "manger", "drver", "zzz", "man", "lost", "mriver"}
    assert got["manager"] == ([1.0, 0.0], True) and got["zzz"] == (None, False) and got["lost"] == (None, False)
    known = {w: np.array(v) / np.linalg.norm(v) for w, v in WORDS[:3]}
    for word in ("manger", "drver", "man", "mriver"):
        shared = [np.mean([known[w] for w in known if g in cut(w)], axis=0) for g in cut(word) if any(g in cut(w) for w in known)]
        want = np.mean(shared, axis=0)
        assert got[word] == (pytest.approx(want / np.linalg.norm(want)), False)
    assert got["manger"][0][0] > 0.9 and got["mriver"][0][1] > got["mriver"][0][0] > 0


def cut(word):
    marked = f"<{word}>"
    return {marked[i:i + k] for k in (3, 4, 5) for i in range(len(marked) - k + 1)}


@pytest.fixture(scope="module")
def shares(spark, words):
    return {r.gram: r.vector for r in sub.gram_vectors(words).collect()}


def test_gram_vectors(shares):
    assert shares["er>"] == pytest.approx([0.5, 0.5]) and shares["<man"] == [1.0, 0.0] and shares["ver>"] == [0.0, 1.0]
    assert not any("lo" in g or "ha" in g for g in shares)


def test_titles(spark, words):
    titles = spark.createDataFrame([("manager driver",), ("manger",), ("zzz zzz",), (None,), (" driver  zzz",)], "title string")
    got = {r.title: r.vector for r in sub.embed_with_subwords(titles, "title", words, sub.gram_vectors(words)).collect()}
    assert got["manager driver"] == [0.5, 0.5] and got["manger"][0] > 0.9 and got["zzz zzz"] is None and got[" driver  zzz"] == [0.0, 1.0]
    assert set(got) == {"manager driver", "manger", "zzz zzz", " driver  zzz"}
    assert sub.gram_vectors(words.limit(0)).count() == 0


def test_training(spark):
    """Words used alike get closer vectors, and a misspelt one lies near its own."""
    rng = np.random.default_rng(2)
    texts = [(" ".join(rng.choice(["police", "officer", "patrol"], 6)),) for _ in range(150)] + [
        (" ".join(rng.choice(["truck", "driver", "wheel"], 6)),) for _ in range(150)] + [(None,)]
    words = sub.train_words(spark.createDataFrame(texts, "t string"), "t", size=8, rounds=8)
    found = sub.vectors_of_words(frame(spark, ["police", "officer", "driver", "offcer"]), words, sub.gram_vectors(words)).collect()
    v = {r.word: np.array(r.vector) for r in found}
    assert v["police"] @ v["officer"] > v["police"] @ v["driver"] and v["offcer"] @ v["officer"] > v["offcer"] @ v["driver"]

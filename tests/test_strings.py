"""String similarities against known values and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from motley.functions import grams, text
from motley.functions import similarity as sim
from motley.operators import edit_join, pairs

EDITS = [
    ("", "", 0), ("", "abc", 3), ("abc", "", 3), ("abc", "abc", 0), ("abcd", "abc", 1), ("abc", "abcd", 1),
    ("xbcd", "abcd", 1), ("axcd", "abcd", 1), ("abxd", "abcd", 1), ("abcx", "abcd", 1), ("axcx", "abcd", 2),
    ("axcx", "abcde", 3),
]


def random_pairs(n=50, top=9999, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(chr(rng.randint(1, top)) for _ in range(rng.randint(0, 49)))
    return [(word(), word()) for _ in range(n)]


def jaro_by_hand(a, b, floor=False):
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, left = list(range(len(b))), []
    for i, ch in enumerate(a):
        hit = next((j for j in free if b[j] == ch and abs(i - j) <= reach), None)
        if hit is not None:
            free.remove(hit)
            left.append(ch)
    right = [b[j] for j in range(len(b)) if j not in free]
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(left, right)) / 2
    moved = int(moved) if floor else moved
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def frame(spark, rows):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i INT, a STRING, b STRING")


def values(spark, rows, column):
    return [r[0] for r in frame(spark, rows).orderBy("i").select(column).collect()]


def test_levenshtein_examples(spark):
    assert values(spark, [(a, b) for a, b, _ in EDITS], sim.levenshtein(F.col("a"), F.col("b"))) == [d for *_, d in EDITS]


def test_levenshtein_ratio_bounds(spark):
    got = values(spark, [("", ""), ("abc", "abc"), ("abc", ""), ("abcd", "abcx")], sim.levenshtein_ratio(F.col("a"), F.col("b")))
    assert got == [1.0, 1.0, 0.0, 7 / 8]


@pytest.mark.parametrize("metric", ["levenshtein", "levenshtein-ratio", "ngram", "jaro"])
def test_symmetry(spark, metric):
    rows = random_pairs()
    fn = sim.METRICS[metric]
    one = values(spark, rows, fn(F.col("a"), F.col("b")))
    two = values(spark, rows, fn(F.col("b"), F.col("a")))
    assert one == pytest.approx(two)


@pytest.mark.parametrize("floor", [True, False])
def test_jaro_against_python(spark, floor):
    rng = random.Random(3)
    rows = [("".join(rng.choices("abcde", k=rng.randint(0, 12))), "".join(rng.choices("abcde", k=rng.randint(0, 12))))
            for _ in range(300)]
    got = values(spark, rows, sim.jaro(F.col("a"), F.col("b"), "floor" if floor else "half"))
    assert got == pytest.approx([jaro_by_hand(a, b, floor) for a, b in rows])


def test_jaro_boundaries(spark):
    rows = [("Brian", "Jesus"), ("same", "same"), ("abc", "abd")]
    assert values(spark, rows, sim.jaro(F.col("a"), F.col("b")))[:2] == [0.0, 1.0]
    plain = values(spark, rows, sim.jaro(F.col("a"), F.col("b")))
    # three characters are too short for the prefix bonus
    assert values(spark, rows, sim.jaro_winkler(F.col("a"), F.col("b"))) == pytest.approx(plain)


def test_trigram_counts(spark):
    repeated = [("aaa" * i, "") for i in range(1, 7)]
    assert values(spark, repeated, grams.trigram_count(F.col("a"))) == [1] * 6
    prefixes = [("abcdefghifk"[: i + 2], "") for i in range(1, 7)]
    assert values(spark, prefixes, grams.trigram_count(F.col("a"))) == [1, 2, 3, 4, 5, 6]
    assert values(spark, [(a, a) for a, _ in prefixes], grams.trigram_common(F.col("a"), F.col("b"))) == [1, 2, 3, 4, 5, 6]


def test_short_strings_have_no_grams(spark):
    assert values(spark, [("ab", ""), ("", "")], F.size(grams.windows(F.col("a"), 3))) == [0, 0]


def test_ngram_similarity_counts_repeats(spark):
    # ' aaa ' and ' aa ': ' a', 'aa', 'aa', 'a ' against ' a', 'aa', 'a '
    got = values(spark, [("aaa", "aa")], sim.ngram_similarity(F.col("a"), F.col("b"), 2))
    assert got == [3 / 4]


def test_cleaning(spark):
    rows = [("Small,  RING-2 ", ""), ("  Mgr  I ", ""), ("élan;x", "")]
    assert values(spark, rows, text.clean_title(F.col("a"))) == ["small ring 2 ", " mgr i ", "élan x"]
    assert values(spark, rows, text.clean_matched_title(F.col("a"))) == ["small ring 2", "mgr i", "élan x"]
    assert values(spark, [("Sr Mgr, rsrch I 12", "")], text.expand_abbrev(F.col("a"))) == ["senior manager, rsrch I-ONE "]


def brute(left, right, metric, min_score, spark):
    rows = [(a, b) for a in left for b in right]
    got = values(spark, rows, sim.METRICS[metric](F.col("a"), F.col("b")))
    return {(a, b): s for (a, b), s in zip(rows, got) if s >= min_score}


@pytest.mark.parametrize("metric,min_score", [
    ("ngram", 0.3), ("levenshtein-ratio", 0.75), ("jaro", 0.8), ("jaro-winkler", 0.9)])
def test_similarity_join_finds_every_pair(spark, metric, min_score):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdef ", k=rng.randint(1, 10)))
    left = sorted({word() for _ in range(60)})
    right = sorted({w[:-1] + rng.choice("abcx") for w in left} | {word() for _ in range(30)} | set(left[:5]))
    out = pairs.similarity_join(
        spark.createDataFrame([(x,) for x in left], "a STRING"), spark.createDataFrame([(x,) for x in right], "b STRING"),
        "a", "b", metric, min_score)
    got = {(r["a"], r["b"]): r["score"] for r in out.collect()}
    assert got == pytest.approx(brute(left, right, metric, min_score, spark))


def test_similarity_join_with_block(spark):
    left = spark.createDataFrame([("ab",), ("cd",)], "a STRING")
    right = spark.createDataFrame([("ax",), ("cy",)], "b STRING")
    out = pairs.similarity_join(left, right, "a", "b", "levenshtein-ratio", 0.0,
                                block_on=(F.substring("a", 1, 1), F.substring("b", 1, 1)))
    assert {(r["a"], r["b"]) for r in out.collect()} == {("ab", "ax"), ("cd", "cy")}


def test_low_score_needs_a_block(spark):
    with pytest.raises(ValueError):
        edit_join.shares_needed("jaro", 0.5)


def names(n, seed):
    """Names of several words, and copies of them with a few edits."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnoprstu", k=rng.randint(3, 9))) for _ in range(60)]
    out = {" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(n)}
    for name in list(out)[: n // 2]:
        chars = list(name)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(chars))
            chars[i:i + rng.randint(0, 1)] = rng.choice(["", "x", "yz", " "])
        out.add("".join(chars))
    return sorted(out)


def frames(spark, left, right):
    return (spark.createDataFrame([(x,) for x in left], "a STRING").repartition(3),
            spark.createDataFrame([(x,) for x in right], "b STRING"))


@pytest.mark.parametrize("metric,min_score", [
    ("levenshtein-ratio", 0.9), ("levenshtein-ratio", 0.8), ("levenshtein-ratio", 0.6), ("jaro-winkler", 0.9), ("jaro", 0.85)])
def test_candidates_are_few_and_complete(spark, metric, min_score):
    left, right = names(150, 1), names(140, 2) + names(150, 1)[::3]
    a, b = frames(spark, left, right)
    want = brute(left, sorted(set(right)), metric, min_score, spark)
    got = {(r["a"], r["b"]): r["score"] for r in pairs.similarity_join(a, b, "a", "b", metric, min_score).collect()}
    assert got == pytest.approx(want) and len(got) > len(left) // 3
    if min_score >= 0.9:
        near = edit_join.string_candidates(a, b, "a", "b", metric, min_score).count()
        assert near < 0.1 * len(left) * len(set(right))


@pytest.mark.parametrize("edits", [0, 1, 2, 4])
def test_edit_join(spark, edits):
    """Also for strings with fewer characters than edits, and the published pairs."""
    left = sorted({a for a, *_ in EDITS} | {"", "a", "ab", "xyz", "日本語"} | set(names(40, 5)))
    right = sorted({b for _, b, _ in EDITS} | {"", "b", "yxz", "日語本"} | set(names(40, 5)))
    a, b = frames(spark, [*left, None, "a"], [*right, None])
    got = {(r["a"], r["b"]): r["distance"] for r in edit_join.edit_join(a, b, "a", "b", edits).collect()}
    assert got == {(x, y): d for x in left for y in right if (d := levenshtein_by_hand(x, y)) <= edits}
    for x, y, d in EDITS:
        assert ((x, y) in got) == (d <= edits)


def levenshtein_by_hand(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_edit_join_bounds(spark):
    a, b = frames(spark, ["ab"], ["ab"])
    with pytest.raises(ValueError):
        edit_join.edit_candidates(a, b, "a", "b", min_ratio=0.6)
    with pytest.raises(ValueError):
        pairs.similarity_join(a, b, "a", "b", "ngram", 0.0)
    assert pairs.similarity_join(a.limit(0), b, "a", "b", "jaro-winkler", 0.9).count() == 0


def test_joins_are_equi_joins(spark):
    a, b = frames(spark, ["ab"], ["ab"])
    for metric, score in (("levenshtein-ratio", 0.9), ("jaro", 0.8)):
        plan = pairs.similarity_join(a, b, "a", "b", metric, score)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_trigram_counts_of_texts(spark):
    """Counted in the row of a text; keys of several rows, the null one too, are added up."""
    from collections import Counter
    rng = random.Random(0)
    texts = ["", "a", "aaa" * 20, "\U0001f600\U0001f600é中ß" * 5, "a\n\n\nb  \r\n", "\\1$(.)" * 3, None]
    texts += ["".join(rng.choice("ab \U0001f600") for _ in range(rng.randint(0, 80))) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "abab"), (1, None), (None, "abc"), (None, "abc"), (None, None)]
    want = Counter()
    for key, text in rows:
        padded = None if text is None else f"  {text}  "
        want.update([(key, None)] if text is None else [(key, padded[i:i + 3]) for i in range(len(padded) - 2)])
    df = spark.createDataFrame(rows, "k INT, v STRING")
    found = pairs.trigram_counts(df, "k", "v")
    assert found.schema["n"].dataType.simpleString() == "bigint"
    assert {(r.k, r.gram): r.n for r in found.collect()} == want and found.count() == len(want)


def test_trigrams_of_single_keys_are_not_shuffled(spark):
    rows = spark.range(40).select(F.col("id").alias("k"), F.repeat(F.lit("some words "), 50).alias("v"))
    found = pairs.trigram_counts(rows, "k", "v")
    assert len(found.collect()) == found.count() == 40 * 14
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "hashpartitioning" not in final

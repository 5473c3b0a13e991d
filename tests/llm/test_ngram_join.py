"""The n-gram join against all pairs by the Jaccard similarity of their shingles."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from motley.llm import ngram_join as nj


def shingles(text, size=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1)) if words)


def brute(rows):
    """(id, size of the set, smallest reachable id) by comparing all pairs."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and label[i] != label[j] and 100 * common >= 90 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    least = {x: min((rows[i][0] for i in range(len(rows)) if label[i] == x and rows[i][0] is not None), default=None) for x in label}
    return sorted(((i, len(s), least[x]) for (i, _), s, x in zip(rows, sets, label)), key=str)


def near_texts(seed=4, families=(20, 60, 100, 250, 400)):
    """Texts with few to many replaced words, around a passage that all of them hold."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(3_000)]
    passage, out = list(rng.choice(words, 40)), []
    for size in families:
        base = list(rng.choice(words, size))
        for edits in (0, 1, 1, 2, 2, 3, 4, 5, 6, 9):
            text = list(base)
            for i in rng.choice(size, edits, replace=False):
                text[i] = rng.choice(words)
            out.append(" ".join(text + passage * (size > 60)))
    return list(enumerate(out))


def check(spark, rows, parts=3, **settings):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, s string").repartition(parts)
    got = sorted((tuple(r) for r in nj.groups(docs, **settings).collect()), key=str)
    assert got == brute(rows)
    return got


def test_shingle_table():
    texts = ["", "One two", "one TWO three four five", " one two\nthree four five six ", "ä ö", "a a a a a a a a a", "one two"]
    for size in (1, 3, 5):
        owner, found = nj.shingle_table(texts, size)
        sets = [frozenset(found[owner == i].tolist()) for i in range(len(texts))]
        for i, a in enumerate(texts):
            for j, b in enumerate(texts):
                assert len(sets[i] & sets[j]) == len(shingles(a, size) & shingles(b, size)), (a, b)
    long = ["x " * 30_000 + "end", "x " * 3_000 + "end"]
    owner, found = nj.shingle_table(long, 5)
    assert np.array_equal(found[owner == 0], found[owner == 1])
    assert all(len(x) == 0 for x in nj.shingle_table([], 3) + nj.shingle_table(["", " "], 3))


@pytest.mark.parametrize("few, common", [(16, 32), (4, 32), (1, 3), (2, 2)])
def test_every_pair(spark, monkeypatch, few, common):
    """However far lists are taken apart, and whatever the order of shingles."""
    monkeypatch.setattr(nj, "COMMON", common)
    monkeypatch.setattr(nj, "OVER", 0)
    got = check(spark, near_texts(few), few=few)
    assert 10 < len({g for *_, g in got}) < 45


def test_short_sets(spark):
    """Sets so small that a prefix cannot ask for more shared shingles than there are."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(list("abc"), rng.integers(1, 6)))) for i in range(150)]
    rows += [(200 + i, " ".join(f"w{j}" for j in range(22) if j != 30 - i)) for i in range(12)]
    check(spark, rows)
    check(spark, rows, few=1)


def test_odd_rows(spark):
    long = " ".join(f"w{i * i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "ONE"), (None, "one"), (None, "alone here"), (5, long),
            (6, long + " end"), (None, "alone here"), (7, "one\x1ctwo three four"), (8, "one two")]
    check(spark, rows)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, k int, root string")
    assert nj.groups(docs.limit(0)).count() == 0 and nj.groups(docs.where("doc_id < 4")).where("component_id = doc_id").count() == 3
    named = nj.groups(docs.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("body")), "name", "body")
    assert named.where("name = '4'").select("component_id").distinct().collect() == [("4",)]


def test_lists_choose_the_prefix(spark):
    """Crowded lists lengthen the prefix; a set that shares too little is out."""
    rows = [(1, 20, pos, 500) for pos in range(3)] + [(1, 20, pos, 2) for pos in range(3, 6)]
    rows += [(2, 20, pos, 2) for pos in range(3)] + [(2, 20, pos, 500) for pos in range(3, 6)] + [(3, 20, 4, 900)]
    shared = spark.createDataFrame(rows, "s long, n int, pos int, df int")
    assert sorted(map(tuple, nj._chosen(shared).collect())) == [(1, 4), (2, 1)]


def test_crowded_lists(spark):
    """A large group around one text, most of it alike below the bound, and a second passage that some members share."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(4_000)]
    base, extra = list(rng.choice(words, 150)), list(rng.choice(words, 30))
    rows = []
    for i in range(160):
        text = list(base) + (list(extra) if i % 3 == 0 else [])
        for j in rng.choice(len(text), rng.integers(0, 9), replace=False):
            text[j] = f"e{rng.integers(0, 40)}" if i % 2 else f"u{i}x{j}"
        rows.append((i, " ".join(text)))
    got = check(spark, rows, few=2)
    assert 20 < len({g for *_, g in got}) < 160

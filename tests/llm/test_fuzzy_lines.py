"""Fuzzy line dedup against all pairs of lines, and its defined results for odd input."""

import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motley.llm import fuzzy_lines as fl
from motley.llm.common import table


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@given(st.text("abc", max_size=30), st.text("abcé", max_size=30))
def test_edit_distance(a, b):
    assert fl.edit_distance(a, b) == levenshtein(a, b)


def test_line_table(monkeypatch):
    texts = ["", "A b-c 12 d\n\nÄ ö  日本 x9x99 y 007\tz\n" + "w" * 5_000 + " a b c d", "no", "a b c 0 d\n" + "q " * 70_000]
    text, pos, h, f, norms = fl.line_table(texts, 5, True)
    assert list(zip(text.tolist(), pos.tolist())) == [(1, 0), (1, 2), (1, 3), (3, 0), (3, 1)]
    assert norms[:2] == ["a b c 0 d", "ä ö 日本 x0x0 y 0 z"] and norms == [norm(texts[t].split("\n")[p]) for t, p in zip(text, pos)]
    assert h[0] == h[3] and f[0] == f[3] and len(set(h.tolist())) == 4
    for size in (1, 7):  # neither the slice nor the place of a line matters
        monkeypatch.setattr(fl, "_WORDS", size)
        again = [fl.line_table([n], 1) for n in norms]
        assert [int(a[2][0]) for a in again] == h.tolist() and [int(a[3][0]) for a in again] == f.tolist()


def norm(line):
    return re.sub("[0-9]+", "0", re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", line.lower())).strip(" ")


def brute(rows, short=False):
    """Kept lines per row by comparing all distinct normalised lines; with ``short`` equal short ones count too."""
    occurrences = [(i, p, norm(x)) for i, t in rows for p, x in enumerate((t or "").split("\n"))]
    few = sorted({o[2] for o in occurrences if o[2] and len(o[2].split(" ")) < fl.MIN_WORDS}) if short else []
    occurrences = [o for o in occurrences if len(o[2].split(" ")) >= fl.MIN_WORDS or o[2] in set(few)]
    distinct = sorted({o[2] for o in occurrences} - set(few))
    prints = fl.line_table(distinct, 1)[3] if distinct else np.zeros(0, np.uint64)
    label = list(range(len(distinct)))
    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1:] ^ prints[i]) <= fl.DISTANCE) + i + 1:
            if fl.similar(distinct[i], distinct[j], fl.SIMILARITY):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    group = {**dict(zip(distinct, label)), **{n: n for n in few}}
    first = {}
    for i, p, n in sorted(occurrences):
        first.setdefault(group[n], (i, p))
    gone = {(i, p) for i, p, n in occurrences if first[group[n]] != (i, p)}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)
            for i, t in rows}


def check(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.text for r in fl.drop_repeats(docs).collect()}
    assert got == brute(rows)
    return got


def near_lines(n):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(400)]
    base = list(rng.choice(words, 60))
    out = []
    for i in range(n):
        line = list(base)
        for _ in range(rng.integers(0, 3)):
            line[rng.integers(0, 60)] = rng.choice(words)
        out.append((i, " ".join(line) + f" {i}\n" + " ".join(rng.choice(words, 12))))
    return out


def test_whole_table(spark, sf):
    check(spark, table(spark, sf, "documents"))


@pytest.mark.parametrize("chunk", [2_048, 7])
def test_large_buckets(spark, monkeypatch, chunk):
    monkeypatch.setattr(fl, "CHUNK", chunk)
    docs = spark.createDataFrame(near_lines(120), "doc_id long, text string")
    got = check(spark, docs)
    assert sum("\n" not in t for t in got.values()) > 60


def test_chunks_cover_runs():
    import pyarrow as pa
    keys = np.sort(np.random.default_rng(1).integers(0, 40, 300))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:a + 13])], names=["k"]) for a in range(0, 300, 13)]
    seen = {}
    for (k,), number in fl._runs(batches, ["k"]):
        assert len(set(k)) == 1 and seen.get(k[0], (0, 0))[1] == number
        seen[k[0]] = (seen.get(k[0], (0, 0))[0] + len(k), number + 1)
    assert {k: v[0] for k, v in seen.items()} == {k: n for k, n in zip(*np.unique(keys, return_counts=True)) if n > 1}


def test_odd_rows(spark):
    line = "one two three four five six"
    rows = [(1, line + "\n\nshort"), (2, "One, two; three four five SIX!\nshort"), (3, None), (4, ""), (None, line),
            (5, line + "\n" + line), (6, "new words are kept in this line\n" + line), (6, "new words are kept in this line\n" + line)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, th int, gone string")
    out = fl.drop_repeats(docs, removed_col="removed")
    assert out.columns == ["doc_id", "text", "th", "gone", "removed"]
    got = sorted((r.doc_id or 99, r.text or "", r.removed) for r in out.collect())
    kept = "new words are kept in this line"
    assert got == [(1, line + "\n\nshort", 0), (2, "short", 1), (3, "", 0), (4, "", 0), (5, "", 2), (6, kept, 1),
                   (6, kept, 1), (99, "", 1)]
    assert out.where("doc_id = 3").first().text is None
    assert fl.drop_repeats(docs.limit(0)).count() == 0


def test_long_text(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(40_000))
    docs = spark.createDataFrame([(1, long), (2, long + "x\nother words that stand only here")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in fl.drop_repeats(docs).collect()}
    assert got == {1: long, 2: "other words that stand only here"}
    assert docs.select(F.length("text")).first()[0] > 200_000

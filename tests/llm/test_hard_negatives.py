"""Hard negatives against all pairs, over many shards and blocks and on odd rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from motley.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, q long, at string"


def brute(rows, every=50, scale=256):
    """Sorted result rows by comparing every anchor with every row."""
    kept = set()
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.add((i, label, tuple(max(-2 ** 63, min(2 ** 63 - 1, math.floor(x * scale))) for x in v)))
    out = []
    for i, label, v in kept:
        if i % every:
            continue
        scored = [(max(-2 ** 63 + 1, min(2 ** 63 - 1, sum(a * b for a, b in zip(v, w)))), j, other) for j, other, w in kept if j != i]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for ps, p, _ in [x for x in scored if x[2] == label][:5]:
            found = [x for x in scored if x[2] != label and 50 * ps <= 100 * x[0] <= 95 * ps][:3]
            out += [(i, p, rank, n, ps, ns) for rank, (ns, n, _) in enumerate(found, 1)]
    return sorted(out)


def check(spark, rows, **settings):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in hn.mine(df, **settings).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == brute(rows, settings.get("every", 50))
    return got


def vectors(n, seed, width=12, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return [(i, [float(x) for x in centres[i % 6] * rng.uniform(0.2, 2) + rng.normal(size=width) * spread], int(rng.integers(4)))
            for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(hn, "SHARD", 40)
    monkeypatch.setattr(hn, "BLOCK", 5)
    monkeypatch.setattr(hn, "PER_CENTRE", 8)


@pytest.mark.parametrize("spread", [0.02, 0.4, 3.0])
def test_all_pairs(spark, small, spread):
    assert check(spark, vectors(700, 3, spread=spread), every=10)


def test_odd_rows(spark, small):
    inf, nan = float("inf"), float("nan")
    rows = vectors(60, 5) + [
        (None, [1.0] * 12, 1), (100, None, 1), (100, [1.0, None], 1), (100, [nan, 1.0], 1), (150, [inf], 2), (200, [1.0] * 12, None),
        (300, [], 0), (350, [0.0] * 12, 1), (400, [0.5], 2), (450, [0.5] * 20, 3), (450, [0.5] * 20, 3), (450, [0.25] * 20, 2),
        (500, [1e300, -1e300], 1), (501, [1e300, 3.0], 1), (502, [1e18] * 3, 0), (550, [-1.0] * 12, 9), (551, [-1.0] * 12, 9),
        (600, [1.0] * 12, 7), (601, [1.0] * 12, 7), (602, [0.75] * 12, 6), (604, [0.75] * 12, 6), (603, [0.75] * 12, 6)]
    assert check(spark, rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert hn.mine(df.limit(0)).count() == 0 and hn.mine(df.where("vec_id = 1")).count() == 0


def test_one_label_and_copies(spark, small):
    """A third of all rows are one vector; a label no anchor shares with another row has no positives."""
    rows = vectors(90, 8) + [(1_000 + i, [1.0, 0.5], 1) for i in range(60)] + [(2_000, [1.0, 0.6], 3), (2_050, [1.0], 77)]
    check(spark, rows, every=25)


def test_walks_end_early(monkeypatch):
    """Members stop where the shared list cannot hold anything better."""
    monkeypatch.setattr(hn, "TILE", 16)
    rng = random.Random(4)
    rows = [[1_000, rng.randrange(-40, 40)] if i < 40 else [rng.randrange(-40, 40), 1_000] for i in range(800)]
    own, other = ({"v": np.array(v, dtype=np.int64), "id": np.arange(len(v)), "label": np.zeros(len(v), dtype=np.int64)}
                  for v in ([[900, 10], [900, -10]], rows))
    best = hn._Best(2, 5)
    looked = hn._walk(own, other, np.array([1.0, 0.0]), lambda a, s, same, ids: best.add(a, s, ids),
                      lambda active, bound: best.least[active] > bound)
    want = [sorted(((-int(np.dot(u, w)), i) for i, w in enumerate(rows)))[:5] for u in own["v"]]
    assert [(-s, i) for s, i in zip(best.score.tolist(), best.id.tolist())] == want[0] + want[1]
    assert looked <= 2 * 4


def test_bands():
    for score in range(0, 400):
        low, high = hn.bands(score)
        assert [n for n in range(-5, 400) if 50 * score <= 100 * n <= 95 * score] == list(range(low, high + 1))


def test_products_beyond_64_bits():
    big = np.array([[2 ** 62, -2 ** 63]])
    assert hn.products(big, np.array([[4, 0], [0, 4], [1, 0]])).tolist() == [[2 ** 63 - 1, -2 ** 63 + 1, 2 ** 62]]
    assert hn.matrix(pa.array([[1, 2, 3], [], [4]]), 2).tolist() == [[1, 2], [0, 0], [4, 0]]

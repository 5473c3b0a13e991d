"""Packing: every token once, no bin over its size, and the plan equal to best-fit one item at a time."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motley.llm import packing
from motley.llm.common import table
from motley.llm.running import running_sums


def placed(plan, counts):
    rows = [(n, i) for n, c in counts.items() for i in range(c)]
    length, item = (np.array(x, dtype=np.int64) for x in zip(*rows))
    return length, *packing.place(*plan.lookup(), length, item)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=30))
def test_plan_holds_everything_once(counts):
    plan = packing.Plan(counts, (16, 32, 64), 4)
    length, bins, offset, size, used = placed(plan, counts)
    assert set(bins) == set(range(plan.bins))
    for b in range(plan.bins):
        at = np.flatnonzero(bins == b)
        at = at[np.argsort(offset[at])]
        assert offset[at].tolist() == (np.cumsum(length[at]) - length[at]).tolist()
        assert used[at[0]] == length[at].sum() <= size[at[0]]
        assert size[at[0]] == min(s for s in (16, 32, 64) if s >= used[at[0]])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), min_size=1, max_size=20))
def test_one_size_is_best_fit_decreasing(counts):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [r for r in rooms if r >= length]
            if fitting:
                rooms.remove(min(fitting))
                rooms.append(min(fitting) - length)
            else:
                rooms.append(50 - length)
    plan = packing.Plan(counts, (50,), 0)
    assert sorted(50 - used for _, n, used in plan.classes for _ in range(n)) == sorted(rooms)


def test_cost_chooses_the_size():
    assert [u for *_, u in packing.Plan({10: 3}, (16, 32), 64).classes] == [30]
    assert packing.Plan({16: 4}, (16, 64), 0).bins == 4  # equal cost: the smaller size
    assert packing.Plan({16: 4}, (16, 64), 8).bins == 1


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    out = packing.pack(docs, F.octet_length("text")).toPandas()
    want = docs.select("doc_id", F.octet_length("text").alias("n")).toPandas().set_index("doc_id").n
    assert (out.groupby("doc_id").length.sum() == want).all()
    for _, b in out.sort_values(["bin", "offset"]).groupby("bin"):
        assert b.offset.tolist() == (b.length.cumsum() - b.length).tolist()
        assert (b.used == b.length.sum()).all() and (b.used <= b["size"]).all()
    per_bin = out.drop_duplicates("bin")
    assert per_bin.used.sum() / per_bin["size"].sum() > 0.9
    assert sorted(per_bin.bin) == list(range(len(per_bin)))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, 5, 1), (1, 5, 1), (None, 5, 2), (2, None, 3), (3, 0, 4), (4, 25, 5)],
                                 "doc_id long, n int, bin int")
    out = packing.pack(docs, F.col("n"), sizes=(4, 10)).collect()
    assert sorted((r.doc_id or 9, r.start, r.length) for r in out) == [
        (1, 0, 5), (1, 0, 5), (4, 0, 10), (4, 10, 10), (4, 20, 5), (9, 0, 5)]
    assert len({(r.bin, r.offset) for r in out}) == 6
    assert packing.pack(docs.limit(0), F.col("n")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, F.col("n"), sizes=(0, 4))


def test_running_sums_of_a_hot_group(spark):
    rows = [(None if i % 5 == 0 else 1, i % 7, i, i % 3) for i in range(2_000)]
    df = spark.createDataFrame(rows, "g int, o int, i int, x int").repartition(5)
    got = running_sums(df, ["g"], ["o", "i"], {"x": "s"}).collect()
    total = {}
    for g, o, i, x in sorted(rows, key=lambda r: (r[0] or 0, r[1], r[2])):
        total[i] = total.get(("t", g), 0)
        total["t", g] = total.get(("t", g), 0) + x
    assert len(got) == 2_000 and all(total[r.i] == r.s for r in got)

"""SimHash groups against all pairs of fingerprints."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from motley.llm import simhash
from motley.llm.common import table
from motley.operators.components import components


def plain_print(text, size):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints):
    """Index of the first member of each one's group, by comparing all pairs."""
    values, label = np.array(prints, dtype=np.uint64), np.arange(len(prints))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            if label[j] != label[i]:
                a, b = sorted((label[i], label[j]))
                label[label == b] = a
    return label


def brute_groups(rows, size=3):
    rows = sorted(rows)
    label = components_of([plain_print(t, size) for _, t in rows])
    return {rows[i][0]: rows[int(x)][0] for i, x in enumerate(label)}


def families(n, seed):
    """Random fingerprints and chains of neighbours around some of them."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        value = int(rng.integers(0, 2 ** 64, dtype=np.uint64))
        for _ in range(rng.integers(1, 12)):
            out.append(value)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                value ^= 1 << int(bit)
    return sorted(set(out))


@settings(max_examples=30)
@given(st.text(alphabet=" \tabAB\x1cé\n", max_size=60), st.integers(1, 5))
def test_fingerprint(text, size):
    assert simhash.fingerprint(text, size) == plain_print(text, size)


@pytest.mark.parametrize("bucket", [4_096, 2])
def test_links_lose_no_pair(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    values = families(150, 5)
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    prints = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(prints), "a", "b").collect()}
    label = components_of(values)
    got = [roots.get(x, x) for x in signed]
    assert len(set(zip(got, label.tolist()))) == len(set(got)) == len(set(label.tolist())) < len(values)


def test_every_close_pair_shares_a_key_and_its_chain():
    rng = np.random.default_rng(2)
    for _ in range(3_000):
        bits = rng.choice(64, 3, replace=False)
        segments = np.bincount(bits // 8, minlength=8)
        assert any(all(segments[[(s + i) % 8 for i in range(n + 1)]].sum() <= simhash.BUDGETS[n] for n in range(8))
                   for s in range(8))


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    want = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    out = simhash.groups(docs).collect()
    assert {r.doc_id: r.component_id for r in out} == want
    assert all(int(r.fingerprint, 16) == simhash.fingerprint(t.text) for r, t in
               zip(sorted(out), docs.orderBy("doc_id").collect()))


def test_odd_rows(spark):
    long = " ".join(f"w{i * i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (None, "one"), (None, "alone here"), (5, long),
            (6, long + " end"), (None, "alone here")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, th int, fp string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.groups(docs).collect())
    assert got == [(0, 0), (0, 0), (0, 4), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5), (6, 5)]
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == [(0, "alone"), (1, ""), (4, "one"), (5, "w0 w1")]
    assert simhash.groups(docs.limit(0)).count() == simhash.keep_first(docs.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(i, i + 1) for i in range(1_000, 1_060)]
    pairs += [(2_000, i) for i in range(2_001, 2_200)] + [(5, None), (9_000, 9_000)]
    label = {x: x for p in pairs if None not in p for x in p}
    for _ in range(100):
        for a, b in (p for p in pairs if None not in p):
            label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    assert {r.node: r.root for r in got} == label and len(got) == len(label)

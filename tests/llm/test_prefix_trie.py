"""Prefix trie against a plain tree of tuples, with small shards and queues."""

import hashlib
import random
import zlib

import pytest

from motley.llm import prefix_trie as pt


def brute(rows):
    """Node rows by (conv_id, depth) from whole sequences."""
    said = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(v)] for c, v in said.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(said.get(c - abs(c) % 5 * (1 if c > 0 else -1), [])[:h] + own[h:])  # as SQL divides
    members = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members.setdefault(built[c][:d], []).append(c)
    out, leaves, saved, children = {}, {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + own
        if p:
            for x, more in ((leaves, leaves[p]), (saved, saved[p]), (children, 1)):
                x[p[:-1]] = x.get(p[:-1], 0) + more
        ends = ",".join(str(c) for c in members[p] if built[c] == p)
        up = members[p[:-1]][0] if p else None
        out[members[p][0], len(p)] = (up, len(members[p]), children.get(p, 0), leaves[p], saved[p],
                                      hashlib.sha256(ends.encode()).hexdigest())
    return out


def talk(n, seed):
    """Dialogues that share beginnings, some of many turns, one opening and one dialogue that are common."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        first = "hello" if rng.random() < 0.5 else f"q{rng.randrange(4)}"
        turns = ["hello", "yes", "no", "done"] if rng.random() < 0.3 else [first] + [
            rng.choice(["yes", "no", "é日", ""]) for _ in range(rng.randrange(0, 40 if c % 11 == 0 else 14))]
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", x) for t, x in enumerate(turns)]
    rng.shuffle(rows)
    return rows


def check(spark, rows, **settings):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "conv_id long, turn long, role string, text string, depth int, a string")
    found = pt.trie(df, **settings).collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
           for r in found}
    assert len(got) == len(found) and got == brute(rows)
    return got


@pytest.mark.parametrize("unit, queue", [(3, 2), (40, 5), (4_096, 1 << 17)])
def test_random(spark, unit, queue, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 3)
    check(spark, talk(120, unit), unit=unit, queue=queue)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, 7, "b", "y" * 200_000),
            (2, 1, "b", "tie"), (2, 1, "a", "tie"), (-3, 0, "user", "below"), (-5, 0, "user", "base"), (-5, 1, "u", "é" * 9),
            (104, 3, "user", "alone"), (2 ** 62, 0, "user", "")]
    check(spark, rows, unit=3, queue=1)


def test_long_and_wide(spark):
    """One dialogue of many turns and very many of a single turn."""
    rows = [(0, t, "u", str(t % 3)) for t in range(3_000)] + [(c, 0, "u", str(c % 90)) for c in range(1, 2_500)]
    check(spark, rows, unit=64, queue=16)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert pt.trie(df).count() == 0
    only = spark.createDataFrame([(None, 1, "a", "b")], df.schema)
    assert pt.trie(only).count() == 0


def test_queue_spills():
    queue, want, rng = pt.Messages(3), {}, random.Random(1)
    for i in range(500):
        to = (-rng.randrange(6), rng.randrange(5), 0)
        queue.send(to, (1, i))
        want[to] = tuple(x + y for x, y in zip(want.get(to, (0, 0)), (1, i)))
    assert {to: queue.take(to) for to in sorted(want)} == want and not queue and queue.take((9, 9, 9)) is None

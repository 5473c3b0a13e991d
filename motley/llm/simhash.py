"""SimHash near-duplicates: pigeonring keys, a full Hamming check, connected groups.

A fingerprint of 64 bits is a ring of eight segments of eight bits. If two fingerprints
differ in at most three bits, then some segment starts a chain in which every prefix of l
segments differs in at most 3 * l / 8 bits, rounded down:

    segments   1  2  3  4  5  6  7  8
    bits       0  0  1  1  1  2  2  3

So the first two segments are equal, and at most one of the next three differs. A key is the
start, these two segments and two of the next three: 8 * 3 keys of 32 bits per fingerprint,
and every pair within three bits shares one of them. Pairs under a key must pass the chain
of that start before their full distance is counted.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motley.llm.common import temporary
from motley.operators.components import components
from motley.workdir import materialize

DISTANCE = 3
SEGMENTS, WIDTH = 8, 8
BUDGETS = [DISTANCE * length // SEGMENTS for length in range(1, SEGMENTS + 1)]
BUCKET = 4096
_PAIRS = ((2, 3), (2, 4), (3, 4))
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """64 bits, each the majority of that bit over the XXH64 of the word shingles.

    Shingles count as often as they stand there. Fewer than ``size`` words make one shingle;
    a null text or one without a word has fingerprint 0. Hashes are summed in slices, so that
    the memory does not grow with 64 bytes per word.
    """
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        shingles = [" ".join(words)]
    else:
        shingles = map(" ".join, zip(*(words[i:] for i in range(size))))
    hashes = np.fromiter((digest(s, seed) for s in shingles), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at:at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.where(ones * 2 > n, np.uint64(1), np.uint64(0)) << _SHIFTS).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int, seed: int = 42) -> DataFrame:
    """(id, th, fp): one row per input row; th is a hash of the text, fp the signed fingerprint."""
    def run(batches):
        for batch in batches:
            values = [fingerprint(t.as_py(), size, seed) for t in batch.column(2)]
            signed = np.array(values, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signed, pa.int64())],
                                             names=["id", "th", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = docs[text_col].cast("string")
    picked = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return picked.mapInArrow(run, f"id {kind}, th bigint, fp bigint")


def _segment(fp, at: int):
    return F.shiftrightunsigned(fp, (at % SEGMENTS) * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _keyed(prints: DataFrame) -> DataFrame:
    """(k, fp) for every start and choice of segments; k holds start, choice and 32 bits."""
    fp, keys = F.col("fp"), []
    for start in range(SEGMENTS):
        for choice, (c, d) in enumerate(_PAIRS):
            value = F.lit(start * len(_PAIRS) + choice).cast("long")
            for offset in (0, 1, c, d):
                value = F.shiftleft(value, WIDTH).bitwiseOR(_segment(fp, start + offset))
            keys.append(value)
    return prints.select(F.explode(F.array(*keys)).alias("k"), "fp")


def _finer(deferred: DataFrame) -> DataFrame:
    """Keys for members of a large bucket: three of six blocks of the 32 bits the key leaves open.

    At most three open bits differ, so three blocks are equal. Such a bucket fixes 47 bits or
    more of 64: it cannot hold more than 2**17 fingerprints, however many there are in all.
    """
    edges, keys = [0, 5, 10, 15, 20, 26, 32], []
    left = F.lit(0).cast("long")
    pair, start = F.pmod(F.shiftrightunsigned("k", 32), F.lit(3)), F.floor(F.shiftrightunsigned("k", 32) / 3)
    open_one = F.when(pair == 0, 4).when(pair == 1, 3).otherwise(2)
    for i, offset in enumerate((open_one, F.lit(5), F.lit(6), F.lit(7))):
        shift = F.pmod(start + offset, F.lit(SEGMENTS)) * WIDTH
        part = F.call_function("shiftrightunsigned", F.col("fp"), shift.cast("int")).bitwiseAND(F.lit(255))
        left = left.bitwiseOR(F.shiftleft(part, WIDTH * i))
    rows = deferred.withColumn("left", left)
    blocks = [F.shiftrightunsigned("left", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    for a in range(6):
        for b in range(a + 1, 6):
            for c in range(b + 1, 6):
                value = F.lit(a * 36 + b * 6 + c).cast("long")
                for x in (a, b, c):
                    value = F.shiftleft(value, 6).bitwiseOR(blocks[x])
                keys.append(value)
    return rows.select("k", F.explode(F.array(*keys)).alias("k2"), "fp")


def _chains(start: int) -> list[np.uint64]:
    """Masks of the growing chains that begin at a segment."""
    masks, mask = [], 0
    for length in range(SEGMENTS):
        mask |= ((1 << WIDTH) - 1) << (((start + length) % SEGMENTS) * WIDTH)
        masks.append(np.uint64(mask))
    return masks


def _linked(values: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that join the values of one bucket as all pairs within the distance would.

    Each value is compared with all later ones at once; of these only ones not yet joined
    with it count, so fewer links than values come out.
    """
    masks, out = _chains(start), []
    group = np.arange(len(values))
    for i in range(len(values) - 1):
        rest = np.flatnonzero(group[i + 1:] != group[i]) + i + 1
        if not len(rest):
            continue
        diff = values[rest] ^ values[i]
        for mask, budget in zip(masks[2:], BUDGETS[2:]):
            viable = np.bitwise_count(diff & mask) <= budget
            rest, diff = rest[viable], diff[viable]
            if not len(rest):
                break
        for j in rest:
            if group[j] != group[i]:
                out.append((int(values[i].view(np.int64)), int(values[j].view(np.int64))))
                group[group == group[j]] = group[i]
    return out


def _link_buckets(batches, limit: int | None):
    """Links within runs of equal keys; runs beyond ``limit`` come back whole with their key."""
    links, later = [], []

    def close(key, run, over):
        if over:
            later.extend((key[0], v) for v in run)
        elif len(run) > 1:
            links.extend(_linked(np.array(run, dtype=np.int64).view(np.uint64), (key[0] >> 32) // len(_PAIRS)))

    def flush():
        rows = [(a, b, None) for a, b in links] + [(v, None, k) for k, v in later]
        links.clear()
        later.clear()
        cols = list(zip(*rows)) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "k"])

    key, run, over = None, [], False
    for batch in batches:
        names = batch.schema.names
        keys = list(zip(*(batch.column(i).to_pylist() for i, n in enumerate(names) if n != "fp")))
        for now, fp in zip(keys, batch.column(names.index("fp")).to_pylist()):
            if now != key:
                close(key, run, over)
                key, run, over = now, [], False
            if run and run[-1] == fp:
                continue
            run.append(fp)
            if limit is not None and len(run) > limit:
                over = True
                later.extend((key[0], v) for v in run[:-1])
                del run[:-1]
        yield flush()
    close(key, run, over)
    yield flush()


_LINKS = "a bigint, b bigint, k bigint"


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints whose groups are those of all pairs within three bits.

    Buckets are read as sorted streams. One with more than ``BUCKET`` fingerprints is not
    compared but passed on and split by further keys, so no task ever holds or compares an
    unbounded bucket.
    """
    rows = _keyed(prints).repartition("k").sortWithinPartitions("k", "fp")
    found = materialize(rows.mapInArrow(lambda b: _link_buckets(b, BUCKET), _LINKS), "simhash-links")
    near, large = found.where("k IS NULL").select("a", "b"), found.where("k IS NOT NULL").select("k", F.col("a").alias("fp"))
    if large.isEmpty():
        return near
    finer = _finer(large).repartition("k", "k2").sortWithinPartitions("k", "k2", "fp")
    return near.unionByName(finer.mapInArrow(lambda b: _link_buckets(b, None), _LINKS).select("a", "b"))


def _labelled(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, th, fp, component, first): each row, its group's smallest id and its first member."""
    prints = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
    member = F.struct(F.isnull("id").alias("no_id"), "id", "th")
    each = materialize(prints.groupBy("fp").agg(F.min("id").alias("least"), F.min(member).alias("first")), "by-print")
    roots = components(links(each.select("fp")), "a", "b").select(F.col("node").alias("fp"), "root")
    linked = each.join(roots, "fp")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component"), F.min("first").alias("first"))
    linked = linked.select("fp", "root").join(of_root, "root").select("fp", "component", "first")
    alone = each.join(roots, "fp", "left_anti").select("fp", F.col("least").alias("component"), "first")
    return prints.join(linked.unionByName(alone), "fp")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fingerprint, component_id): one row per input row.

    Fingerprints within three bits are linked; ``component_id`` is the smallest id that can be
    reached over links, the row's own included. Copies share a fingerprint and are reduced to
    one value before anything is compared. Null and empty texts have fingerprint 0 and are
    linked like any other; repeated rows come out as often as they went in; a null id is
    never the smallest unless its group has no other; an empty table gives no rows; other
    columns, whatever their names, are not read.
    """
    return _labelled(docs, id_col, text_col, size).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id, with all its columns.

    Of rows that repeat the id and text of the first one only one stays; a row with a null id
    stays where its group has no other id.
    """
    first = _labelled(docs, id_col, text_col, size).select("first.id", "first.th").distinct()
    mark = temporary([*docs.columns, "id", "th"], "_th")
    marked = docs.withColumn(mark, F.xxhash64(docs[text_col].cast("string")))
    same = F.col(id_col).eqNullSafe(first["id"]) & (F.col(mark) == first["th"])
    return marked.join(first, same, "left_semi").dropDuplicates([id_col, mark]).drop(mark)

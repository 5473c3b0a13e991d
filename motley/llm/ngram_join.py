"""N-gram Jaccard join by adaptive multi-match prefixes.

A document is the set of its shingles. Two sets of Jaccard similarity 9/10 or more share at
least t = ceil(9 n / 10) of each one's n shingles. With all shingles in one fixed order they
therefore share l among the first n - t + l of each, for every l up to t. A set first enters
the index with the prefix of the largest l that its size allows; one that shares too few
shingles there, for any l, has no partner. For the others the rows and candidates that each
l would cost are estimated from the lengths of their lists, and each set takes the l that
costs least: crowded lists lengthen the prefix and ask for more shared shingles. Pairs come
from the lists of all but the l - 1 most crowded shingles of a prefix, must share the smaller
of their two l among the whole prefixes, and are decided by their exact similarity.

Crowded lists that are left are mostly groups of near copies. Their members are compared with
the most central of them, and are from then on known by what they have more or less than it:
two of them are alike if these differences are small or have most in common, which a prefix
join of the differences finds. So a large group makes few pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motley.llm.common import Tables
from motley.llm.fuzzy_lines import _IN_WORD, _mixed, _polynomial, _powers
from motley.operators.components import components

SIZE = 3
ALIKE, OF = 9, 10  # the similarity as a fraction, so that no rounding moves the bound
MATCHES, LONGER = (1, 2, 3, 4, 8, 16, 32, 64, 128, 256), 40
FEW, NEAR = 16, 4  # sets nearer than a NEARth of both sizes are described by what differs
SLOTS = 22
COMMON, OVER = 32, 4
FILTER_BITS = 24
SLICE = 1 << 19  # characters looked at together; a longer text is looked at alone
_PLACES = _powers(0x9FB21C651E98DF25, 1 << 12)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def shingle_table(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of the distinct shingles of each text, ascending.

    Words are runs without blanks, in lower ASCII case. Fewer than ``size`` words make one
    shingle; a text without a word has none.
    """
    parts = [t.encode("utf-8", "replace").translate(_LOWER) for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    buffer = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    blank = _BLANK[buffer]
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    text = np.searchsorted(np.cumsum(sizes), starts, side="right")
    count = np.bincount(text, minlength=len(texts))
    owners, shingles = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    if len(starts):
        letters = np.where(blank, 0, buffer.astype(np.uint64) + 1)[starts[0]:]
        words = _polynomial(letters, starts - starts[0], np.diff(np.r_[starts, len(buffer)]), _IN_WORD)
        at = np.flatnonzero(text[:len(text) - size + 1] == text[size - 1:]) if len(text) >= size else np.zeros(0, np.int64)
        sums = np.zeros(len(at), dtype=np.uint64)
        for i in range(size):
            sums += words[at + i] * _PLACES[i]
        owners.append(text[at])
        shingles.append(_mixed(sums))
        short = (count > 0) & (count < size)
        if short.any():
            few = words[np.repeat(short, count)]
            n = count[short]
            owners.append(np.flatnonzero(short))
            shingles.append(_polynomial(few, np.cumsum(n) - n, n, _PLACES))
    owner, shingle = np.concatenate(owners), np.concatenate(shingles)
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])][:len(owner)]
    return owner[new], shingle[new]


def _sliced(texts: list, size: int):
    """(first text, number of texts, shingle table) over slices of bounded length."""
    texts, lo = [t or "" for t in texts], 0
    while lo < len(texts):
        hi, length = lo + 1, len(texts[lo])
        while hi < len(texts) and length + len(texts[hi]) <= SLICE:
            length += len(texts[hi])
            hi += 1
        yield lo, hi - lo, *shingle_table(texts[lo:hi], size)
        lo = hi


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOTS)).astype(np.int64)


def _common(texts: DataFrame, size: int) -> np.ndarray:
    """Bits of the slots that many texts fall in, at most ``2 ** SLOTS`` of them.

    They only decide the order, so estimates do. A slot is common if it holds clearly more
    than the mean, which grows with the table.
    """
    def run(batches):
        seen, n = np.zeros(1 << SLOTS, dtype=np.int32), 0
        for batch in batches:
            for _, _, _, shingles in _sliced(batch.column("text").to_pylist(), size):
                seen += np.bincount(_slot(shingles), minlength=1 << SLOTS).astype(np.int32)
                n += len(shingles)
        some = np.r_[np.flatnonzero(seen >= 2 + int(6 * n / (1 << SLOTS))), -1]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.r_[seen[some[:-1]], n].astype(np.int64))], names=["slot", "n"])

    counts = texts.select("text").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= COMMON).toPandas()  # one row per slot
    total = int(found.loc[found.slot < 0, "n"].sum())
    bits = np.zeros(1 << SLOTS, dtype=bool)
    bits[found.slot[(found.slot >= 0) & (found.n >= OVER * total / (1 << SLOTS))].to_numpy(dtype=np.int64)] = True
    return np.packbits(bits)


def _set_keys(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    return _mixed(np.add.reduceat(_mixed(shingles + np.uint64(0x9E3779B97F4A7C15)), starts))


def _needed(n):
    """Shingles that a set of n must share with one alike enough."""
    return -(-n * ALIKE // OF)


def _prefixes(texts: DataFrame, size: int, common: np.ndarray) -> DataFrame:
    """(id, th, s, n, prefix): every row with the hash of its set, the set's size and its first shingles.

    A row without a shingle has a null s and n = 0.
    """
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        late = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            for lo, rows, owner, shingles in _sliced(batch.column("text").to_pylist(), size):
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][:len(owner)])
                count = np.bincount(owner, minlength=rows)
                n = count[count > 0]
                order = np.lexsort((shingles, late[_slot(shingles)], owner))
                first = np.minimum(n, n - _needed(n) + np.clip(n // LONGER, 4, MATCHES[-1]))
                kept = np.arange(len(owner)) - np.repeat(starts, n) < np.repeat(first, n)
                ends = np.zeros(rows, dtype=np.int64)
                ends[count > 0] = first
                keys = np.zeros(rows, dtype=np.uint64)
                keys[count > 0] = _set_keys(shingles, starts)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(ends)].astype(np.int32)),
                                                 pa.array(shingles[order][kept].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, rows), batch.column("th").slice(lo, rows),
                     pa.array(keys.view(np.int64), mask=count == 0), pa.array(count.astype(np.int64)), lists],
                    names=["id", "th", "s", "n", "prefix"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, th bigint, s bigint, n bigint, prefix array<bigint>")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(s, shingles): the whole set of every text that has one."""
    def run(batches):
        for batch in batches:
            for _, _, owner, shingles in _sliced(batch.column("text").to_pylist(), size):
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][:len(owner)])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(owner)].astype(np.int32)),
                                                 pa.array(shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_set_keys(shingles, starts).view(np.int64)), lists],
                                                 names=["s", "shingles"])

    return texts.mapInArrow(run, "s bigint, shingles array<bigint>")


def _slot_of(key: Column) -> tuple[Column, Column]:
    slot = F.pmod(key, F.lit(1 << FILTER_BITS))
    return F.shiftright(slot, 6), slot.bitwiseAND(F.lit(63)).cast("int")


def _only(texts: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``texts`` that are (id, th) members, and a few others, without a shuffle of texts.

    A filter of ``2 ** FILTER_BITS`` bits is made of the members and broadcast.
    """
    word, bit = _slot_of(F.xxhash64("id", "th"))
    bits = members.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))
    held = F.call_function("shiftright", F.col("bits"), bit).bitwiseAND(F.lit(1)) == 1
    return texts.withColumn("word", word).join(F.broadcast(bits), "word").where(held).select("text")


def _fits(n, other) -> Column:
    """Whether sets of these sizes can be alike."""
    return F.least(n, other) * OF >= F.greatest(n, other) * ALIKE


def _both(pairs: DataFrame, texts: DataFrame, each: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) with their sets x and y, which are read from the texts again."""
    def sets(side):
        wanted = pairs.select(F.col(side).alias("s")).distinct()
        some = _only(texts, each.join(wanted, "s").select("first.id", "first.th"))
        return _sets(some, size).join(wanted, "s", "left_semi").withColumnRenamed("s", side)

    return pairs.join(sets("b").withColumnRenamed("shingles", "y"), "b").join(sets("a").withColumnRenamed("shingles", "x"), "a")


def _needed_column() -> Column:
    return F.floor((F.col("n") * ALIKE + OF - 1) / OF)


def _alike(difference, sizes) -> Column:
    """Whether sets that differ in so many shingles, of so many together, reach the similarity."""
    return difference * (ALIKE + OF) <= sizes * (OF - ALIKE)


def _chosen(shared: DataFrame) -> DataFrame:
    """(s, l): sets that may have a partner, with the number of shared shingles that costs least.

    ``df`` is the length of a shingle's list. A prefix costs its rows in the index and, for at
    most rows / l candidates, a comparison in proportion to the set.
    """
    needed = _needed_column()
    reach = lambda l: F.col("pos") < F.col("n") - needed + l
    sums = []
    for l in MATCHES:  # noqa: E741
        sums += [F.count_if(reach(l)).alias(f"m{l}"), F.sum(F.when(reach(l), F.col("df") - 1).otherwise(0)).alias(f"c{l}")]
    per = shared.groupBy("s", "n").agg(*sums)
    alive, costs = F.lit(True), []
    for l in MATCHES:  # noqa: E741
        possible = (F.lit(l) <= needed) & (F.lit(l) <= F.greatest(F.lit(4), F.floor(F.col("n") / LONGER)))
        alive = alive & (~possible | (F.col(f"m{l}") >= l))
        cost = F.col(f"c{l}") * (1 + F.col("n") / (8.0 * l))
        costs.append(F.when(possible, F.struct(cost.alias("cost"), F.lit(l).alias("l"))))
    return per.where(alive).select("s", F.array_min(F.filter(F.array(*costs), lambda c: c.isNotNull()))["l"].alias("l"))


def _keys(shared: DataFrame) -> DataFrame:
    """(k, s, n, l, df, early): the adapted prefixes, without the shingles that no other set has.

    Among l shared shingles the rarest has l - 1 others behind it, so the last l - 1 need not
    bring pairs about: they are not ``early``.
    """
    own = Window.partitionBy("s")
    shared = shared.repartition("s")  # the rows move once, not the many sums of each
    reached = F.col("pos") < F.col("n") - _needed_column() + F.col("l")
    ranked = shared.join(_chosen(shared), "s").where(reached).withColumn("r", F.row_number().over(own.orderBy("df", "k")))
    return ranked.select("k", "s", "n", "l", "df", (F.col("r") <= F.count("*").over(own) - F.col("l") + 1).alias("early"))


def _enough(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) that share as many shingles of their prefixes as the smaller l of the two."""
    side = lambda c, l, ks: known.select(F.col("s").alias(c), F.col("l").alias(l), F.col("ks").alias(ks))
    met = pairs.join(side("a", "_la", "_x"), "a").join(side("b", "_lb", "_y"), "b")
    return met.where(F.size(F.array_intersect("_x", "_y")) >= F.least("_la", "_lb")).select("a", "b")


def _close(deltas: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): pairs within a cluster, not yet in one group, whose differences from its lead make them alike.

    Two sets at d and e from the lead differ in d + e less twice what the differences have in
    common. Where that must be something, they meet by a prefix join of the differences, rarest
    first: with at most ``most`` left between them, the first most / 2 + 1 of the smaller
    difference and the first most + 1 of the larger have one in common.
    """
    here = deltas.select("a", F.col("b").alias("s"), "n", "d", F.floor(F.col("n") * (OF - ALIKE) / ALIKE).alias("most"))
    rooted = deltas.withColumnRenamed("b", "s").join(roots, "s", "left").withColumn("root", F.coalesce("root", "s"))
    mixed = rooted.groupBy("a").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("a")
    each = rooted.join(mixed, "a").select("a", "s", "root", F.explode("delta").alias("x"))
    # a difference that only one group has brings no pair about; it counts among the rarest
    often = (each.groupBy("a", "x").agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high"))
             .where("low <> high").select("a", "x", "df"))
    own = Window.partitionBy("a", "s")
    ranked = (each.join(often, ["a", "x"]).withColumn("r", F.row_number().over(own.orderBy("df", "x")))
              .withColumn("c", F.count("*").over(own)).join(here, ["a", "s"]).withColumn("pos", F.col("d") - F.col("c") + F.col("r") - 1)
              .where(F.col("pos") <= F.col("most")))
    one = ranked.where(F.col("pos") * 2 <= F.col("most")).select("a", "x", *(F.col(c).alias(f"one_{c}") for c in ("s", "n", "d", "root")))
    two = ranked.select("a", "x", *(F.col(c).alias(f"two_{c}") for c in ("s", "n", "d", "root")))
    met = one.join(two, ["a", "x"]).where(
        (F.struct("one_d", "one_s") < F.struct("two_d", "two_s")) & (F.col("one_root") != F.col("two_root"))
        & _fits(F.col("one_n"), F.col("two_n")) & _alike(F.col("two_d") - F.col("one_d"), F.col("one_n") + F.col("two_n")))
    pairs = met.groupBy("one_s", "two_s").agg(F.min("a").alias("a"))
    side = lambda c: deltas.select("a", *(F.col(x).alias(f"{c}_{y}") for x, y in (("b", "s"), ("n", "n"), ("d", "d"), ("delta", "delta"))))
    both = pairs.join(side("one"), ["a", "one_s"]).join(side("two"), ["a", "two_s"])
    differ = F.col("one_d") + F.col("two_d") - 2 * F.size(F.array_intersect("one_delta", "two_delta"))
    return both.where(_alike(differ, F.col("one_n") + F.col("two_n"))).select(F.col("one_s").alias("a"), F.col("two_s").alias("b"))


def _surely(deltas: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): links of the sets whose differences from a lead are so small that they are alike whatever they hold.

    All such pairs are joined by links with the set of the smallest difference for its size.
    """
    lead = deltas.select("a").distinct().join(known.select(F.col("s").alias("a"), "n"), "a").select("a", F.col("a").alias("s"), "n", F.lit(0).alias("d"))
    members = deltas.select("a", F.col("b").alias("s"), "n", "d").unionByName(lead).withColumn(
        "over", F.col("d") * (ALIKE + OF) - F.col("n") * (OF - ALIKE))
    least = members.groupBy("a").agg(F.min(F.struct("over", "s")).alias("least"))
    near = members.join(least, "a").where((F.col("over") + F.col("least.over") <= 0) & (F.col("s") != F.col("least.s")))
    return near.select(F.col("least.s").alias("a"), F.col("s").alias("b"))


def _links(rows: DataFrame, texts: DataFrame, each: DataFrame, size: int, few: int, tables: Tables) -> DataFrame:
    """(a, b): links that join what all pairs of sets alike enough join."""
    spread = (tables.write(rows.where("n > 0").select("s", F.col("n").cast("int").alias("n"), "prefix").dropDuplicates(["s"]), "sets")
              .select("s", "n", F.posexplode("prefix").alias("pos", "k")).select("k", "s", "n", "pos"))
    lists = spread.groupBy("k").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    shared = tables.write(spread.join(lists, "k"), "shared")
    tables.drop("sets")
    keys = tables.write(_keys(shared), "keys")
    tables.drop("shared")
    known = tables.write(keys.groupBy("s").agg(F.max("n").alias("n"), F.max("l").alias("l"), F.collect_list("k").alias("ks"),
                                               F.sum("df").alias("score")), "prefixes")
    early = keys.where("early").select("k", "s", "n")
    lists = early.groupBy("k").agg(F.count("*").alias("df")).where("df > 1")

    crowded = tables.write(early.join(lists.where(F.col("df") > few), "k").join(known.select("s", "score"), "s").select("k", "s", "n", "score"), "crowded")
    leads = crowded.groupBy("k").agg(F.max(F.struct("score", "s"))["s"].alias("lead"))
    led = crowded.join(leads, "k").where(F.col("s") != F.col("lead")).select("k", F.col("lead").alias("a"), F.col("s").alias("b"))
    around = tables.write(_enough(led.select("a", "b").distinct(), known), "around")
    added, missing = F.array_except("y", "x"), F.array_except("x", "y")
    delta = F.concat(added, F.transform(missing, lambda t: F.bitwise_not(t)))
    sizes = F.size("x") + F.size("y")
    met = _both(around, texts, each, size).withColumn("d", sizes - 2 * F.size(F.array_intersect("x", "y")))
    deltas = tables.write(met.where(F.col("d") * NEAR <= sizes).select(
        "a", "b", F.size("y").alias("n"), "d", delta.alias("delta"), _alike(F.col("d"), sizes).alias("linked")), "deltas")
    first = tables.write(deltas.where("linked").select("a", "b").unionByName(_surely(deltas, known)), "first-links")
    roots = tables.write(components(first, "a", "b").withColumnRenamed("node", "s"), "groups")
    close = tables.write(_close(deltas, roots), "close-links")
    # Members that are too far from their lead are not described by it, and meet all others of the list.
    apart = led.join(deltas.select("a", "b"), ["a", "b"], "left_anti").select("k", "b")
    others = apart.join(crowded.select("k", F.col("s").alias("a"), F.col("n").alias("_n")), "k").join(
        known.select(F.col("s").alias("b"), "n"), "b").where(F.col("a") != F.col("b"))
    some = early.join(lists.where(F.col("df") <= few).select("k"), "k")
    pairs = some.join(some.select("k", F.col("s").alias("a"), F.col("n").alias("_n")), "k").where("a < s").withColumnRenamed("s", "b")
    pairs = pairs.select("a", "b", "n", "_n").unionByName(others.select("a", "b", "n", "_n")).where(_fits(F.col("n"), F.col("_n")))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("s").alias(c), F.col("root").alias(f"_{c}")), c, "left")
    apart = F.coalesce("_a", "a") != F.coalesce("_b", "b")
    pairs = tables.write(_enough(pairs.where(apart).select("a", "b"), known), "pairs")
    tables.drop("crowded", "keys", "around", "deltas", "groups", "prefixes")
    common = F.size(F.array_intersect("x", "y"))
    sizes = F.size("x") + F.size("y")
    found = tables.write(_both(pairs, texts, each, size).where(_alike(sizes - 2 * common, sizes)).select("a", "b"), "links")
    return first.unionByName(close).unionByName(found)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, few: int = FEW) -> DataFrame:
    """(id, n_shingles, component_id): one row per input row.

    Rows are linked if the sets of their word shingles have a Jaccard similarity of 9/10 or more;
    ``component_id`` is the smallest id that can be reached over links, the row's own included.
    Equal sets are compared once. Lists of more than ``few`` sets are taken apart around a
    central one; that does not change the result. Words are runs without blanks, A-Z in lower case; a text of
    fewer than ``size`` words is one shingle. A null text, or one without a word, has none and
    is linked with nothing. Shingles and sets are known by 64-bit hashes. Repeated rows come
    out as often as they went in; a null id is the smallest only where there is no other. An
    empty table gives no rows; other columns are not read.
    """
    tables = Tables(docs.sparkSession, "jaccard")
    text = docs[text_col].cast("string")
    texts = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    rows = tables.write(_prefixes(texts, size, _common(texts, size)), "rows")
    member = F.struct(F.isnull("id").alias("no_id"), "id", "th")
    each = tables.write(rows.where("n > 0").groupBy("s").agg(F.min(member).alias("first")), "distinct")
    links = _links(rows, texts, each, size, few, tables)
    roots = components(links, "a", "b").select(F.col("node").alias("s"), "root")
    linked = tables.write(each.join(roots, "s"), "linked")
    of_root = linked.groupBy("root").agg(F.min("first").alias("least"))
    least = (linked.join(of_root, "root").select("s", F.col("least.id").alias("component"))
             .unionByName(each.join(linked, "s", "left_anti").select("s", F.col("first.id").alias("component"))))
    return rows.join(least, "s", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id"))


def oracle() -> str:
    """The same rows in DuckDB SQL over the table ``documents``."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - {SIZE - 1}, 1) + 1),
    lambda i: array_to_string(w[i:i + {SIZE - 1}], ' '))) END AS s FROM w),
sets AS (SELECT min(doc_id) AS doc_id, s FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.k = b.k AND a.doc_id < b.doc_id AND {OF} * a.n >= {ALIKE} * b.n AND {OF} * b.n >= {ALIKE} * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {OF} * count(*) >= {ALIKE} * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id, doc_id AS r FROM sets UNION SELECT e.b, r.r FROM reach r JOIN edges e ON e.a = r.doc_id),
roots AS (SELECT doc_id, min(r) AS root FROM reach GROUP BY doc_id),
named AS (SELECT s.s, root FROM sets s JOIN roots USING (doc_id))
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(named.root, s.doc_id) AS component_id
FROM s LEFT JOIN named ON named.s = list_sort(s.s)"""

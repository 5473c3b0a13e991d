"""Prefix trie of rebuilt conversations, its subtree totals by time-forward processing.

A node is a distinct sequence of first turns, named by sums of hashes of (place, role, text),
so that the names of all prefixes of a conversation are running sums and no task holds a
conversation. A node weighs as much as rows lie in and below it. Nodes of up to ``UNIT`` rows
form shards, the largest subtrees of that weight; above them nodes of up to ``UNIT`` squared
rows form shards in the same way, and so on up to the root. Within a shard nodes are read in
reverse level order from Spark's external sort: a node takes the totals sent to it from a
priority queue that spills, and sends its own to its parent. The totals of shard roots are
added up per parent by Spark and wait for the shards above, whose number falls by ``UNIT``
each time, so a trie of any width is done in a few passes without a wide task.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motley.llm.common import Tables
from motley.llm.running import running_sums

UNIT = 4_096
FAMILY, SLOTS = 5, 9  # conversations that share a base, and the modulus of the turns taken from it
QUEUE = 1 << 17
PIECE = 4_096
_LOW = (1 << 32) - 1


class Messages:
    """Sums on their way to nodes in reverse level order; the queue goes to disk in sorted runs."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self._heap, self._runs = limit, [], []

    def send(self, to: tuple, sums: tuple) -> None:
        """``to`` must not lie before a node that has already been served."""
        heapq.heappush(self._heap, (to, sums))
        if len(self._heap) > self.limit:
            self._spill()

    def take(self, to: tuple) -> tuple[int, ...] | None:
        """The sums of all that was sent to a node, or None."""
        total = None
        while (head := self._head()) is not None and head[0] == to:
            total = head[1] if total is None else tuple(x + y for x, y in zip(total, head[1]))
            self._drop()
        return total

    def __bool__(self) -> bool:
        return bool(self._heap or self._runs)

    def _head(self):
        heads = [x[0] for x in (self._heap[:1], self._runs[0][:1] if self._runs else []) if x]
        return min(heads, default=None)

    def _drop(self) -> None:
        if self._heap and (not self._runs or self._heap[0] <= self._runs[0][0]):
            heapq.heappop(self._heap)
            return
        _, number, rest = self._runs[0]
        following = next(rest, None)
        if following is None:
            heapq.heappop(self._runs)
        else:
            heapq.heapreplace(self._runs, (following, number, rest))

    def _spill(self) -> None:
        run = tempfile.TemporaryFile()
        self._heap.sort()
        for lo in range(0, len(self._heap), 1_024):
            pickle.dump(self._heap[lo:lo + 1_024], run)
        self._heap = []
        run.seek(0)
        rest = self._read(run)
        heapq.heappush(self._runs, (next(rest), id(run), rest))

    @staticmethod
    def _read(run):
        with run:
            while True:
                try:
                    yield from pickle.load(run)
                except EOFError:
                    return


def _totals(batches, queue: int):
    """Rows sorted by shard and reverse level order, with the totals of their subtrees.

    ``top`` marks a shard's root, whose totals its parent gets from outside.
    """
    names = ["sa", "sb", "depth", "a", "b", "pa", "pb", "own", "children", "leaves", "saved"]
    shard, messages = None, Messages(queue)
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in names}
        out = {n: [] for n in ("children", "leaves", "saved", "top")}
        for sa, sb, depth, a, b, up_a, up_b, own, children, leaves, saved in zip(*columns.values()):
            if (sa, sb) != shard:
                if messages:
                    raise RuntimeError("a subtree total was sent to a node that its shard does not hold")
                shard = (sa, sb)
            got = messages.take((-depth, a, b))
            if got is not None:
                children, leaves, saved = children + got[0], leaves + got[1], saved + got[2]
            leaves, saved, top = leaves + (children == 0), saved + own, (a, b) == shard
            if not top:
                messages.send((1 - depth, up_a, up_b), (1, leaves, saved))
            for n, x in zip(out, (children, leaves, saved, top)):
                out[n].append(x)
        kept = [n for n in batch.schema.names if n not in ("sa", "sb", "own", *out)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in kept), *(pa.array(out[n], pa.int64()) for n in ("children", "leaves", "saved")),
             pa.array(out["top"], pa.bool_())], names=[*kept, *out])


_NODE = "a bigint, b bigint, depth bigint, pa bigint, pb bigint, conv_id bigint, n_convs bigint"


def _passed(nodes: DataFrame, queue: int) -> DataFrame:
    spread = nodes.repartition("sa", "sb").sortWithinPartitions("sa", "sb", F.col("depth").desc(), "a", "b")
    spread = spread.select("sa", "sb", *(c.split()[0] for c in _NODE.split(", ")), "own", "children", "leaves", "saved")
    return spread.mapInArrow(lambda batches: _totals(batches, queue),
                             f"{_NODE}, children bigint, leaves bigint, saved bigint, top boolean")


def _pieces(batches):
    """(a, b, c, ids): ids of sorted rows joined with commas, ``PIECE`` at most, ``c`` the first of them."""
    def row(key, ids):
        return pa.RecordBatch.from_pydict({"a": [key[0]], "b": [key[1]], "c": [ids[0]], "ids": [",".join(map(str, ids))]})

    key, ids, out = None, [], []
    for batch in batches:
        for a, b, c in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "c"))):
            if (a, b) != key or len(ids) == PIECE:
                if ids:
                    out.append(row(key, ids))
                key, ids = (a, b), []
            ids.append(c)
        yield from _joined(out)
    if ids:
        yield from _joined([*out, row(key, ids)])


def _joined(rows: list):
    if rows:
        yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        rows.clear()


def _digests(batches):
    """(a, b, digest): SHA-256 of the pieces of each node, read as a sorted stream."""
    key, state, out = None, None, []

    def done():
        rows = list(zip(*out)) or [(), (), ()]
        kinds = (("a", pa.int64()), ("b", pa.int64()), ("digest", pa.string()))
        made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(rows, kinds)], names=[n for n, _ in kinds])
        out.clear()
        return made

    for batch in batches:
        for a, b, ids in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "ids"))):
            if (a, b) == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                out.append((*key, state.hexdigest()))
            key, state = (a, b), hashlib.sha256(ids.encode())
        yield done()
    if state is not None:
        out.append((*key, state.hexdigest()))
        yield done()


def _ends(ends: DataFrame) -> DataFrame:
    """Digest of the ids that end at each node. SHA-256 goes through its bytes in order, so ids are packed first."""
    packed = (ends.repartitionByRange("a", "b", "c").sortWithinPartitions("a", "b", "c")
              .mapInArrow(_pieces, "a bigint, b bigint, c bigint, ids string"))
    return (packed.repartition("a", "b").sortWithinPartitions("a", "b", "c")
            .mapInArrow(_digests, "a bigint, b bigint, digest string"))


def _packed(high: Column, low: Column) -> Column:
    """The lower halves of two sums as one number."""
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def _halves(number: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(number, 32), number.bitwiseAND(F.lit(_LOW))


def _rebuilt(turns: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(c, depth, m0..m3, n, rest) of every rebuilt turn, and (c, length) of every conversation.

    The four m are halves of two hashes of place, role and text, ``n`` the bytes of the text and
    ``rest`` the number of turns from this one on.
    """
    placed = tables.write(running_sums(turns.withColumn("one", F.lit(1)), ["c"], ["turn", "role", "t1", "t2"], {"one": "pos"})
                          .select("c", "pos", "t1", "t2", "n"), "turns")
    sizes = placed.groupBy("c").agg(F.count("*").alias("size"))
    based = sizes.select("c", "size", F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(SLOTS)).alias("h"),
                         (F.col("c") - F.col("c") % FAMILY).alias("base"))
    based = based.join(sizes.select(F.col("c").alias("base"), F.col("size").alias("base_size")), "base", "left")
    lead = F.least(F.col("h"), F.coalesce("base_size", F.lit(0)))
    known = tables.write(based.select("c", "base", "h", lead.alias("lead"),
                                      (lead + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    own = placed.join(known, "c").where("pos >= h").withColumn("depth", F.col("lead") + F.col("pos") - F.col("h") + 1)
    taken = (placed.where(F.col("pos") < SLOTS - 1).withColumnRenamed("c", "base").join(known, "base").where("pos < lead")
             .withColumn("depth", F.col("pos") + 1))
    one, two = F.xxhash64("depth", "t1", "t2"), F.xxhash64("t2", "t1", "depth")
    halves = [x.alias(f"m{i}") for i, x in enumerate((*_halves(one), *_halves(two)))]
    rows = [x.select("c", "depth", *halves, "n", (F.col("length") - F.col("depth") + 1).alias("rest")) for x in (own, taken)]
    return rows[0].unionByName(rows[1]), known.select("c", "length")


def trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
         text_col: str = "text", unit: int = UNIT, queue: int = QUEUE) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c is rebuilt from the first h turns of conversation c - c % 5 and its own turns
    after its first h, h = crc32(decimal c) % 9; the remainder of a negative c is not positive,
    as in SQL. ``conv_id`` is the smallest member of a node;
    with ``depth`` it names the node. ``unit`` is the weight that a shard may have more than the
    shards below it, ``queue`` the number of messages held in memory.

    Turns are ordered by turn, nulls first, then by role and a hash of the text; repeated rows are
    repeated turns. A null role or text is empty; a turn without a conversation id takes no part.
    Long texts are only hashed. An empty table gives no rows; other columns are not read.
    """
    spark, tables = turns.sparkSession, Tables(turns.sparkSession, "trie")
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    said = turns.select(
        turns[conv_col].cast("long").alias("c"), turns[turn_col].alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2"),
        F.octet_length(text).cast("long").alias("n")).where("c IS NOT NULL")
    rebuilt, known = _rebuilt(said, tables)
    sums = running_sums(rebuilt, ["c"], ["depth"], {f"m{i}": f"s{i}" for i in range(4)})
    ahead = [F.col(f"s{i}") + F.col(f"m{i}") for i in range(4)]
    paths = tables.write(sums.select(
        "c", "depth", "n", "rest", _packed(ahead[0], ahead[1]).alias("a"), _packed(ahead[2], ahead[3]).alias("b"),
        _packed(F.col("s0"), F.col("s1")).alias("pa"), _packed(F.col("s2"), F.col("s3")).alias("pb")), "paths")
    tables.drop("turns")
    least, n_convs, weight = known.agg(F.min("c"), F.count("*"), F.sum("length")).first()
    root = spark.createDataFrame([(0, 0, 0, None, None, least, n_convs, 0, weight or 0)] if n_convs else [],
                                 f"{_NODE}, own bigint, weight bigint")
    grown = paths.groupBy("a", "b", "depth").agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("c").alias("conv_id"), F.count("*").alias("n_convs"),
        ((F.count("*") - 1) * F.min("n")).alias("own"), F.sum("rest").alias("weight"))
    passes = 1
    while unit ** passes < (weight or 0):
        passes += 1
    level = F.lit(passes)
    for k in range(passes - 1, 0, -1):
        level = F.when(F.col("weight") <= unit ** k, k).otherwise(level)
    nodes = tables.write(grown.unionByName(root).withColumn("level", level).drop("weight"), "nodes")
    # The shard of a node is named by the first node of its level on the way from the root.
    on_path = paths.select("c", "a", "b", "depth").join(
        nodes.where(F.col("level") < passes).select("a", "b", "depth", "level"), ["a", "b", "depth"])
    shards = on_path.groupBy("c", "level").agg(F.min(F.struct("depth", "a", "b")).alias("top"))
    placed = tables.write(nodes.join(
        shards.select(F.col("c").alias("conv_id"), "level", F.col("top.a").alias("sa"), F.col("top.b").alias("sb")),
        ["conv_id", "level"], "left").fillna(0, ["sa", "sb"]), "placed")
    done = None
    for k in range(1, passes + 1):
        here = placed.where(F.col("level") == k)
        if done is None:
            here = here.select("*", *(F.lit(0).cast("long").alias(n) for n in ("children", "leaves", "saved")))
        else:
            sent = done.where("top").groupBy("pa", "pb").agg(
                F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            sent = sent.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "children", "leaves", "saved")
            here = here.join(sent, ["a", "b"], "left").fillna(0, ["children", "leaves", "saved"])
        now = tables.write(_passed(here, queue), f"pass-{k}")
        done = now if done is None else done.unionByName(now)
    ends = paths.where("rest = 1").select("a", "b", "c").unionByName(
        known.where("length = 0").select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "c"))
    digests = tables.write(_ends(ends), "ends")
    up = nodes.where("depth > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("above"))
    found = done.join(up, ["pa", "pb"], "left").join(digests, ["a", "b"], "left")
    tables.drop("paths", "conversations", "placed")
    return found.select(
        "conv_id", "depth", F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("above")).alias("parent_conv_id"),
        "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def oracle() -> str:
    """The same rows in DuckDB SQL over the table ``conversations``."""
    crc = """xor(list_reduce(list_prepend(4294967295::UBIGINT, [ascii(x)::UBIGINT FOR x IN string_split(c::VARCHAR, '')]),
      lambda s, x: list_reduce([xor(s, x), 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT],
        lambda r, _: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END)), 4294967295::UBIGINT)"""
    return f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c, count(*) AS size, CAST({crc} % {SLOTS} AS BIGINT) AS h FROM t GROUP BY c),
convs AS (SELECT s.c, s.h, s.c - s.c % {FAMILY} AS base, least(s.h, coalesce(b.size, 0)) AS lead
  FROM sizes s LEFT JOIN sizes b ON b.c = s.c - s.c % {FAMILY}),
rebuilt AS (SELECT v.c, t.pos, role, text FROM convs v JOIN t ON t.c = v.base AND t.pos < v.h
  UNION ALL SELECT v.c, v.lead + t.pos - v.h, role, text FROM convs v JOIN t ON t.c = v.c AND t.pos >= v.h),
seqs AS (SELECT v.c, list({{'role': role, 'text': text}} ORDER BY pos) FILTER (WHERE pos IS NOT NULL) AS s
  FROM convs v LEFT JOIN rebuilt r ON r.c = v.c GROUP BY v.c),
prefixes AS (SELECT c, unnest(range(0, coalesce(len(s), 0) + 1)) AS d, coalesce(s, []) AS s FROM seqs),
cut AS (SELECT c, d, s[1:d] AS p, len(s) = d AS ends, CASE WHEN d > 0 THEN strlen(s[d].text) ELSE 0 END AS n FROM prefixes),
nodes AS (SELECT d, p, min(c) AS id, count(*) AS n_convs, (count(*) - 1) * max(n) AS own,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM cut GROUP BY d, p),
path AS (SELECT c, d, id FROM cut JOIN nodes USING (d, p)),
linked AS (SELECT nodes.*, path.id AS up FROM nodes LEFT JOIN path ON path.c = nodes.id AND path.d = nodes.d - 1),
children AS (SELECT up AS id, d - 1 AS d, count(*) AS n FROM linked WHERE d > 0 GROUP BY ALL),
total AS (SELECT a.id, a.d, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum(own) AS saved
  FROM nodes v LEFT JOIN children k ON k.id = v.id AND k.d = v.d JOIN path a ON a.c = v.id AND a.d <= v.d GROUP BY a.id, a.d)
SELECT l.id AS conv_id, l.d AS depth, l.up AS parent_conv_id, l.n_convs, coalesce(k.n, 0) AS n_children,
  CAST(t.leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, ends_sha256
FROM linked l JOIN total t ON t.id = l.id AND t.d = l.d LEFT JOIN children k ON k.id = l.id AND k.d = l.d"""

"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, groups.

Lines are lower-cased, runs of digits become 0 and other ASCII signs a blank. Different lines
are linked if their fingerprints differ in at most two bits and their edit similarity is high
enough. Of four blocks of 16 bits two are then equal, so lines are joined on six pairs of
blocks, 32 bits each. Of every connected group the first occurrence stays.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motley.llm.common import let, temporary, whole
from motley.operators.components import components
from motley.workdir import materialize

DISTANCE, SIMILARITY, MIN_WORDS = 2, 0.8, 5
BLOCKS = tuple(combinations(range(4), DISTANCE))
CHUNK = 2_048
FILTER_BITS = 24
SLICE = 1 << 21  # characters looked at together; a longer text is looked at alone
_WORDS = 1 << 16  # words whose bits are spread out together

# ASCII signs and controls become blanks, digits 0; line feeds stay.
_PLAIN = bytes(10 if c == 10 else 48 if 48 <= c < 58 else c if 97 <= c < 123 or c > 127 else 32 for c in range(256))
_SHIFTS = np.arange(64, dtype=np.uint64)


def _powers(factor: int, size: int) -> np.ndarray:
    return np.cumprod(np.r_[1, np.full(size - 1, factor)].astype(np.uint64), dtype=np.uint64)


# Places beyond a table's end use it anew, so that equal words and lines hash alike wherever they stand.
_IN_WORD, _IN_LINE = _powers(0x9E3779B97F4A7C15, 1 << 12), _powers(0xC2B2AE3D27D4EB4F, 1 << 12)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of a 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _polynomial(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Mixed sums of values times the power of their place in their run."""
    place = np.arange(len(values)) - np.repeat(starts, sizes)
    return _mixed(np.add.reduceat(values * powers[place & (len(powers) - 1)], starts))


def _prints(hashes: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of runs of words; a word votes with its length, so the longer part of a line decides."""
    out, at = np.zeros(len(starts), dtype=np.uint64), np.r_[starts, len(hashes)]
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + _WORDS, side="right")) - 1)
        part, begin = slice(at[lo], at[hi]), at[lo:hi] - at[lo]
        total = np.add.reduceat(lengths[part], begin)
        bits = np.unpackbits(hashes[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        if total.max() < 1 << 16:  # four sums of 16 bits at a time, which cannot run over
            votes = bits * lengths[part].astype(np.uint16)[:, None]
            votes = np.add.reduceat(votes.view("<u8"), begin, axis=0).view("<u2").astype(np.int64)
        else:
            votes = np.array([lengths[part][a:b] @ bits[a:b] for a, b in zip(begin, np.r_[begin[1:], len(bits)])])
        out[lo:hi] = ((2 * votes > total[:, None]).astype(np.uint64) << _SHIFTS).sum(axis=1, dtype=np.uint64)
        lo = hi
    return out


def line_table(texts: list[str], min_words: int, with_norms: bool = False):
    """(text number, line number, hash, fingerprint, norms) of the lines with enough words.

    A norm is the line's words in lower case with one blank between them, a word being a
    run of letters, digits and characters beyond ASCII, its runs of digits one 0.
    """
    return _counted_lines(texts, min_words, with_norms)[:5]


def _counted_lines(texts: list[str], min_words: int, with_norms: bool):
    """``line_table`` and the number of words of each line."""
    plain = "\n".join(texts).lower().encode("utf-8", "replace").translate(_PLAIN)
    buffer = np.frombuffer(plain, dtype=np.uint8)
    zero = buffer == 48
    buffer = buffer[~(zero & np.r_[False, zero[:-1]])]
    blank = buffer <= 32
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    empty = [np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0, dtype=np.uint64)] * 2 + [[], np.zeros(0, dtype=np.int64)]
    if not len(starts):
        return empty
    ends = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    feeds = np.flatnonzero(buffer == 10)
    line = np.searchsorted(feeds, starts)
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    count = np.diff(np.r_[first, len(line)])
    some = count >= min_words
    if not some.any():
        return empty
    letters = np.where(blank, 0, buffer.astype(np.uint64) + 1)[starts[0]:]
    words = _polynomial(letters, starts - starts[0], np.diff(np.r_[starts, len(buffer)]), _IN_WORD)
    kept = np.repeat(some, count)
    words, lengths, count = words[kept], (ends - starts)[kept], count[some]
    begin = np.cumsum(count) - count
    hashes = _polynomial(words, begin, count, _IN_LINE)
    prints = _prints(words, lengths, begin)
    number = line[first[some]]
    per_text = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
    before = np.cumsum(per_text) - per_text
    text = np.searchsorted(before, number, side="right") - 1
    norms = []
    if with_norms:
        last = ends[np.cumsum(np.diff(np.r_[first, len(line)]))[some] - 1]
        norms = [b" ".join(buffer[a:b].tobytes().split()).decode() for a, b in zip(starts[first[some]], last)]
    return text, number - before[text], hashes, prints, norms, count


def _sliced(batch: pa.RecordBatch, min_words: int, with_norms: bool):
    """``_counted_lines`` over slices of the texts of a batch, with the number of each slice's first row."""
    texts = [t or "" for t in batch.column("text").to_pylist()]
    lo = 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) <= SLICE:
            size += len(texts[hi])
            hi += 1
        yield lo, _counted_lines(texts[lo:hi], min_words, with_norms)
        lo = hi


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, text); th is a hash of the whole text."""
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _lines(texts: DataFrame, min_words: int, short: bool) -> DataFrame:
    """(id, th, pos, h, f, long): place, hash and fingerprint of every line with enough words, or with ``short`` any."""
    def run(batches):
        for batch in batches:
            for lo, (text, pos, h, f, _, count) in _sliced(batch, 1 if short else min_words, False):
                rows = pa.array(text + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("th").take(rows), pa.array(pos.astype(np.int32)),
                     pa.array(h.view(np.int64)), pa.array(f.view(np.int64)), pa.array(count >= min_words)],
                    names=["id", "th", "pos", "h", "f", "long"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, th bigint, pos int, h bigint, f bigint, long boolean")


def _norms(texts: DataFrame, min_words: int) -> DataFrame:
    """(h, norm) of every line with enough words."""
    def run(batches):
        for batch in batches:
            for _, (_, _, h, _, norms, _) in _sliced(batch, min_words, True):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(norms, pa.string())], names=["h", "norm"])

    return texts.mapInArrow(run, "h bigint, norm string")


def _keyed(lines: DataFrame) -> DataFrame:
    """(k, h, f): a row for each pair of blocks; k holds the pair and its 32 bits."""
    def block(i):
        return F.shiftrightunsigned("f", 16 * i).bitwiseAND(F.lit(0xFFFF))

    keys = [F.lit(n << 32).bitwiseOR(F.shiftleft(block(a), 16)).bitwiseOR(block(b)) for n, (a, b) in enumerate(BLOCKS)]
    return lines.select(F.explode(F.array(*keys)).alias("k"), "h", "f")


def _runs(batches, columns):
    """Rows with equal first column of a sorted stream, at most CHUNK at a time, and their number in the run.

    Runs of one row are skipped.
    """
    held, number = None, 0
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if not len(now[0]):
            continue
        starts = np.flatnonzero(np.r_[True, now[0][1:] != now[0][:-1]])
        sizes = np.diff(np.r_[starts, len(now[0])])
        edge = np.isin(np.arange(len(starts)), [0, len(starts) - 1])  # may go on in another batch
        for at, size in zip(starts[edge | (sizes > 1)], sizes[edge | (sizes > 1)]):
            rows = [x[at:at + size] for x in now]
            if held is not None and held[0][0] == rows[0][0]:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            elif held is not None:
                if number or len(held[0]) > 1:
                    yield held, number
                number = 0
            while len(rows[0]) > CHUNK:
                yield [x[:CHUNK] for x in rows], number
                number, rows = number + 1, [x[CHUNK:] for x in rows]
            held = rows
    if held is not None and (number or len(held[0]) > 1):
        yield held, number


def _canonical(diff: np.ndarray) -> np.ndarray:
    """Number of the first pair of blocks in which nothing differs."""
    first = np.full(diff.shape, len(BLOCKS))
    for n in reversed(range(len(BLOCKS))):
        mask = np.uint64(sum(0xFFFF << (16 * i) for i in BLOCKS[n]))
        first[(diff & mask) == 0] = n
    return first


def _near(prints: np.ndarray, one: np.uint64, kind: int) -> np.ndarray:
    """Whether fingerprints are within the distance of one, and this kind of key is the pair's first."""
    diff = prints ^ one
    return (np.bitwise_count(diff) <= DISTANCE) & (_canonical(diff) == kind)


def _candidates(batches):
    """Rows (k, chunk, h, f) that have a near neighbour under their key; long runs whole, in chunks."""
    for (k, h, f), chunk in _runs(batches, ["k", "h", "f"]):
        values = f.view(np.uint64)
        keep = np.ones(len(k), dtype=bool)
        if len(k) < CHUNK and not chunk:
            kind = int(k[0]) >> 32
            for i in range(len(k)):
                keep[i] = _near(values, values[i], kind).sum() > (kind == 0)  # not counting itself
        if keep.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(k[keep]), pa.array(np.full(keep.sum(), chunk)), pa.array(h[keep]), pa.array(f[keep])],
                names=["k", "chunk", "h", "f"])


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time in the bits of whole numbers."""
    while a and b and a[0] == b[0]:
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        a, b = a[n:], b[n:]
    while a and b and a[-1] == b[-1]:
        n = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
        a, b = a[:len(a) - n], b[:len(b) - n]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for c in b:
        equal = places.get(c, 0)
        diagonal = (((equal & up) + up) ^ up) | equal
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        distance += bool(plus & last) - bool(minus & last)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        either = equal | down
        up, down = minus | (full & ~(either | plus)), plus & either
    return distance


def similar(a: str, b: str, threshold: float) -> bool:
    """Whether 1 - distance / longer length reaches the threshold."""
    longer = max(len(a), len(b))
    if abs(len(a) - len(b)) > (1 - threshold) * longer:
        return False
    return edit_distance(a, b) <= (1 - threshold) * longer


def _links(group: pa.Table, threshold: float) -> list[tuple[int, int]]:
    """Links of one bucket, or one pair of its chunks, that join what all its similar pairs join."""
    prints = group.column("f").to_numpy().view(np.uint64)
    nodes, chunk = group.column("node").to_numpy(), group.column("chunk").to_numpy()
    norms, kind = group.column("norm").to_pylist(), group.column("k")[0].as_py() >> 32
    mixed = chunk.min() != chunk.max()
    label, out = np.arange(len(nodes)), []
    for i in range(len(nodes)):
        near = np.flatnonzero(_near(prints[i + 1:], prints[i], kind) & (label[i + 1:] != label[i])) + i + 1
        for j in near:
            if label[j] == label[i] or nodes[i] == nodes[j] or mixed and chunk[i] == chunk[j]:
                continue
            if similar(norms[i], norms[j], threshold):
                out.append((int(nodes[i]), int(nodes[j])))
                label[label == label[j]] = label[i]
    return out


def _linked(batches, threshold: float):
    """Links (a, b) of a stream sorted by key and pair of chunks; a group is held at a time."""
    def made(rows):
        found = _links(pa.Table.from_batches(rows), threshold)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, pair = batch.column("k").to_numpy(), batch.column("pair").to_numpy()
        starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (pair[1:] != pair[:-1])])
        for a, b in zip(starts, np.r_[starts[1:], len(k)]):
            if held and (k[a], pair[a]) != key:
                yield made(held)
                held = []
            key = (k[a], pair[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield made(held)


def _holding(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts whose hash ``th`` is among the wanted ones, and a few others.

    A filter of 2**24 bits, whatever the input, is made of the hashes and broadcast, so that
    no text is shuffled. The join that decides comes later.
    """
    slot = F.pmod("th", F.lit(1 << FILTER_BITS))
    bit = slot.bitwiseAND(F.lit(63)).cast("int")
    bits = (wanted.select(F.shiftright(slot, 6).alias("word"), bit.alias("bit")).groupBy("word")
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits")))
    held = F.call_function("shiftright", F.col("bits"), bit).bitwiseAND(F.lit(1)) == 1
    return texts.withColumn("word", F.shiftright(slot, 6)).join(F.broadcast(bits), "word").where(held).select("id", "th", "text")


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                threshold: float = SIMILARITY, short: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, th, pos, h, f) of all lines, (h, f, first) of the distinct ones and (h, f, first) of the linked ones.

    ``first`` is the first occurrence (no_id, id, th, pos) of the line itself, for the linked
    ones that of their group. Only lines with a near neighbour, few of all, are joined for it.
    """
    texts = _texts(docs, id_col, text_col)
    seen = materialize(_lines(texts, min_words, short), "lines")
    place = F.struct(F.isnull("id").alias("no_id"), "id", "th", "pos")
    lines = materialize(seen.groupBy("h", "f", "long").agg(F.min(place).alias("first")), "distinct-lines")
    keyed = _keyed(lines.where("long")).repartition("k").sortWithinPartitions("k", "f", "h")
    near = materialize(keyed.mapInArrow(_candidates, "k bigint, chunk bigint, h bigint, f bigint"), "near-lines")
    few = materialize(lines.join(near.select("h", "f").distinct(), ["h", "f"]).withColumn("node", F.xxhash64("h", "f")), "few-lines")
    some = _holding(texts, few.select("first.th"))
    norms = _norms(some, min_words).join(few.select("h").distinct(), "h").distinct()

    chunks = near.groupBy("k").agg(F.max("chunk").alias("top"))
    i, top = F.col("chunk"), F.col("top")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), top),
                        lambda j: F.least(i, j) * (top + 1) + F.greatest(i, j))
    rows = (near.join(chunks, "k").withColumn("pair", F.explode(pairs)).join(norms, "h")
            .withColumn("node", F.xxhash64("h", "f"))
            .select("k", "pair", "chunk", "node", "f", "norm"))
    links = rows.repartition("k", "pair").sortWithinPartitions("k", "pair").mapInArrow(
        lambda batches: _linked(batches, threshold), "a bigint, b bigint")
    grouped = few.join(components(links, "a", "b"), "node")
    of_root = grouped.groupBy("root").agg(F.min("first").alias("first"))
    return seen.drop("long"), lines.drop("long"), grouped.drop("first").join(of_root, "root").select("h", "f", "first")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None,
                 min_words: int = MIN_WORDS, threshold: float = SIMILARITY, short: bool = False) -> DataFrame:
    """The rows with every line gone that is not the first of its group, other columns unchanged.

    Occurrences are ordered by id, nulls last, then by a hash of the text and by line number.
    Lines with fewer than ``min_words`` normalised words say too little to be linked with
    similar ones: they stay or, with ``short``, go where they repeat. A null text
    stays null, an empty one empty. Rows that repeat both id and text are one document and
    come out alike. ``removed_col`` names a new column with the number of lines removed. An
    empty table gives no rows; the table may have any other columns.
    """
    seen, lines, linked = line_groups(docs, id_col, text_col, min_words, threshold, short)
    place = F.struct(F.isnull("id").alias("no_id"), "id", "th", "pos")
    first = F.coalesce("group_first", "first")
    gone = (seen.join(lines, ["h", "f"]).join(linked.withColumnRenamed("first", "group_first"), ["h", "f"], "left")
            .where(~place.eqNullSafe(first))
            .groupBy("id", "th").agg(F.collect_set("pos").alias("gone")))
    names = [*docs.columns, "id", "th", "gone"]
    mark = temporary(names, "_th")
    marked = docs.withColumn(mark, F.xxhash64(docs[text_col].cast("string")))
    joined = marked.join(gone, F.col(mark).eqNullSafe(gone["th"]) & marked[id_col].eqNullSafe(gone["id"]), "left")
    text, removed = marked[text_col].cast("string"), gone["gone"]
    kept = let(F.split(whole(text), "\n"), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed), lambda i: F.get(lines, i)), "\n"))
    columns = [(F.when(removed.isNull(), text).otherwise(kept) if c == text_col else marked[c]).alias(c)
               for c in docs.columns]
    if removed_col:
        columns.append(F.coalesce(F.size(removed), F.lit(0)).alias(removed_col))
    return joined.select(*columns)

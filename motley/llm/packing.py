"""Variable-capacity best-fit packing, planned on the histogram of lengths.

Best-fit decreasing only looks at lengths, and there are no more of these than the largest
permitted size. So the plan is made once from the counts per length, for whole classes of
equal bins at a time: longest first, each into the fullest bins that still hold it. Where no
bin does, the permitted size is opened whose best-fit filling with what is left costs least
per token. At the end every bin shrinks to the smallest size that holds its contents. The
rows then only look up their place by their number within their length.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motley.llm.running import running_sums
from motley.workdir import materialize

SIZES = (2_048, 4_096, 8_192)
OPENING = 64


@dataclass
class Run:
    """``per_bin`` items of one length at the same place of ``bins`` bins from ``first_bin`` on."""

    length: int
    first_item: int
    bins: int
    per_bin: int
    first_bin: int
    offset: int


class Plan:
    """Runs of items and the final size of each class of bins."""

    def __init__(self, counts: dict[int, int], sizes=SIZES, opening: int = OPENING):
        """``opening`` is the fixed cost of a bin beside its size."""
        self.sizes, self.opening = sorted(sizes), opening
        self.runs: list[Run] = []
        self.classes: list[tuple[int, int, int]] = []  # (first bin, bins, used)
        self._left = dict(sorted(counts.items(), reverse=True))
        self._free: dict[int, list[tuple[int, int, int]]] = {}  # by room left: (first bin, bins, used)
        self._rooms: list[int] = []
        self.bins = 0
        for length in list(self._left):
            self._place(length, self._left.pop(length))
        for classes in self._free.values():
            self.classes += classes
        self.classes.sort()

    def _offer(self, room: int, first: int, bins: int, used: int) -> None:
        if room not in self._free:
            self._free[room] = []
            bisect.insort(self._rooms, room)
        self._free[room].append((first, bins, used))

    def _take(self, length: int):
        """A class of bins with the least room that holds the length."""
        at = bisect.bisect_left(self._rooms, length)
        if at == len(self._rooms):
            return None
        room = self._rooms[at]
        found = self._free[room].pop()
        if not self._free[room]:
            del self._free[room], self._rooms[at]
        return room, *found

    def _fill(self, room: int, first: int, bins: int, used: int, length: int, item: int, count: int) -> int:
        """Put items of one length into a class of equal bins, bin by bin; returns how many."""
        per = room // length
        full = min(bins, count // per)
        if full:
            self.runs.append(Run(length, item, full, per, first, used))
            self._offer(room - per * length, first, full, used + per * length)
        rest = count - full * per if full < bins else 0
        if rest:
            rest = min(rest, per)
            self.runs.append(Run(length, item + full * per, 1, rest, first + full, used))
            self._offer(room - rest * length, first + full, 1, used + rest * length)
        if untouched := bins - full - bool(rest):
            self._offer(room, first + bins - untouched, untouched, used)
        return full * per + rest

    def _cheapest(self, length: int, count: int) -> int:
        """The size whose bin, begun with this length and filled best-fit from what is left, costs least per token."""
        best = None
        for size in (s for s in self.sizes if s >= length):
            room = size - min(count, size // length) * length
            for other, n in self._left.items():
                if not room:
                    break
                if other <= room:
                    room -= min(n, room // other) * other
            used = size - room
            fitted = next(s for s in self.sizes if s >= used)
            key = ((fitted + self.opening) / used, size)
            best = min(best, key) if best else key
        return best[1]

    def _place(self, length: int, count: int) -> None:
        item = 0
        while count and (found := self._take(length)):
            done = self._fill(*found, length, item, count)
            item, count = item + done, count - done
        if count:
            size = self._cheapest(length, count)
            bins = -(-count // (size // length))
            self._fill(size, self.bins, bins, 0, length, item, count)
            self.bins += bins

    def lookup(self):
        """Arrays that ``place`` searches: sorted keys of the runs, the runs and the bins' final sizes."""
        runs = sorted(self.runs, key=lambda r: (r.length, r.first_item))
        table = np.array([(r.length, r.first_item, r.per_bin, r.first_bin, r.offset) for r in runs],
                         dtype=np.int64).reshape(-1, 5)
        classes = np.array([(first, next(s for s in self.sizes if s >= used), used) for first, _, used in self.classes],
                           dtype=np.int64).reshape(-1, 3)
        return table, classes


def place(table: np.ndarray, classes: np.ndarray, length: np.ndarray, item: np.ndarray):
    """Bin, offset, final size and contents of the bin for the items of given lengths and numbers."""
    order = np.lexsort((item, length))
    borders = np.searchsorted(table[:, 0], length[order], side="left")
    ends = np.searchsorted(table[:, 0], length[order], side="right")
    run = np.empty(len(order), dtype=np.int64)
    for lo in np.flatnonzero(np.r_[True, np.diff(borders) != 0][:len(order)]):
        a, b = borders[lo], ends[lo]
        hi = lo + np.searchsorted(borders[lo:], a, side="right")
        run[lo:hi] = a + np.searchsorted(table[a:b, 1], item[order[lo:hi]], side="right") - 1
    at = np.empty(len(order), dtype=np.int64)
    at[order] = run
    _, first_item, per_bin, first_bin, offset = table[at].T
    nth = item - first_item
    bins = first_bin + nth // per_bin
    kind = np.searchsorted(classes[:, 0], bins, side="right") - 1
    return bins, offset + nth % per_bin * length, classes[kind, 1], classes[kind, 2]


def pieces(docs: DataFrame, length, id_col: str = "doc_id", largest: int = max(SIZES)) -> DataFrame:
    """(id, piece, start, length): each document cut into pieces of at most ``largest`` tokens.

    ``length`` is a column with the number of tokens; null and less than 1 give no piece.
    """
    n = F.coalesce(length.cast("long"), F.lit(0).cast("long"))
    counted = docs.select(docs[id_col].alias("id"), n.alias("n")).where("n > 0")
    cut = counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / largest))))
    start = F.col("piece") * largest
    return cut.select("id", "piece", start.alias("start"), F.least(F.lit(largest).cast("long"), F.col("n") - start).alias("length"))


def pack(docs: DataFrame, length, id_col: str = "doc_id", sizes=SIZES, opening: int = OPENING) -> DataFrame:
    """(id, piece, start, length, bin, offset, size, used): one row per piece of a document.

    A bin is a training sequence of ``size`` tokens of which ``used`` are filled; a piece
    takes ``length`` tokens of its document from ``start`` on and stands at ``offset``. A
    document longer than the largest size is cut there, nothing is dropped. Documents without
    tokens have no piece. Equal lengths are told apart by id, then piece; repeated rows each
    take a place. An empty table gives no rows; other columns are not read.
    """
    sizes = tuple(sorted(set(sizes)))
    if not sizes or sizes[0] < 1:
        raise ValueError(f"sizes must be positive, not {sizes}")
    cut = materialize(pieces(docs, length, id_col, sizes[-1]).withColumn("one", F.lit(1).cast("long")), "pieces")
    numbered = running_sums(cut, ["length"], ["id", "piece"], {"one": "item"})
    # At most one row per length up to the largest size, whatever the input.
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    shared = docs.sparkSession.sparkContext.broadcast(Plan(counts, sizes, opening).lookup())

    def run(batches):
        table, classes = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            found = place(table, classes, *(batch.column(c).to_numpy() for c in ("length", "item")))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "piece", "start", "length")), *(pa.array(x) for x in found)],
                names=["id", "piece", "start", "length", "bin", "offset", "size", "used"])

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["piece", "start", "length", "bin", "offset", "size", "used"]
    packed = numbered.select("id", "piece", "start", "length", "item").mapInArrow(
        run, ", ".join([f"id {kind}", *(f"{n} bigint" for n in names)]))
    return packed.withColumnRenamed("id", id_col)

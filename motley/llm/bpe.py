"""Byte-level BPE: merges chosen by a segment tree over byte positions.

The leaves of the tree are the byte positions of one piece of text; a leaf holds the rank of
the pair that begins there, or a bound above all ranks if the position is dead or its pair
has no rank. Every node keeps the lower rank of its children, the left one on ties, so the
root names the leftmost pair of least rank. A merge joins two live neighbours and changes
three leaves at most, each in logarithmic time.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NO_RANK = 1 << 30
CACHE = 1 << 20
LONG = 64
# Fixed value: the white space of Unicode, which the pattern's \s and \S stand for.
_SPACE = r"\t-\r \x85\xa0  -     　"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file with lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def compiled(pattern: str) -> regex.Pattern:
    r"""The split pattern with \s and \S spelled out, as libraries differ on control characters."""
    inside = pattern.replace(r"[^\s\p", rf"[^{_SPACE}\p")
    return regex.compile(inside.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece by merging the leftmost pair of least rank until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 2).bit_length()  # leaves, at least one per pair
    ends = list(range(1, n + 1))      # of the part that begins at a live position
    before = list(range(-1, n - 1))   # the live position to the left
    rank_of, none = ranks.get, NO_RANK
    tree = [none] * size + [rank_of(piece[i:i + 2], none) for i in range(n - 1)] + [none] * (size - n + 1)
    for node in range(size - 1, 0, -1):
        left, right = tree[node + node], tree[node + node + 1]
        tree[node] = left if left <= right else right

    while (least := tree[1]) != none:
        node = 1
        while node < size:  # the left child unless only the right one has it
            node += node
            if tree[node] != least:
                node += 1
        at = node - size
        middle = ends[at]
        end = ends[at] = ends[middle]
        if end < n:
            before[end] = at
            changed = [(at, rank_of(piece[at:ends[end]], none)), (middle, none)]
        else:
            changed = [(at, none), (middle, none)] if middle < n - 1 else [(at, none)]
        if at:
            left = before[at]
            changed.append((left, rank_of(piece[left:end], none)))
        for position, rank in changed:
            node = size + position
            if tree[node] == rank:
                continue
            tree[node] = rank
            node >>= 1
            while node:
                left, right = tree[node + node], tree[node + node + 1]
                if right < left:
                    left = right
                if tree[node] == left:
                    break
                tree[node] = left
                node >>= 1
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at:ends[at]]])
        at = ends[at]
    return out


class Codec:
    """Encodes texts and decodes ids by one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, compiled(pattern)
        self.known: dict[str, bytes] = {}
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def _piece(self, piece: str) -> bytes:
        return np.array(merge(piece.encode(), self.ranks), dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a null text has none.

        Pieces are remembered up to ``CACHE`` of them, then forgotten together; long ones never are.
        """
        known, out = self.known, []
        for piece in self.pattern.findall(text or ""):
            ids = known.get(piece)
            if ids is None:
                ids = self._piece(piece)
                if len(piece) <= LONG:
                    if len(known) >= CACHE:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_codecs: dict[tuple, Codec] = {}


def _codec(key: tuple, shared, pattern: str) -> Codec:
    """One codec per Python worker and vocabulary, with what it remembers."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value, pattern)
    return _codecs[key]


def _shared(spark: SparkSession, ranks: dict[bytes, int]):
    """The ranks as a broadcast; their size is that of the vocabulary, not of the data."""
    digest = hashlib.sha256(repr(sorted(ranks.items())[:64]).encode() + str(len(ranks)).encode()).hexdigest()
    return spark.sparkContext.broadcast(ranks), digest


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
           emit=("n_tokens", "ids", "decoded")) -> DataFrame:
    """(id, ...): one row per input row with the columns named in ``emit``.

    ``n_tokens`` is the number of ids, ``ids`` their little-endian unsigned 32-bit bytes,
    ``decoded`` the bytes the ids stand for, ``ids_sha256`` and ``decoded_sha256`` the hex
    digests of these. Null and empty texts have no ids. Repeated rows are encoded one by one,
    an empty table gives no rows, other columns are not read. ``ranks`` must hold all single bytes.
    """
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the ranks lack the single bytes {missing[:5]}; a text with one could not be encoded")
    shared, digest = _shared(docs.sparkSession, ranks)
    kinds = {"n_tokens": ("bigint", pa.int64()), "ids": ("binary", pa.binary()), "decoded": ("binary", pa.binary()),
             "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    unknown = [c for c in emit if c not in kinds]
    if unknown:
        raise ValueError(f"emit names {unknown}; known are {sorted(kinds)}")

    def run(batches):
        codec = _codec((digest, pattern), shared, pattern)
        for batch in batches:
            made: dict[str, list] = {c: [] for c in emit}
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                plain = codec.decode(ids) if {"decoded", "decoded_sha256"} & set(emit) else b""
                values = {"n_tokens": len(ids) // 4, "ids": ids, "decoded": plain}
                for c in emit:
                    made[c].append(hashlib.sha256(values[c[:-7]]).hexdigest() if c.endswith("_sha256") else values[c])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[c], kinds[c][1]) for c in emit)],
                                             names=["id", *emit])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, ", ".join([f"id {kind}", *(f"{c} {kinds[c][0]}" for c in emit)])).withColumnRenamed(
        "id", id_col)


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the bytes that each row's ids stand for; null ids give null."""
    shared, digest = _shared(encoded.sparkSession, ranks)

    def run(batches):
        codec = _codec((digest, ""), shared, "")
        for batch in batches:
            made = [None if x.as_py() is None else codec.decode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    picked = encoded.select(encoded[id_col].alias("id"), F.col(ids_col).alias("ids"))
    return picked.mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)

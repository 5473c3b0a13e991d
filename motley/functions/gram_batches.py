"""N-grams of many texts at once: least and largest hashes, and counts.

The n-grams of a batch of texts are numbered by arrays, so that each distinct one is cut out and
hashed once per batch and what remains per character is a look-up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from motley.functions.hashing import FACTOR, PRIME, STEP, portable_value

ROOM = 1 << 20  # characters numbered at a time; a longer text is a batch of its own
NONE = (2**31 - 1, -(2**31))  # least and largest of a text without n-grams; no hash takes these values


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """The distinct codes by numbers from 0 on, and how many they are."""
    top = int(codes.max(initial=-1)) + 1
    if top <= 4 * len(codes) + (1 << 16):
        seen = np.zeros(top, dtype=bool)
        seen[codes] = True
        return (np.cumsum(seen) - 1)[codes], int(seen.sum())
    found, numbers = np.unique(codes, return_inverse=True)
    return numbers, len(found)


def _batches(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    lo = size = 0
    for i, text in enumerate(texts):
        if i > lo and size + len(text) > ROOM:
            yield lo, texts[lo:i]
            lo, size = i, 0
        size += len(text)
    yield lo, texts[lo:]


def _grams(texts: list[str], sizes: range) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """For each size: the text of every n-gram, its number, and the distinct n-grams by number."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    joined = "".join(texts)
    if not joined:
        return
    chars, n_chars = _numbered(np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), lengths)
    left = np.cumsum(lengths)[owner] - np.arange(len(owner))  # characters up to the end of the text
    at, number, n = np.arange(len(owner)), chars, n_chars
    for size in range(1, max(sizes) + 1):
        if size > 1:
            number = number[left[at] >= size]
            at = at[left[at] >= size]
            if not len(at):
                return
            number, n = _numbered(number * n_chars + chars[at + size - 1])
        if size in sizes:
            place = np.empty(n, dtype=np.int64)
            place[number] = at
            yield owner[at], number, [joined[p:p + size] for p in place.tolist()]


def _fill(texts: list[str], sizes: range, low: np.ndarray, high: np.ndarray | None, hashed: Callable[[bytes], int]) -> None:
    for rows, number, pieces in _grams(texts, sizes):
        base = np.array([hashed(x.encode()) for x in pieces], dtype=np.int64)
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        mine = rows[first]
        for seed in range(low.shape[1]):
            values = ((base * (FACTOR + STEP * seed) + seed) % PRIME)[number]
            low[mine, seed] = np.minimum(low[mine, seed], np.minimum.reduceat(values, first))
            if high is not None:
                high[mine, seed] = np.maximum(high[mine, seed], np.maximum.reduceat(values, first))


def least_hashes(texts: list[str], sizes: range, seeds: int, largest: bool = False,
                 hashed: Callable[[bytes], int] = portable_value) -> np.ndarray:
    """A row per text: the least hash of its n-grams for each seed, with ``largest`` each followed by the largest."""
    low = np.full((len(texts), seeds), NONE[0], dtype=np.int64)
    high = np.full((len(texts), seeds), NONE[1], dtype=np.int64) if largest else None
    for lo, some in _batches(texts):
        _fill(some, sizes, low[lo:lo + len(some)], None if high is None else high[lo:lo + len(some)], hashed)
    return low if high is None else np.stack([low, high], axis=2).reshape(len(texts), 2 * seeds)


def portable_least(c: Column, sizes: range, seeds: int, largest: bool = False) -> Column:
    """``least_hashes`` as a column of arrays; a null counts as an empty text."""
    width = seeds * (2 if largest else 1)

    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        found = least_hashes([t or "" for t in texts.to_pylist()], sizes, seeds, largest)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * width, pa.int32()), pa.array(found.ravel()))

    return run(c)


def gram_counts(c: Column, n: int) -> Column:
    """The distinct n-grams of each text with their counts, as an array of (gram, n); empty for a null."""

    @F.arrow_udf("array<struct<gram string, n bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        sizes, found, counts = [np.zeros(0, dtype=np.int64)], [pa.array([], pa.string())], [np.zeros(0, dtype=np.int64)]
        for _, some in _batches([t or "" for t in texts.to_pylist()]):
            size = np.zeros(len(some), dtype=np.int64)
            for rows, number, pieces in _grams(some, range(n, n + 1)):
                pairs, times = np.unique(rows * len(pieces) + number, return_counts=True)
                size += np.bincount(pairs // len(pieces), minlength=len(some))
                found.append(pa.array(pieces, pa.string()).take(pa.array(pairs % len(pieces))))
                counts.append(times)
            sizes.append(size)
        rows = pa.StructArray.from_arrays([pa.concat_arrays(found), pa.array(np.concatenate(counts), pa.int64())], ["gram", "n"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), pa.int32()), rows)

    return run(c)

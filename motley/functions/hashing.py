"""Choices made by hash: the same on every run, whatever the partitioning."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the arithmetic hash that other SQL engines can also compute.
MODULUS = 1000003
FACTOR = 265443
STEP = 7919


def mixed_hash(key: Column, seed: int | Column = 0) -> Column:
    """Arithmetic hash of an integer key into 0..MODULUS-1."""
    return F.pmod(F.pmod(key.cast("bigint"), F.lit(MODULUS)) * (F.lit(FACTOR) + F.lit(STEP) * F.lit(seed)), F.lit(MODULUS))


def mixed_hash_sql(key: str, seed: int | str = 0) -> str:
    """The same hash as SQL text (keys are not negative)."""
    return f"((({key}) % {MODULUS}) * ({FACTOR} + {STEP} * ({seed}))) % {MODULUS}"


def widened(hashed: Column) -> Column:
    """The arithmetic hash over the range of a 64-bit one, in the same order."""
    return hashed * F.lit(2**43)


# Fixed value: the modulus of the portable seeded hashes.
PRIME = 2**31 - 1


def portable(text: Column) -> Column:
    """Hash of a text that other engines can compute: the leading 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def portable_value(text: bytes) -> int:
    """The same hash of UTF-8 bytes in plain Python."""
    return int.from_bytes(md5(text, usedforsecurity=False).digest()[:4], "big")


def reseeded(hashed: Column, seed: Column) -> Column:
    """One of a family of hashes below PRIME, from a 32-bit hash."""
    return F.pmod(hashed * (F.lit(FACTOR) + F.lit(STEP) * seed) + seed, F.lit(PRIME))


def portable_sql(text: str, seed: str | None = None) -> str:
    """The same hash as DuckDB SQL."""
    base = f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"
    return base if seed is None else f"(({base} * ({FACTOR} + {STEP} * {seed}) + {seed}) % {PRIME})"


def seeded(key: Column, seed: int = 0) -> Column:
    """64-bit hash of any value."""
    return F.xxhash64(key, F.lit(seed))

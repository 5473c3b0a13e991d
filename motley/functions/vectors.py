"""Expressions on embedding columns (arrays of floats)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motley.functions.binding import let


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return let(l2_norm(v), lambda norm: F.when(norm == 0, v.cast("array<double>")).otherwise(
        F.transform(v, lambda x: x.cast("double") / norm)))


def reverse_embedding(v: Column, table_id: Column, tables: list[int]) -> Column:
    """Reverse the dimensions for the rows of the given tables."""
    return F.when(table_id.isin(tables), F.reverse(v)).otherwise(v)


def cast_float32(v: Column) -> Column:
    return v.cast("array<float>")


def hstack(*blocks: Column) -> Column:
    """Concatenate scalars and arrays into one array of doubles."""
    return F.concat(*blocks)


def scalar_block(c: Column) -> Column:
    return F.array(c.cast("double"))


def usable(vec: Column, size: int | None = None) -> Column:
    """Whether a vector is there, has no null component and, if given, the size; never null."""
    whole = vec.isNotNull() & ~F.exists(F.coalesce(vec, F.array().cast("array<double>")), lambda x: x.isNull())
    whole = whole if size is None else whole & (F.size(vec) == size)
    return F.coalesce(whole, F.lit(False))

"""Bind a value once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Expressions named inside a lambda are evaluated for every element; a
    lambda over a one-element array turns them into a variable first.
    """
    return F.element_at(F.transform(F.array(value), body), 1)

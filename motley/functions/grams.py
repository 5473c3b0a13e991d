"""Character n-grams as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motley.functions.binding import let


def _join(chars: Column, n: int) -> Column:
    last = F.size(chars) - F.lit(n - 1)
    return F.when(
        last >= 1,
        F.transform(
            F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
            lambda i: F.concat(*[F.element_at(chars, i + k) for k in range(n)]),
        ),
    ).otherwise(F.array().cast("array<string>"))


def windows(c: Column, *sizes: int) -> Column:
    """All substrings of each length in order; none when c is shorter.

    The text is cut into characters once, so the work is linear in its length.
    """
    chars = F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))
    return let(chars, lambda ch: F.concat(*[_join(ch, n) for n in sizes]))


def padded(c: Column) -> Column:
    """Lower case, blanks squeezed, one blank on each side."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " ")), F.lit(" "))


def preprocess(c: Column) -> Column:
    """One blank on each side, then runs of blanks to one blank."""
    return F.regexp_replace(F.concat(F.lit(" "), c, F.lit(" ")), r"(?U)\s\s+", " ")


def ngram_list(c: Column, n: int) -> Column:
    return windows(padded(c), n)


def ngram_set(c: Column, n: int) -> Column:
    return F.array_distinct(ngram_list(c, n))


def range_grams(c: Column, lo: int, hi: int) -> Column:
    """n-grams for every n in lo..hi of the preprocessed, lower-cased text."""
    s = F.lower(preprocess(c))
    return windows(s, *range(lo, hi + 1))


def ngram_count(c: Column, lo: int, hi: int) -> Column:
    """Sum over n of (length - n + 1); negative terms are kept."""
    return sum(F.length(c) - F.lit(n - 1) for n in range(lo, hi + 1))


def trigrams(c: Column) -> Column:
    """3-grams with two blanks on each side, case kept."""
    return windows(F.concat(F.lit("  "), c, F.lit("  ")), 3)


def trigram_set(c: Column) -> Column:
    return F.array_distinct(trigrams(c))


def trigram_count(c: Column) -> Column:
    """Number of distinct 3-grams of the text itself."""
    return F.size(F.array_distinct(windows(c, 3)))


def trigram_common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(windows(a, 3), windows(b, 3)))


def numbered(grams: Column) -> Column:
    """Tag repeats (a, a, b) -> (a 1, a 2, b 1): multisets become plain sets.

    Quadratic in the number of grams, so meant for category strings; whole
    texts go through ``operators.pairs.gram_counts`` instead.
    """
    return let(F.array_sort(grams), lambda ordered: F.transform(
        ordered, lambda g, i: F.concat(
            g, F.lit("\u0001"), (i - F.array_position(ordered, g)).cast("string"))))

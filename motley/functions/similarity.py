"""Similarity of two values as Column expressions, kept inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from motley.functions.binding import let
from motley.functions.grams import numbered, padded, preprocess, windows


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """(|a| + |b| - distance) / (|a| + |b|); two empty strings give 1."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise((total - F.levenshtein(a, b)) / total)


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _jaro_of(ca: Column, cb: Column, reach: Column, floor: bool) -> Column:
    """Jaro of two non-empty character arrays."""
    la, lb = F.size(ca), F.size(cb)

    def take(state, i):
        lo, hi = F.greatest(i - reach, F.lit(1)), F.least(i + reach, lb)
        span = F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(_empty("int"))
        equal = lambda j: (F.element_at(cb, j) == F.element_at(ca, i)) & ~F.array_contains(state["used"], j)
        return let(F.slice(F.filter(span, equal), 1, 1), lambda hit: F.struct(
            F.concat(state["used"], hit).alias("used"),
            F.concat(state["seen"], F.when(F.size(hit) > 0, F.array(F.element_at(ca, i))).otherwise(
                _empty("string"))).alias("seen")))

    def score(s):
        m = F.size(s["used"]).cast("double")
        other = F.transform(F.array_sort(s["used"]), lambda j: F.element_at(cb, j))
        moved = F.size(F.filter(F.zip_with(s["seen"], other, lambda x, y: x != y), lambda z: z)) / F.lit(2.0)
        if floor:
            moved = F.floor(moved).cast("double")
        return F.when(m == 0, F.lit(0.0)).otherwise((m / la + m / lb + (m - moved) / m) / 3)

    start = F.struct(_empty("int").alias("used"), _empty("string").alias("seen"))
    return let(F.aggregate(F.sequence(F.lit(1), la), start, take), score)


def jaro(a: Column, b: Column, transpositions: str = "half") -> Column:
    """Jaro similarity.

    ``transpositions='half'`` keeps half a transposition, ``'floor'`` drops it.
    A fold over the characters of ``a`` carries the positions of ``b`` used so
    far; each character takes the first free equal one inside the window.
    """
    la, lb = F.length(a), F.length(b)
    reach = F.greatest(F.floor(F.greatest(la, lb) / 2).cast("int") - 1, F.lit(0))
    parts = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"), reach.alias("reach"))
    value = let(parts, lambda p: _jaro_of(p["a"], p["b"], p["reach"], transpositions == "floor"))
    return F.when((la == 0) | (lb == 0), F.lit(0.0)).otherwise(value)


def jaro_winkler(a: Column, b: Column, transpositions: str = "half") -> Column:
    """Jaro raised by 0.1 per equal leading character (4 at most).

    Raised only above 0.7 and when both strings are longer than 3.
    """
    same = [F.substring(a, 1, k) == F.substring(b, 1, k) for k in range(1, 5)]
    prefix = sum(s.cast("int") for s in same)
    tall = (F.length(a) > 3) & (F.length(b) > 3)
    return let(jaro(a, b, transpositions), lambda w: F.when(
        (w > 0.7) & tall, w + prefix * 0.1 * (1.0 - w)).otherwise(w))


def multiset_jaccard(x: Column, y: Column) -> Column:
    """Sum of minima over (|x| + |y| - sum of minima) for two gram arrays."""
    common = F.size(F.array_intersect(numbered(x), numbered(y)))
    total = F.size(x) + F.size(y) - common
    return F.when(total == 0, F.lit(0.0)).otherwise(common / F.greatest(total, F.lit(1)))


def ngram_similarity(a: Column, b: Column, n: int = 3) -> Column:
    return multiset_jaccard(windows(padded(preprocess(a)), n), windows(padded(preprocess(b)), n))


def cosine_similarity(u: Column, v: Column) -> Column:
    """Cosine of two arrays; 0 when one of them has length 0."""
    dot = lambda p, q: F.aggregate(
        F.zip_with(p, q, lambda s, t: s.cast("double") * t.cast("double")),
        F.lit(0.0), lambda acc, z: acc + z,
    )
    scale = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.coalesce(F.try_divide(dot(u, v), scale), F.lit(0.0))


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "levenshtein": levenshtein,
    "levenshtein-ratio": levenshtein_ratio,
    "jaro": jaro,
    "jaro-winkler": jaro_winkler,
    "ngram": ngram_similarity,
    "cosine": cosine_similarity,
}

"""Candidates for edit and Jaro similarities from selective keys, so that no near cross product is made.

Edits: of two strings at most k edits apart, cut the first into k + 1 segments; an edit touches
one segment, so one of them stands whole in the second string, close to where it stood. The
first side is indexed by (length, other length, segment number, segment text), the second
looks up its substrings around each segment's place, and the two meet in an equi-join.

Jaro: strings that are alike enough have a share of their characters in common. With the
characters of every string (numbered, so that repeats differ) in one order, rarest first, two
strings with t in common share at least l of the first size - t + l, so some l of them
together. Keys are these groups of l characters, with the leading characters that the prefix
bonus needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motley.functions.binding import let
from motley.operators.dictionary import spread

SAME = "\u0001"
NAMED = 256  # characters told apart by how common they are; all others come first
GROUPS = {0: 3, 1: 3, 2: 2, 3: 2, 4: 2}  # characters in a key, by the leading characters beside them
WHOLE = 0.8  # ratio from which segments have two characters or more


def _segments(length: Column, parts: Column, body) -> Column:
    """``body(number from 0, start from 1, size)`` of the even cuts of a string; larger ones come last."""
    short = F.floor(length / parts)
    longer = length - short * parts  # so many of the last ones have one character more
    before = lambda i: short * i + F.greatest(i - (parts - longer), F.lit(0))
    return F.transform(F.sequence(F.lit(0).cast("long"), parts - 1),
                       lambda i: body(i, before(i) + 1, before(i + 1) - before(i)))


def _key(one: Column, other: Column, number: Column, text: Column) -> Column:
    return F.xxhash64(one.cast("long"), other.cast("long"), number.cast("long"), text)


def _lengths(length: Column, bounds, body) -> Column:
    """``body(other length)`` over all lengths a partner may have; empty if there are none."""
    low, high = bounds(length)
    return F.when(low <= high, F.flatten(F.transform(F.sequence(low, F.greatest(low, high)), body))).otherwise(
        F.array().cast("array<bigint>"))


def _indexed(value: Column, edits, bounds) -> Column:
    """Keys of the segments of a value, for every length of a partner."""
    length = F.length(value).cast("long")

    def of(other):
        return let(edits(length, other), lambda k: _segments(
            length, k + 1, lambda i, start, size: _key(length, other, i, F.substr(value, start.cast("int"), size.cast("int")))))

    return _lengths(length, bounds, of)


def _probed(value: Column, edits, bounds) -> Column:
    """Keys of the substrings where a segment of a partner of each length may have moved to.

    Before segment i at most i edits happened, or else an earlier segment is whole; after it at
    most k - i, or else a later one is. Both bound how far it moved.
    """
    length = F.length(value).cast("long")

    def of(other):
        shift = length - other

        def near(k):
            def places(i, start, size):
                low = F.greatest(start - i, start + shift - (k - i), F.lit(1))
                high = F.least(start + i, start + shift + (k - i), length - size + 1)
                return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda at: _key(
                    other, length, i, F.substr(value, at.cast("int"), size.cast("int"))))).otherwise(F.array().cast("array<bigint>"))

            return F.flatten(_segments(other, k + 1, places))

        return let(edits(length, other), near)

    return F.array_distinct(_lengths(length, bounds, of))


def _met(left: DataFrame, right: DataFrame, lcol: str, rcol: str, lkeys: Column, rkeys: Column) -> DataFrame:
    # outer: an inner explode would compute the keys twice, once as a filter
    one = spread(left, lcol).select(lcol, F.explode_outer(lkeys).alias("_key"))
    two = spread(right, rcol).select(rcol, F.explode_outer(rkeys).alias("_key"))
    return one.join(two, "_key").select(lcol, rcol).distinct()


def _within(k: int):
    """Edits and lengths for a fixed distance; strings shorter than the number of segments are cut into characters."""
    edits = lambda one, other: F.lit(k).cast("long")
    bounds = lambda length: (F.greatest(length - k, F.lit(0)), length + k)
    return edits, bounds


def _by_ratio(min_score: float):
    """Edits and lengths for (sum of lengths - distance) / sum of lengths >= ``min_score``."""
    room, slack = 1 - min_score, 1e-9
    edits = lambda one, other: F.floor((one + other) * room + slack).cast("long")
    bounds = lambda n: (F.ceil(n * min_score / (2 - min_score) - slack).cast("long"),
                        F.floor(n * (2 - min_score) / min_score + slack).cast("long"))
    return edits, bounds


def edit_candidates(left: DataFrame, right: DataFrame, lcol: str, rcol: str, max_edits: int | None = None,
                    min_ratio: float | None = None) -> DataFrame:
    """Distinct pairs that may be within ``max_edits`` edits or reach the ratio; none is missed.

    A ratio must be above 2/3, as a segment would have no character otherwise. The keys of a
    string grow with the square of the edits it may have, so this is for names and titles.
    """
    if min_ratio is not None and min_ratio <= 2 / 3:
        raise ValueError(f"a ratio of {min_ratio} leaves no whole segment of a string")
    edits, bounds = _within(max_edits) if min_ratio is None else _by_ratio(min_ratio)
    return _met(left, right, lcol, rcol, _indexed(F.col(lcol), edits, bounds), _probed(F.col(rcol), edits, bounds))


def edit_join(left: DataFrame, right: DataFrame, lcol: str, rcol: str, max_edits: int) -> DataFrame:
    """(left value, right value, distance) of all pairs of distinct values at most ``max_edits`` edits apart.

    Null values take no part. Segments of strings with no more characters than edits are partly
    empty, and such strings meet all of their length, which are indeed within reach.
    """
    if lcol == rcol:
        raise ValueError("name the two columns differently")
    near = edit_candidates(left, right, lcol, rcol, max_edits)
    # with a threshold the distance is -1 beyond it
    return near.withColumn("distance", F.levenshtein(lcol, rcol, max_edits)).where("distance >= 0")


def _tokens(df: DataFrame, value: str) -> DataFrame:
    """(value, size, tokens) with the numbered characters of each distinct value that has any."""
    chars = F.array_sort(F.split(F.col(value), ""))
    tagged = let(chars, lambda ch: F.transform(ch, lambda c, i: F.concat(
        c, F.lit(SAME), (i - F.array_position(ch, c)).cast("string"))))
    return spread(df, value).where(F.length(value) > 0).select(value, F.length(value).alias("size"), tagged.alias("tokens"))


def _commonness(left: DataFrame, right: DataFrame) -> Column:
    """Ranks of the ``NAMED`` commonest tokens as a literal map, the commonest last."""
    both = left.select(F.explode("tokens").alias("t")).unionByName(right.select(F.explode("tokens").alias("t")))
    found = both.groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").limit(NAMED).collect()
    pairs = [(r["t"], len(found) - i) for i, r in enumerate(found)] or [("", 0)]
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def _choices(tokens: Column, size: int) -> Column:
    """Hashes of all groups of ``size`` of the sorted tokens."""
    groups = F.transform(tokens, lambda t: F.struct(t.alias("last"), F.xxhash64(t).alias("h")))
    for _ in range(size - 1):
        groups = F.flatten(F.transform(groups, lambda g: F.transform(
            F.filter(tokens, lambda t: t > g["last"]), lambda t: F.struct(t.alias("last"), F.xxhash64(g["h"], t).alias("h")))))
    return F.transform(groups, lambda g: g["h"])


def _group_keys(value: str, ordered: Column, share: float, lead: int) -> Column:
    """Keys of one value: groups among the first of its characters, with its first ``lead`` ones."""
    size, group, prefix = F.col("size"), GROUPS[lead], F.substring(value, 1, lead)
    needed = F.greatest(F.ceil(size * share - 1e-9).cast("int"), F.lit(1))

    def keys(n):
        first = F.array_sort(F.slice(ordered, 1, F.least(size, size - needed + n)))
        return F.transform(let(first, lambda f: _choices(f, n)), lambda h: F.struct(
            F.xxhash64(F.lit(n), F.lit(lead), prefix, h).alias("key"), F.lit(share).alias("share")))

    none = F.array().cast("array<struct<key:bigint,share:double>>")
    # two values with fewer characters in common than a group has need few on both sides
    return F.concat(F.when(size >= group, keys(group)).otherwise(none), F.when(needed < group, keys(1)).otherwise(none))


def common_candidates(left: DataFrame, right: DataFrame, lcol: str, rcol: str, shares: dict[int, float]) -> DataFrame:
    """Distinct pairs that may have a share of their characters in common, repeats included; none is missed.

    ``shares`` has the share for pairs with so many equal leading characters, which become
    part of the key; 0 stands for any pair. The keys of a string grow with the power of a
    group's characters, so this too is for names and titles.
    """
    one, two = _tokens(left, lcol), _tokens(right, rcol)
    ranks = _commonness(one, two)

    def keyed(tokens, value):
        ordered = F.transform(F.array_sort(F.transform("tokens", lambda t: F.struct(
            F.coalesce(F.try_element_at(ranks, t), F.lit(0)).alias("rank"), t.alias("t")))), lambda s: s["t"])
        keys = let(ordered, lambda o: F.concat(*(_group_keys(value, o, share, lead) for lead, share in shares.items())))
        rows = tokens.select(value, F.col("size").alias(f"_{value}"), F.explode_outer(F.array_distinct(keys)).alias("_k"))
        return rows.select(value, f"_{value}", "_k.key", "_k.share")

    sizes = F.col(f"_{lcol}"), F.col(f"_{rcol}")
    fits = F.least(*sizes) >= F.greatest(*sizes) * F.col("share") - 1e-9
    return keyed(one, lcol).join(keyed(two, rcol).drop("share"), "key").where(fits).select(lcol, rcol).distinct()


def shares_needed(metric: str, min_score: float) -> dict[int, float]:
    """Share of either string's characters that is in common, by the number of equal leading characters.

    A Jaro score j needs 3 j - 2. The Winkler bonus for p equal leading characters lowers the j
    that is needed to (score - p / 10) / (1 - p / 10). For the edit ratio it is 2 r - 1, as an
    edit beyond the difference of lengths leaves one character less in common.
    """
    if metric == "levenshtein-ratio":
        shares = {0: 2 * min_score - 1}
    else:
        shares = {p: 3 * (min_score - p / 10) / (1 - p / 10) - 2 for p in (range(5) if metric == "jaro-winkler" else [0])}
    if min(shares.values()) <= 0:
        raise ValueError(f"{metric} >= {min_score} does not bound the common characters: give block_on")
    return shares


def string_candidates(left: DataFrame, right: DataFrame, lcol: str, rcol: str, metric: str, min_score: float) -> DataFrame:
    """Pairs of distinct values that may reach a score, from segments where they are long enough, else from common characters."""
    if metric == "levenshtein-ratio" and min_score >= WHOLE:
        return edit_candidates(left, right, lcol, rcol, min_ratio=min_score)
    return common_candidates(left, right, lcol, rcol, shares_needed(metric, min_score))

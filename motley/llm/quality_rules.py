"""Quality rules: a threshold table compiled into one Spark projection.

Every rule bounds a ratio of two counts of the text, in per cent. The table becomes a
single expression of built-in functions: one pass over a row, no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motley.llm.common import BLANK_CLASS, has_word, let, temporary, whole, words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = [
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "have", "in", "is", "it", "not", "of", "on", "or",
    "that", "the", "this", "to", "was", "with",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sich", "und",
    "von", "zu",
    "au", "aux", "dans", "de", "du", "elle", "en", "et", "il", "la", "le", "les", "pas", "pour", "que", "qui",
    "sur", "un", "une",
    "al", "con", "del", "el", "las", "lo", "los", "no", "para", "por", "se", "su", "una", "y",
]

STOP_FORMS = STOP_WORDS + [w.capitalize() for w in STOP_WORDS]


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low`` <= 100 * count / per <= ``high``; a bound of None is open."""

    name: str
    count: str
    per: str
    low: int | None = None
    high: int | None = None

    def passes(self, m: Column) -> Column:
        scaled, ok = m[self.count] * 100, F.lit(True)
        if self.low is not None:
            ok = ok & (scaled >= m[self.per] * self.low)
        if self.high is not None:
            ok = ok & (scaled <= m[self.per] * self.high)
        return ok


# ``one`` is the constant 1, so 5 000 per cent of it is 50.
BASE = (
    Rule("too_few_words", "n_words", "one", low=5_000),
    Rule("repeated_words", "n_repeat_words", "n_words", high=50),
)
METHOD = (
    Rule("word_length", "word_chars", "n_words", low=150, high=1_500),
    Rule("symbols", "n_symbols", "n_words", high=20),
    Rule("stop_words", "n_stop_words", "n_words", low=2),
    Rule("marked_words", "n_marked_words", "n_words", high=30),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=50),
    Rule("table_lines", "n_table_lines", "n_lines", high=50),
)


def _covered(starts: Column) -> Column:
    """Positions that lie in a window of three beginning at one of the ascending starts."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(
        starts, zero,
        lambda acc, s: F.struct((acc["n"] + F.least(F.lit(3), s - acc["last"])).cast("long").alias("n"),
                                s.alias("last")),
        lambda acc: acc["n"])


def _repeated(w: Column) -> Column:
    """Words in three-word windows that stand twice or more, the first time included.

    A text whose windows all hash differently is done at once. Else the windows are sorted
    by hash, so equal ones are neighbours, and neighbours are compared word by word.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                         lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def same(a, b):
        return ((a["h"] == b["h"]) & (F.get(w, a["i"]) == F.get(w, b["i"]))
                & (F.get(w, a["i"] + 1) == F.get(w, b["i"] + 1)) & (F.get(w, a["i"] + 2) == F.get(w, b["i"] + 2)))

    def starts(ordered):
        twice = F.filter(ordered, lambda x, k: F.coalesce(same(x, F.get(ordered, k - 1)), F.lit(False))
                         | F.coalesce(same(x, F.get(ordered, k + 1)), F.lit(False)))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def counted(hs):
        ordered = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return (F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long"))
                .otherwise(let(ordered, lambda o: _covered(starts(o)))))

    return F.when(F.size(w) >= 3, let(hashes, counted)).otherwise(F.lit(0).cast("long"))


def _count(n: Column, name: str) -> Column:
    return n.cast("long").alias(name)


def measures(text: Column) -> Column:
    """Struct of the counts the rules use; a null text counts as empty."""
    def of(t, w, lines):
        stop = F.filter(w, lambda x: x.isin(STOP_FORMS))
        return F.struct(
            _count(F.size(w), "n_words"), _count(F.length(F.array_join(w, "")), "word_chars"),
            _count(F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")), "n_symbols"),
            _count(F.size(lines) - F.size(F.array_distinct(lines)), "n_dup_lines"),
            _count(_repeated(w), "n_repeat_words"), _count(F.size(lines), "n_lines"),
            _count(F.size(stop), "n_stop_words"),
            _count(F.regexp_count(t, F.lit(rf"[#*$%&|<>!](?=[{BLANK_CLASS}]|\z)")), "n_marked_words"),
            _count(F.size(F.filter(lines, lambda x: x.contains("|"))), "n_table_lines"), _count(F.lit(1), "one"))

    return let(whole(text), lambda t: let(words(t), lambda w: let(
        F.filter(F.split(t, "\n"), has_word), lambda lines: of(t, w, lines))))


def judged(text: Column, base=BASE, method=METHOD) -> Column:
    """Struct of the counts, ``base_failed``, ``kept`` and ``failed``, the names of the rules that failed."""
    def of(m):
        names = F.array_compact(F.array(*(F.when(~r.passes(m), F.lit(r.name)) for r in (*base, *method))))
        failed = F.lit(False)
        for r in base:
            failed = failed | ~r.passes(m)
        counts = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                          "n_lines", "n_stop_words", "n_marked_words", "n_table_lines")]
        return F.struct(*counts, failed.alias("base_failed"), (F.size(names) == 0).alias("kept"),
                        names.alias("failed"))

    return let(measures(text), of)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, method=METHOD) -> DataFrame:
    """One row per input row: the id, the counts, ``base_failed``, ``kept`` and ``failed``.

    A null or empty text has no words and fails the length rule; repeated rows are judged one
    by one; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    judgement = docs.select(docs[id_col].alias(id_col), judged(docs[text_col], base, method).alias("_j"))
    return judgement.select(id_col, "_j.*")


def keep_good(docs: DataFrame, text_col: str = "text", base=BASE, method=METHOD) -> DataFrame:
    """The rows whose text passes every rule, with all their columns unchanged."""
    flag = temporary(docs.columns, "_kept")
    return docs.withColumn(flag, judged(docs[text_col], base, method)["kept"]).where(F.col(flag)).drop(flag)


def _sql_rule(rule: Rule) -> str:
    parts = []
    if rule.low is not None:
        parts.append(f"100 * {rule.count} >= {rule.low} * {rule.per}")
    if rule.high is not None:
        parts.append(f"100 * {rule.count} <= {rule.high} * {rule.per}")
    return " AND ".join(parts)


def oracle() -> str:
    """The same counts and verdicts in DuckDB SQL over the table ``documents``."""
    blank = r"[\x20\x09-\x0D]+"
    stop = ", ".join(f"'{w}'" for w in STOP_FORMS)
    base, method = (" AND ".join(f"({_sql_rule(r)})" for r in rules) for rules in (BASE, METHOD))
    return rf"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '{blank}'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM
    (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM cut WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
counts AS (SELECT c.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(list_filter(w, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words,
    CAST(len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>!]$'))) AS BIGINT) AS n_marked_words,
    CAST(len(list_filter(lines, lambda x: contains(x, '|'))) AS BIGINT) AS n_table_lines, 1 AS one
  FROM cut c LEFT JOIN repeats USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, n_marked_words,
  n_table_lines, NOT ({base}) AS base_failed, ({base}) AND ({method}) AS kept FROM counts"""

"""Shared pieces of oracle SQL."""

from __future__ import annotations

import string

_PUNCT = string.punctuation.replace("'", "''")


def clean(x: str) -> str:
    return (f"regexp_replace(translate(lower({x}), '{_PUNCT}', repeat(' ', {len(string.punctuation)})), "
            r"'\s\s+', ' ', 'g')")


RAW = """CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name)
  WHEN 2 THEN split_part(p_name,' ',2) || ' ' || split_part(p_name,' ',1)
  WHEN 3 THEN '9109 ' || p_name
  ELSE split_part(p_name,' ',1) || ', ' || split_part(p_name,' ',2) END"""

TITLES = f"""titles AS (SELECT p_partkey, {RAW} AS job_title, {clean(RAW)} AS title,
  least(split_part(p_name,' ',1), split_part(p_name,' ',2)) || ' ' ||
  greatest(split_part(p_name,' ',1), split_part(p_name,' ',2)) AS matched_title,
  p_name || ' ' || replace(lower(p_brand), '#', '') AS fine_title FROM part)"""

PEOPLE = f"""{TITLES}, people AS (SELECT (l_orderkey * 8 + l_linenumber) * 1000000 +
  (CAST(round(l_extendedprice * 100) AS BIGINT) + l_partkey * 7919) % 1000000 AS row_id,
  round(l_extendedprice) AS salary, l_returnflag AS employer,
  t.job_title, t.title, t.matched_title, t.fine_title,
  CAST(s_nationkey % 14 AS INTEGER) AS table_id,
  CAST(2019 - year(o_orderdate) AS INTEGER) AS seniority,
  CAST(o_orderstatus = 'F' AS INTEGER) AS gender, c_mktsegment AS ethnicity
  FROM lineitem JOIN titles t ON l_partkey = t.p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey)"""

# word -> unit vector, and the mean vector of a title's words
WORD_VECTORS = """words AS (SELECT word, min(p_partkey) % (SELECT count(*) FROM embeddings) AS vec_id FROM (
    SELECT p_partkey, unnest(list_concat(string_split(title, ' '), string_split(fine_title, ' '))) AS word
    FROM titles) GROUP BY word),
  unit AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM
    (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)),
  word_vectors AS (SELECT word, v FROM words JOIN unit USING (vec_id))"""


def title_vectors(column: str, source: str = "titles") -> str:
    """CTE title_vectors(title, v) over the distinct values of a column."""
    return f"""{WORD_VECTORS},
  title_words AS (SELECT title, unnest(string_split(title, ' ')) AS word FROM
    (SELECT DISTINCT {column} AS title FROM {source})),
  title_dims AS (SELECT title, i, avg(x) AS x FROM (SELECT title, unnest(v) AS x,
    unnest(range(1, len(v) + 1)) AS i FROM title_words JOIN word_vectors USING (word)) GROUP BY title, i),
  title_vectors AS (SELECT title, list(x ORDER BY i) AS v FROM title_dims GROUP BY title)"""


def similar(threshold: float, column: str) -> str:
    """CTE near_titles(title, other, cos) of ordered pairs above the threshold."""
    return f"""{title_vectors(column)},
  near_titles AS (SELECT a.title, b.title AS other, list_cosine_similarity(a.v, b.v) AS cos
    FROM title_vectors a, title_vectors b WHERE list_cosine_similarity(a.v, b.v) > {threshold})"""


def kernel(threshold: float) -> str:
    a, b = 1 / (1 - threshold), -threshold / (1 - threshold)
    return f"greatest({a!r} * cos + ({b!r}), 0)"

"""String similarity queries on the distinct pairs of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql as Q
from catalog.registry import query
from motley.functions import grams
from motley.operators import edit_join as ed
from motley.operators import pairs
from motley.sources.people import table, titles, word_vectors

# every part's raw spelling beside its name; scored once per distinct pair
_PAIRS = f"SELECT p_partkey, {Q.RAW} AS a, p_name AS b FROM part"


def part_pairs(spark, sf):
    return titles(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey").select(
        "p_partkey", F.col("job_title").alias("a"), F.col("p_name").alias("b"))


def scored(spark, sf, metric, **options):
    out = pairs.pair_similarity(part_pairs(spark, sf), "a", "b", metric, **options)
    return out.select("p_partkey", "a", "b", "score")


@query("levenshtein", f"SELECT p_partkey, a, b, CAST(levenshtein(a, b) AS INTEGER) AS score FROM ({_PAIRS})")
def levenshtein(spark, sf):
    return scored(spark, sf, "levenshtein")


@query("levenshtein_ratio", f"""SELECT p_partkey, a, b,
  (length(a) + length(b) - levenshtein(a, b)) / (length(a) + length(b)) AS score FROM ({_PAIRS})""")
def levenshtein_ratio(spark, sf):
    return scored(spark, sf, "levenshtein-ratio")


@query("jaro", f"SELECT p_partkey, a, b, round(jaro_similarity(a, b), 9) AS score FROM ({_PAIRS})")
def jaro(spark, sf):
    return scored(spark, sf, "jaro", transpositions="floor").withColumn("score", F.round("score", 9))


_PREFIX = "(" + " + ".join(f"CAST(left(a, {k}) = left(b, {k}) AS INTEGER)" for k in range(1, 5)) + ")"


@query("jaro_winkler", f"""SELECT p_partkey, a, b, round(CASE WHEN w > 0.7 AND length(a) > 3 AND length(b) > 3
  THEN w + {_PREFIX} * 0.1 * (1 - w) ELSE w END, 9) AS score FROM (SELECT *, jaro_similarity(a, b) AS w FROM ({_PAIRS}))""")
def jaro_winkler(spark, sf):
    return scored(spark, sf, "jaro-winkler", transpositions="floor").withColumn("score", F.round("score", 9))


_PADDED = r"' ' || trim(regexp_replace(lower({x}), '\s+', ' ', 'g')) || ' '"



def _grams(s: str, n: int) -> str:
    return f"list_transform(range(1, greatest(length({s}) - {n - 2}, 1)), lambda i: substr({s}, i, {n}))"


@query("ngram_list", f"""SELECT title, unnest(range(1, len(g) + 1)) AS pos, unnest(g) AS gram FROM (
  SELECT title, {_grams('s', 3)} AS g FROM (SELECT DISTINCT p_name AS title, {_PADDED.format(x='p_name')} AS s FROM part))""")
def ngram_list(spark, sf):
    return table(spark, sf, "part").select(F.col("p_name").alias("title")).distinct().select(
        "title", F.posexplode(grams.ngram_list(F.col("title"), 3)).alias("pos", "gram")).select(
        "title", (F.col("pos") + 1).cast("bigint").alias("pos"), "gram")


@query("ngram_set", f"""SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest({_grams('s', 2)}) AS gram FROM (
  SELECT doc_id, {_PADDED.format(x='text')} AS s FROM documents))""")
def ngram_set(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.explode_outer(grams.ngram_set(F.col("text"), 2)).alias("gram"))


@query("ngram_count", "SELECT doc_id, CAST(3 * length(text) - 6 AS INTEGER) AS n FROM documents")
def ngram_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", grams.ngram_count(F.col("text"), 2, 4).alias("n"))


@query("ngram_preprocess", r"""SELECT doc_id, md5(regexp_replace(' ' || text || ' ', '\s\s+', ' ', 'g')) AS digest
  FROM documents""")
def ngram_preprocess(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(grams.preprocess(F.col("text"))).alias("digest"))


_COUNTS = f"""SELECT {{k}}, gram, count(*) AS c FROM (SELECT {{k}}, unnest({_grams('s', 3)}) AS gram FROM
  (SELECT DISTINCT {{k}}, {_PADDED.format(x='{k}')} AS s FROM p)) GROUP BY ALL"""


@query("ngram_similarity", f"""WITH p AS ({_PAIRS}), ca AS ({_COUNTS.format(k='a')}), cb AS ({_COUNTS.format(k='b')}),
  na AS (SELECT a, sum(c) AS n FROM ca GROUP BY a), nb AS (SELECT b, sum(c) AS n FROM cb GROUP BY b),
  m AS (SELECT q.a, q.b, sum(least(ca.c, cb.c)) AS same FROM (SELECT DISTINCT a, b FROM p) q
        JOIN ca ON q.a = ca.a JOIN cb ON q.b = cb.b AND ca.gram = cb.gram GROUP BY ALL)
  SELECT p_partkey, p.a, p.b, coalesce(same, 0) / CAST(na.n + nb.n - coalesce(same, 0) AS DOUBLE) AS score FROM p
  JOIN na ON p.a = na.a JOIN nb ON p.b = nb.b LEFT JOIN m ON p.a = m.a AND p.b = m.b""")
def ngram_similarity(spark, sf):
    return scored(spark, sf, "ngram", n=3)


_PAD2 = "'  ' || text || '  '"


@query("trigrams", f"""SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, unnest({_grams('s', 3)}) AS gram FROM
  (SELECT doc_id, {_PAD2} AS s FROM documents)) GROUP BY ALL""")
def trigrams(spark, sf):
    return pairs.trigram_counts(table(spark, sf, "documents"), "doc_id", "text")


@query("trigram_set", f"""SELECT doc_id, count(DISTINCT gram) AS n FROM (SELECT doc_id, unnest({_grams('s', 3)}) AS gram FROM
  (SELECT doc_id, {_PAD2} AS s FROM documents)) GROUP BY ALL""")
def trigram_set(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.size(grams.trigram_set(F.col("text"))).cast("bigint").alias("n"))


@query("trigram_count", f"""SELECT p_partkey, count(DISTINCT gram) AS n FROM (SELECT p_partkey, unnest({_grams('s', 3)}) AS gram
  FROM (SELECT p_partkey, {Q.RAW} AS s FROM part)) GROUP BY ALL""")
def trigram_count(spark, sf):
    return titles(spark, sf).select("p_partkey", grams.trigram_count(F.col("job_title")).cast("bigint").alias("n"))


@query("trigram_common", f"""SELECT p_partkey, CAST(len(list_intersect({_grams('a', 3)}, {_grams('b', 3)})) AS INTEGER) AS n
  FROM ({_PAIRS})""")
def trigram_common(spark, sf):
    return part_pairs(spark, sf).select("p_partkey", grams.trigram_common(F.col("a"), F.col("b")).alias("n"))


@query("cosine_similarity", """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]),
  CAST(b.embedding AS DOUBLE[])), 9) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark, sf):
    e = table(spark, sf, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    both = e.join(after, "vec_id").select("vec_id", "embedding", "next")
    return pairs.pair_similarity(both, "embedding", "next", "cosine").select("vec_id", F.round("score", 9).alias("score"))


@query("similarity_join", f"""SELECT a, b, (length(a) + length(b) - levenshtein(a, b)) / (length(a) + length(b)) AS score
  FROM (SELECT DISTINCT {Q.RAW} AS a FROM part), (SELECT DISTINCT p_name || ' ' || replace(lower(p_brand), '#', '') AS b FROM part)
  WHERE (length(a) + length(b) - levenshtein(a, b)) / (length(a) + length(b)) >= 0.7""")
def similarity_join(spark, sf):
    t = titles(spark, sf)
    return pairs.similarity_join(t.select(F.col("job_title").alias("a")), t.select(F.col("fine_title").alias("b")),
                                 "a", "b", "levenshtein-ratio", 0.7)


@query("similarity_join_ngram", f"""WITH p AS (SELECT {Q.RAW} AS a, p_name || ' ' || replace(lower(p_brand), '#', '') AS b FROM part),
  ca AS ({_COUNTS.format(k='a')}), cb AS ({_COUNTS.format(k='b')}),
  na AS (SELECT a, sum(c) AS n FROM ca GROUP BY a), nb AS (SELECT b, sum(c) AS n FROM cb GROUP BY b),
  m AS (SELECT a, b, sum(least(ca.c, cb.c)) AS same FROM ca JOIN cb USING (gram) GROUP BY a, b)
  SELECT a, b, same / CAST(na.n + nb.n - same AS DOUBLE) AS score FROM m JOIN na USING (a) JOIN nb USING (b)
  WHERE same / CAST(na.n + nb.n - same AS DOUBLE) >= 0.5""")
def similarity_join_ngram(spark, sf):
    t = titles(spark, sf)
    return pairs.similarity_join(t.select(F.col("job_title").alias("a")), t.select(F.col("fine_title").alias("b")),
                                 "a", "b", "ngram", 0.5)


_FINE = f"SELECT DISTINCT {Q.RAW} AS a FROM part), (SELECT DISTINCT p_name || ' ' || replace(lower(p_brand), '#', '') AS b FROM part"


@query("similarity_join_edit", f"""SELECT a, b, (length(a) + length(b) - levenshtein(a, b)) / (length(a) + length(b)) AS score
  FROM (SELECT DISTINCT p_name || ' ' || replace(lower(p_brand), '#', '') AS a FROM part),
    (SELECT DISTINCT lower({Q.RAW}) || ' ' || replace(lower(p_brand), '#', '') AS b FROM part)
  WHERE (length(a) + length(b) - levenshtein(a, b)) / (length(a) + length(b)) >= 0.9""")
def similarity_join_edit(spark, sf):
    """Titles with their brand against other spellings of them, by segments that edits leave whole."""
    a, b = _branded(spark, sf)
    return pairs.similarity_join(a, b, "a", "b", "levenshtein-ratio", 0.9)


def _branded(spark, sf):
    brand = table(spark, sf, "part").select("p_partkey", F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")).alias("brand"))
    t = titles(spark, sf).join(brand, "p_partkey")
    return t.select(F.col("fine_title").alias("a")), t.select(F.concat_ws(" ", F.lower("job_title"), "brand").alias("b"))


@query("edit_join", f"""SELECT a, b, CAST(levenshtein(a, b) AS INTEGER) AS distance
  FROM (SELECT DISTINCT p_name || ' ' || replace(lower(p_brand), '#', '') AS a FROM part),
    (SELECT DISTINCT lower({Q.RAW}) || ' ' || replace(lower(p_brand), '#', '') AS b FROM part) WHERE levenshtein(a, b) <= 2""")
def edit_join(spark, sf):
    a, b = _branded(spark, sf)
    return ed.edit_join(a, b, "a", "b", 2)


@query("similarity_join_jaro_winkler", f"""SELECT a, b, round(score, 9) AS score FROM (SELECT a, b, CASE WHEN w > 0.7 AND length(a) > 3 AND length(b) > 3
    THEN w + {_PREFIX} * 0.1 * (1 - w) ELSE w END AS score FROM (SELECT *, jaro_similarity(a, b) AS w FROM ({_FINE}))) WHERE score >= 0.9""")
def similarity_join_jaro_winkler(spark, sf):
    """Raw titles against branded ones, by groups of common characters."""
    t = titles(spark, sf)
    out = pairs.similarity_join(t.select(F.col("job_title").alias("a")), t.select(F.col("fine_title").alias("b")), "a", "b",
                                "jaro-winkler", 0.9, transpositions="floor")
    return out.withColumn("score", F.round("score", 9))

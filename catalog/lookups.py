"""Fallback lookups, variants, kernel joins and nearest neighbours."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from catalog import sql as Q
from catalog.registry import query
from motley.operators import dictionary as dic
from motley.operators import lookups as look
from motley.operators import subwords as sub
from motley.operators import vector_join as vec
from motley.sources.people import people, table, titles, word_vectors
from motley.workdir import materialize

P = f"WITH {Q.PEOPLE}"
T = 0.6  # shares two of three words, on the test titles


def title_vectors(spark, sf, column):
    return vec.embed_titles(titles(spark, sf), column, word_vectors(spark, sf))


def similar_titles(spark, sf, column, threshold=T):
    """(title, other, cos) over the distinct titles, written once."""
    pairs = vec.similar_pairs(title_vectors(spark, sf, column), column, "vector", threshold)
    return materialize(pairs.withColumnRenamed(column, "title"), "similar")


def fine(spark, sf, *columns):
    """People with the finer title under the name ``title``."""
    return people(spark, sf, "fine_title", *columns).withColumnRenamed("fine_title", "title")


_GRAINS = """train AS (SELECT fine_title AS title, seniority, salary FROM people WHERE table_id < 7),
  fine AS (SELECT title, seniority, avg(salary) AS e, count(*) AS n FROM train GROUP BY ALL),
  byexp AS (SELECT seniority, avg(salary) AS e FROM train GROUP BY ALL),
  asked AS (SELECT DISTINCT fine_title AS title, seniority FROM people WHERE table_id >= 7)"""
_FALLBACK = """SELECT title, seniority, coalesce(fine.e, byexp.e, (SELECT avg(salary) FROM train)) AS estimate,
  CAST(fine.e IS NOT NULL AS INTEGER) AS matched FROM asked LEFT JOIN fine USING (title, seniority)
  LEFT JOIN byexp USING (seniority)"""


def _train_and_asked(spark, sf):
    p = fine(spark, sf, "seniority", "salary", "table_id")
    return p.where("table_id < 7"), p.where("table_id >= 7").select("title", "seniority").distinct()


@query("estimate_lookup", f"{P}, {_GRAINS} {_FALLBACK}")
def estimate_lookup(spark, sf):
    train, asked = _train_and_asked(spark, sf)
    grains = look.grain_estimates(train, "title", "seniority", "salary")
    return look.estimate_lookup(asked, grains, "title", "seniority").select("title", "seniority", "estimate", "matched")


_PAIRS = """v AS (SELECT DISTINCT matched_title, seniority, title FROM people),
  known AS (SELECT title, seniority, avg(salary) AS estimate FROM people WHERE table_id IN (1, 4) GROUP BY ALL),
  asked AS (SELECT DISTINCT matched_title, seniority FROM people)"""


@query("variant_lookup", f"""{P}, {_PAIRS}, picked AS (SELECT matched_title, seniority,
  arg_min(estimate, md5(title || '|' || seniority || '|0')) AS estimate FROM v JOIN known USING (title, seniority) GROUP BY ALL)
  SELECT matched_title, seniority, coalesce(estimate, -1) AS estimate FROM asked LEFT JOIN picked USING (matched_title, seniority)""")
def variant_lookup(spark, sf):
    p = people(spark, sf, "matched_title", "title", "seniority", "salary", "table_id")
    pairs = dic.variants(p, ["matched_title", "seniority"], ["title"])
    known = p.where("table_id IN (1, 4)").groupBy("title", "seniority").agg(F.avg("salary").alias("estimate"))
    asked = p.select("matched_title", "seniority").distinct()
    return look.variant_lookup(asked, pairs, known, ["matched_title", "seniority"], ["title", "seniority"]).select(
        "matched_title", "seniority", "estimate")


@query("variant_presence", f"""{P}, {_PAIRS}, here AS (SELECT DISTINCT title, seniority FROM people WHERE table_id = 1 AND employer = 'R'),
  c AS (SELECT matched_title, seniority, count(*) AS n_variants FROM v JOIN here USING (title, seniority) GROUP BY ALL)
  SELECT matched_title, seniority, coalesce(n_variants, 0) AS n_variants FROM asked LEFT JOIN c USING (matched_title, seniority)""")
def variant_presence(spark, sf):
    p = people(spark, sf, "matched_title", "title", "seniority", "table_id", "employer")
    pairs = dic.variants(p, ["matched_title", "seniority"], ["title"])
    return look.variant_presence(
        p.select("matched_title", "seniority").distinct(), pairs, p.where("table_id = 1 AND employer = 'R'"),
        ["matched_title", "seniority"], ["title", "seniority"]).select("matched_title", "seniority", "n_variants")


@query("embed_titles", f"WITH {Q.TITLES}, {Q.title_vectors('title')} SELECT title, unnest(range(1, len(v) + 1)) AS i, "
                       "round(unnest(v), 6) AS x FROM title_vectors")
def embed_titles(spark, sf):
    return title_vectors(spark, sf, "title").select("title", F.posexplode("vector").alias("i", "x")).select(
        "title", (F.col("i") + 1).cast("bigint").alias("i"), F.round("x", 6).alias("x"))


def _cut(source: str) -> str:
    """Distinct n-grams of 3 to 5 characters of marked words."""
    return f"""SELECT DISTINCT word, substr(m, i, k) AS gram FROM (SELECT *, unnest(range(1, length(m) - k + 2)) AS i FROM
    (SELECT word, '<' || word || '>' AS m FROM {source}), (SELECT unnest([3, 4, 5]) AS k) WHERE length(m) >= k)"""


@query("subword_vectors", f"""WITH {Q.TITLES}, {Q.WORD_VECTORS}, pieces AS ({_cut('word_vectors')}),
  dims AS (SELECT gram, i, avg(x) AS x FROM (SELECT gram, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM pieces JOIN word_vectors USING (word))
    GROUP BY gram, i),
  typed AS (SELECT DISTINCT left(word, 1) || substr(word, 3) AS word FROM word_vectors),
  other AS (SELECT word FROM typed WHERE word NOT IN (SELECT word FROM word_vectors)), bits AS ({_cut('other')}),
  made AS (SELECT word, i, avg(x) AS x FROM bits JOIN dims USING (gram) GROUP BY word, i)
  SELECT word, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY word)), 6) AS x FROM made""")
def subword_vectors(spark, sf):
    """Vectors for words typed without their second letter, from the n-grams they share with known words."""
    known = word_vectors(spark, sf)
    typed = known.select(F.concat(F.left("word", F.lit(1)), F.substr("word", F.lit(3))).alias("word"))
    found = sub.vectors_of_words(typed, known, sub.gram_vectors(known)).where("NOT known AND vector IS NOT NULL")
    return found.select("word", F.posexplode("vector").alias("i", "x")).select(
        "word", (F.col("i") + 1).cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@query("similar_titles", f"WITH {Q.TITLES}, {Q.similar(T, 'fine_title')} SELECT title, other, round(cos, 6) AS cos FROM near_titles")
def similar(spark, sf):
    return similar_titles(spark, sf, "fine_title").withColumn("cos", F.round("cos", 6))


@query("similar_titles_blocked", f"WITH {Q.TITLES}, {Q.similar(T, 'fine_title')} SELECT title, other, round(cos, 6) AS cos FROM near_titles")
def similar_blocked(spark, sf):
    """The same join cut into many pivot cells and blocks."""
    vectors = title_vectors(spark, sf, "fine_title")
    pairs = vec.similar_pairs(vectors, "fine_title", "vector", T, block_rows=20, cell_rows=8, lead=6)
    return pairs.select(F.col("fine_title").alias("title"), "other", F.round("cos", 6).alias("cos"))


_KERNEL = f"""k AS (SELECT s.title, f.seniority, sum({Q.kernel(T)} * n * e) / sum({Q.kernel(T)} * n) AS kernel
  FROM near_titles s JOIN fine f ON s.other = f.title WHERE {Q.kernel(T)} > 0 GROUP BY ALL)"""


@query("kernel_join", f"""{P}, {Q.similar(T, 'fine_title')}, {_GRAINS}, {_KERNEL}, base AS ({_FALLBACK})
  SELECT title, seniority, round(coalesce(kernel, estimate), 4) AS estimate FROM base LEFT JOIN k USING (title, seniority)""")
def kernel_join(spark, sf):
    train, asked = _train_and_asked(spark, sf)
    grains = look.grain_estimates(train, "title", "seniority", "salary")
    near = similar_titles(spark, sf, "fine_title")
    return look.kernel_join(asked, grains, near, T, "title", "seniority").select(
        "title", "seniority", F.round("estimate", 4).alias("estimate"))


@query("shrinkage_mix", f"""{P}, {Q.similar(T, 'fine_title')}, {_GRAINS}, {_KERNEL}, base AS ({_FALLBACK})
  SELECT title, seniority, round(CASE WHEN matched = 1 THEN 0.7 * estimate + 0.3 * coalesce(kernel, estimate)
  ELSE coalesce(kernel, estimate) END, 4) AS estimate FROM base LEFT JOIN k USING (title, seniority)""")
def shrinkage_mix(spark, sf):
    train, asked = _train_and_asked(spark, sf)
    grains = look.grain_estimates(train, "title", "seniority", "salary")
    near = similar_titles(spark, sf, "fine_title")
    return look.kernel_join(asked, grains, near, T, "title", "seniority", alpha=0.7).select(
        "title", "seniority", F.round("estimate", 4).alias("estimate"))


_CENTERS = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  dims AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM e) GROUP BY ALL),
  c AS (SELECT label AS center, list(x ORDER BY i) AS cv FROM dims GROUP BY ALL)"""


def label_centers(e):
    """Mean vector of each label: a short list."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>"))))
    return [r["c"] for r in e.groupBy("label").agg(mean.alias("c")).orderBy("label").collect()]


@query("nearest_prototype", f"""WITH {_CENTERS} SELECT center, arg_min(vec_id, list_distance(v, cv)) AS value,
  round(min(list_distance(v, cv)), 6) AS dist FROM c, e GROUP BY center""")
def nearest_prototype(spark, sf):
    e = table(spark, sf, "embeddings")
    return vec.nearest_prototype(e, "vec_id", "embedding", label_centers(e)).withColumn("dist", F.round("dist", 6))


@query("knn_values", f"""WITH {_CENTERS}, d AS (SELECT center, vec_id, list_distance(v, cv) AS dist FROM c, e)
  SELECT CAST(center AS VARCHAR) AS query, vec_id AS value, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY center ORDER BY dist, vec_id) AS rank FROM d) WHERE rank <= 5""")
def knn_values(spark, sf):
    e = table(spark, sf, "embeddings")
    asked = [(str(i), list(c)) for i, c in enumerate(label_centers(e))]
    return vec.knn_values(e, "vec_id", "embedding", asked, 5).withColumn("dist", F.round("dist", 6))

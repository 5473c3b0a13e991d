"""Encoders of dirty categories."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog import sql as Q
from catalog.lookups import title_vectors
from catalog.registry import query
from motley.functions import hashing
from motley.operators import encoders as enc
from motley.operators import topics as top
from motley.operators.aggregates import finite, value_counts
from motley.sources.people import people, table, titles
from motley.workdir import materialize

P = f"WITH {Q.PEOPLE}"


def unrolled(df, key, column, name="proto"):
    """One row per array element, numbered from 0."""
    return df.select(key, F.posexplode_outer(column).alias("ord", "x")).select(
        key, "ord", F.round("x", 6).alias("x"))


def _count_sql(source: str, value: str, lo: int, hi: int) -> str:
    """Gram counts of the preprocessed, lower-cased values."""
    pieces = ", ".join(f"list_transform(range(1, greatest(length(s) - {n - 2}, 1)), lambda i: substr(s, i, {n}))"
                       for n in range(lo, hi + 1))
    return rf"""SELECT {value}, s, gram, count(*) AS c FROM (SELECT {value}, s, unnest(list_concat({pieces})) AS gram FROM (
      SELECT {value}, regexp_replace(' ' || lower({value}) || ' ', '\s\s+', ' ', 'g') AS s FROM ({source}))) GROUP BY ALL"""


def _size(s: str, lo: int, hi: int) -> str:
    return "(" + " + ".join(f"length({s}) - {n - 1}" for n in range(lo, hi + 1)) + ")"


def _ngram_sql(protos: str, lo: int = 2, hi: int = 4) -> str:
    """Similarity of every raw title to prototypes(proto, ord)."""
    return f"""WITH {Q.PEOPLE}, vals AS (SELECT DISTINCT {Q.RAW} AS job_title FROM part), protos AS ({protos}),
  cx AS ({_count_sql('SELECT * FROM vals', 'job_title', lo, hi)}), cp AS ({_count_sql('SELECT proto FROM protos', 'proto', lo, hi)}),
  same AS (SELECT job_title, proto, sum(least(cx.c, cp.c)) AS same, any_value(cx.s) AS xs, any_value(cp.s) AS ps
    FROM cx JOIN cp USING (gram) GROUP BY ALL)
  SELECT job_title, CAST(ord AS INTEGER) AS ord, round(coalesce(same / CAST({_size('xs', lo, hi)} + {_size('ps', lo, hi)} - same AS DOUBLE), 0), 6) AS x
  FROM vals CROSS JOIN protos LEFT JOIN same USING (job_title, proto)"""


_FREQUENT = """SELECT job_title AS proto, row_number() OVER (ORDER BY n DESC, job_title) - 1 AS ord FROM (
  SELECT job_title, count(*) AS n FROM people GROUP BY ALL) ORDER BY n DESC, job_title LIMIT 12"""
_AUTO = """SELECT matched_title AS proto, row_number() OVER (ORDER BY matched_title) - 1 AS ord FROM (
  SELECT DISTINCT matched_title FROM people)"""


def _encode(spark, sf, fit_on=None, **options):
    rows = people(spark, sf, "job_title")
    model = enc.SimilarityEncoder("job_title", **options).fit(rows if fit_on is None else fit_on)
    return unrolled(model.transform(titles(spark, sf).select("job_title").distinct()), "job_title", "encoded")


@query("similarity_encode", _ngram_sql(_FREQUENT))
def similarity_encode(spark, sf):
    return _encode(spark, sf, categories="most_frequent", n_prototypes=12)


@query("similarity_encode_auto", _ngram_sql(_AUTO, 2, 3))
def similarity_encode_auto(spark, sf):
    matched = people(spark, sf, "matched_title").select(F.col("matched_title").alias("job_title"))
    return _encode(spark, sf, fit_on=matched, categories="auto", ngram_range=(2, 3))


_LISTED = ["blue ring", "cold gear", "red widget"]


@query("similarity_encode_levenshtein", f"""WITH v AS (SELECT DISTINCT {Q.RAW} AS job_title FROM part),
  p AS (SELECT unnest({_LISTED!r}) AS proto, unnest([0, 1, 2]) AS ord)
  SELECT job_title, CAST(ord AS INTEGER) AS ord, round((length(job_title) + length(proto) - levenshtein(job_title, proto))
  / (length(job_title) + length(proto)), 6) AS x FROM v, p""")
def similarity_encode_levenshtein(spark, sf):
    """An explicit list of categories."""
    return _encode(spark, sf, categories=_LISTED, similarity="levenshtein-ratio")


@query("similarity_encode_kmeans", f"""SELECT CAST(o AS INTEGER) AS ord, 1.0::DOUBLE AS best, n, true AS in_range FROM
  (SELECT count(DISTINCT {Q.RAW}) AS n FROM part), (SELECT unnest(range(8)) AS o)""")
def similarity_encode_kmeans(spark, sf):
    """Every prototype is a title, so the best similarity to it is 1."""
    out = _encode(spark, sf, categories="k-means", n_prototypes=8, seed=3)
    return out.groupBy("ord").agg(F.max("x").alias("best"), F.count("*").alias("n"),
                                  F.bool_and(F.col("x").between(-1, 1)).alias("in_range"))


_BUCKET = hashing.portable_sql("gram")


@query("ngram_similarity_hashed", f"""WITH vals AS (SELECT DISTINCT {Q.RAW} AS job_title FROM part),
  protos AS (SELECT unnest({_LISTED!r}) AS proto),
  cx AS (SELECT job_title, {_BUCKET} % 65536 AS b, sum(c) AS c FROM ({_count_sql('SELECT * FROM vals', 'job_title', 2, 4)}) GROUP BY ALL),
  cp AS (SELECT proto, {_BUCKET} % 65536 AS b, sum(c) AS c FROM ({_count_sql('SELECT proto FROM protos', 'proto', 2, 4)}) GROUP BY ALL),
  same AS (SELECT job_title, proto, sum(least(cx.c, cp.c)) AS same FROM cx JOIN cp USING (b) GROUP BY ALL)
  SELECT job_title, proto, round(same / CAST((SELECT sum(c) FROM cx WHERE cx.job_title = same.job_title)
    + (SELECT sum(c) FROM cp WHERE cp.proto = same.proto) - same AS DOUBLE), 6) AS similarity FROM same""")
def ngram_similarity_hashed(spark, sf):
    out = enc.ngram_similarity_hashed(titles(spark, sf), "job_title", _LISTED, (2, 4), 2**16, hashing.portable)
    return out.withColumn("similarity", F.round("similarity", 6))


def _minhash_sql(source: str, key: str, text: str, grams: str, lo: int, hi: int, seeds: int, ends: str) -> str:
    """CTE low(key, seed, ...) of the least, or least and largest, portable hash per seed."""
    pieces = ", ".join(f"list_transform(range(1, greatest(length({text}) - {n - 2}, 1)), lambda i: substr({text}, i, {n}))"
                       for n in range(lo, hi + 1))
    return f"""grams AS (SELECT {key}, {hashing.portable_sql('g')} AS base FROM (SELECT DISTINCT {key}, unnest(list_concat({pieces})) AS g
    FROM ({source}))),
  low AS (SELECT {key}, seed, {ends.format(h=f'(base * ({hashing.FACTOR} + {hashing.STEP} * seed) + seed) % {hashing.PRIME}')}
    FROM grams, (SELECT unnest(range({seeds})) AS seed) GROUP BY ALL)"""


_TARGET = """g AS (SELECT title, count(*) AS c, avg(salary) AS m FROM people GROUP BY ALL),
  w AS (SELECT avg(salary) AS prior, count(*) AS n, (SELECT count(*) FROM g) AS k FROM people)"""


@query("target_encode", f"""{P}, {_TARGET} SELECT row_id, round(c / (c + n / k) * m + (1 - c / (c + n / k)) * prior, 4)
  AS encoded FROM people JOIN g USING (title), w""")
def target_encode(spark, sf):
    p = people(spark, sf, "row_id", "title", "salary")
    return enc.TargetMeanEncoder("title", "salary").fit(p).transform(p).select(
        "row_id", F.round("encoded", 4).alias("encoded"))


@query("target_encode_unseen", f"""{P}, tr AS (SELECT * FROM people WHERE seniority > 23),
  g AS (SELECT fine_title, count(*) AS c, avg(gender) AS m FROM tr GROUP BY ALL),
  w AS (SELECT avg(gender) AS prior, count(*) AS n, (SELECT count(*) FROM g) AS k FROM tr)
  SELECT DISTINCT fine_title, round(CASE WHEN c IS NULL THEN prior ELSE c / (c + n / k) * m + (1 - c / (c + n / k)) * prior END, 6)
  AS encoded FROM people LEFT JOIN g USING (fine_title), w""")
def target_encode_unseen(spark, sf):
    """Categories the training rows do not hold take the overall mean."""
    p = people(spark, sf, "fine_title", "gender", "seniority")
    model = enc.TargetMeanEncoder("fine_title", "gender").fit(p.where("seniority > 23"))
    return model.transform(p.select("fine_title").distinct()).withColumn("encoded", F.round("encoded", 6))


@query("target_encode_multiclass", f"""{P}, g AS (SELECT title, count(*) AS c, [{', '.join(f"avg(CAST(employer = '{c}' AS INTEGER))" for c in 'ANR')}] AS m
    FROM people GROUP BY ALL), w AS (SELECT [{', '.join(f"avg(CAST(employer = '{c}' AS INTEGER))" for c in 'ANR')}] AS prior,
    count(*) AS n, (SELECT count(*) FROM g) AS k FROM people)
  SELECT title, CAST(i - 1 AS INTEGER) AS ord, round(c / (c + n / k) * m[i] + (1 - c / (c + n / k)) * prior[i], 6) AS x
  FROM g, w, (SELECT unnest([1, 2, 3]) AS i)""")
def target_encode_multiclass(spark, sf):
    p = people(spark, sf, "title", "employer")
    model = enc.TargetMeanEncoder("title", "employer", classes=["A", "N", "R"]).fit(p)
    return unrolled(model.transform(p.select("title").distinct()), "title", "encoded")


@query("minhash_encode_fast", f"""WITH {_minhash_sql('SELECT doc_id, text FROM documents', 'doc_id', 'text', 'text', 2, 4, 16, 'min({h}) AS hash')}
  SELECT doc_id, CAST(seed AS INTEGER) AS seed, hash FROM low""")
def minhash_encode_fast(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text")
    return enc.MinHashEncoder("text", 16, hashed=hashing.portable).transform(rows).select(
        "doc_id", F.posexplode_outer("encoded").alias("seed", "hash"))


@query("minhash_encode_murmur", rf"""WITH t AS (SELECT job_title, ' ' || trim(regexp_replace(lower(job_title), '\s+', ' ', 'g')) || ' ' AS s
    FROM (SELECT DISTINCT {Q.RAW} AS job_title FROM part)), {_minhash_sql('SELECT * FROM t', 'job_title', 's', 's', 2, 4, 30, 'min({h}) AS hash')}
  SELECT job_title, CAST(seed AS INTEGER) AS seed, round(hash / {hashing.PRIME - 1}, 9) AS hash FROM low""")
def minhash_encode_murmur(spark, sf):
    encoder = enc.MinHashEncoder("job_title", 30, hashing="murmur", hashed=hashing.portable)
    return encoder.long(titles(spark, sf), "seed").withColumn("hash", F.round("hash", 9))


@query("minmax_hash_encode", f"""WITH t AS (SELECT DISTINCT {Q.RAW} AS job_title FROM part),
  {_minhash_sql('SELECT * FROM t', 'job_title', 'job_title', 's', 2, 4, 5, 'min({h}) AS low, max({h}) AS high')}
  SELECT job_title, CAST(2 * seed AS INTEGER) AS place, low AS hash FROM low UNION ALL
  SELECT job_title, CAST(2 * seed + 1 AS INTEGER), high FROM low""")
def minmax_hash_encode(spark, sf):
    return enc.MinHashEncoder("job_title", 10, minmax=True, hashed=hashing.portable).long(titles(spark, sf))


@query("minhash_candidates", f"""WITH RECURSIVE t AS (SELECT DISTINCT {Q.RAW} AS job_title FROM part),
  {_minhash_sql('SELECT * FROM t', 'job_title', 'job_title', 's', 3, 3, 20, 'min({h}) AS hash')},
  bands AS (SELECT job_title, seed // 2 AS band, list(hash ORDER BY seed) AS hashes FROM low GROUP BY ALL),
  links AS (SELECT DISTINCT a.job_title AS a, b.job_title AS b FROM bands a JOIN bands b USING (band, hashes)),
  reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
  grouped AS (SELECT a AS value, min(b) AS representative FROM reach GROUP BY a HAVING count(DISTINCT b) > 1)
  SELECT value, representative, (SELECT count(*) FROM low x JOIN low y ON x.seed = y.seed AND x.hash = y.hash
    WHERE x.job_title = value AND y.job_title = representative) / 20 AS agreement FROM grouped""")
def minhash_candidates(spark, sf):
    return enc.minhash_candidates(titles(spark, sf), "job_title", hashed=hashing.portable)


@query("count_ngrams", f"""{P}, c AS ({_count_sql("SELECT DISTINCT job_title FROM people", 'job_title', 2, 4)})
  SELECT gram, CAST(sum(c * n) AS BIGINT) AS n FROM c JOIN (SELECT job_title, count(*) AS n FROM people GROUP BY ALL) USING (job_title) GROUP BY ALL""")
def count_ngrams(spark, sf):
    return enc.count_ngrams(people(spark, sf, "job_title"), "job_title")


@query("hash_ngrams", f"""{P}, c AS ({_count_sql("SELECT DISTINCT job_title FROM people", 'job_title', 2, 4)})
  SELECT {_BUCKET} % 4096 AS gram, CAST(sum(c * n) AS BIGINT) AS n FROM c
  JOIN (SELECT job_title, count(*) AS n FROM people GROUP BY ALL) USING (job_title) GROUP BY ALL""")
def hash_ngrams(spark, sf):
    return enc.count_ngrams(people(spark, sf, "job_title"), "job_title", hashing_dim=4096, hashed=hashing.portable)


@query("count_words", rf"""{P} SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(job_title), '\b\w\w+\b')) AS word
  FROM people) GROUP BY ALL""")
def count_words(spark, sf):
    return enc.count_words(people(spark, sf, "job_title"), "job_title")


@query("one_hot_encode", "SELECT c_custkey, [" + ", ".join(f"CAST(c_mktsegment = s[{i}] AS DOUBLE)" for i in range(1, 6)) +
       "]::VARCHAR AS codes FROM customer, (SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS s FROM customer)")
def one_hot_encode(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    index = StringIndexer(inputCol="c_mktsegment", outputCol="i", handleInvalid="keep", stringOrderType="alphabetAsc")
    model = Pipeline(stages=[index, OneHotEncoder(inputCol="i", outputCol="v", dropLast=True)]).fit(c)
    codes = F.array_join(F.transform(vector_to_array("v"), lambda x: x.cast("string")), ", ")
    return model.transform(c).select("c_custkey", F.concat(F.lit("["), codes, F.lit("]")).alias("codes"))


@query("scale_no_center", "SELECT event_id, round(value / (SELECT stddev_samp(value) FROM events), 6) AS scaled FROM events")
def scale_no_center(spark, sf):
    rows = VectorAssembler(inputCols=["value"], outputCol="v").transform(table(spark, sf, "events"))
    scaled = StandardScaler(inputCol="v", outputCol="s", withMean=False, withStd=True).fit(rows).transform(rows)
    return scaled.select("event_id", F.round(vector_to_array("s")[0], 6).alias("scaled"))


@query("column_pipeline", f"{P} SELECT row_id, 15 AS n_features, true AS finite FROM people")
def column_pipeline(spark, sf):
    """A different encoder per column, assembled to one vector; the rest dropped."""
    p = materialize(people(spark, sf, "row_id", "job_title", "ethnicity", "employer", "seniority", "salary"), "people")
    stages = [
        enc.SimilarityEncoder("job_title", "t", "most_frequent", 10, as_vector=True),
        enc.TargetMeanEncoder("ethnicity", "salary", "e", as_vector=True),
        StringIndexer(inputCol="employer", outputCol="i", handleInvalid="keep"),
        OneHotEncoder(inputCol="i", outputCol="o"),
        VectorAssembler(inputCols=["t", "e", "o", "seniority"], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=False),
    ]
    out = Pipeline(stages=stages).fit(p).transform(p).withColumn("x", vector_to_array("features"))
    return out.select("row_id", F.size("x").alias("n_features"), F.forall("x", finite).alias("finite"))


_CLUSTERED = f"SELECT DISTINCT {Q.clean(Q.RAW)} AS title, true AS known_label, 12 AS n_labels FROM part"


def _clustered(spark, sf, method):
    """A label from 1 to 12 for every title, all of them in use."""
    out = enc.cluster_titles(title_vectors(spark, sf, "title"), "title", "vector", 12, method=method)
    used = out.agg(F.count_distinct("label").cast("int").alias("n")).scalar()
    return out.select("title", F.col("label").between(1, 12).alias("known_label"), used.alias("n_labels"))


@query("cluster_titles", _CLUSTERED)
def cluster_titles(spark, sf):
    return _clustered(spark, sf, "kmeans")


@query("cluster_titles_hierarchy", _CLUSTERED)
def cluster_titles_hierarchy(spark, sf):
    return _clustered(spark, sf, "bisecting")


@query("rbf_features", "SELECT vec_id, 100 AS n, true AS in_range FROM embeddings")
def rbf_features(spark, sf):
    out = enc.rbf_features(table(spark, sf, "embeddings"), "embedding", 100, 0.5)
    bound = (2 / 100) ** 0.5 + 1e-9
    return out.select("vec_id", F.size("features").alias("n"),
                      F.forall("features", lambda x: x.between(-bound, bound)).alias("in_range"))


def _topics(spark, sf, **options):
    rows = people(spark, sf, "job_title")
    return rows, top.fit_topics(rows, "job_title", top.TopicParams(n_topics=8, max_iter=3, **options))


def _sums_sql(n: int) -> str:
    return f"SELECT CAST(t AS INTEGER) AS topic, 1.0::DOUBLE AS total, true AS not_negative FROM (SELECT unnest(range({n})) AS t)"


def topic_sums(weights):
    """Total weight of each topic and whether all are at least 0."""
    return weights.groupBy("topic").agg(F.round(F.sum("weight"), 6).alias("total"),
                                        F.bool_and(F.col("weight") >= 0).alias("not_negative"))


@query("gamma_poisson_init", _sums_sql(8))
def gamma_poisson_init(spark, sf):
    rows = people(spark, sf, "job_title")
    return topic_sums(top.topic_table(top._start(rows, "job_title", top.TopicParams(n_topics=8))[0]))


@query("gamma_poisson_fit", _sums_sql(8))
def gamma_poisson_fit(spark, sf):
    """Over the n-grams themselves, without buckets."""
    rows, model = _topics(spark, sf, hashing=False)
    return topic_sums(top.topic_table(model))


# weights that only depend on the n-gram and the topic, so that SQL can start from the same
_STEP_GRAMS = r"""t AS (SELECT job_title, count(*) AS n, lower(regexp_replace(job_title, '\s\s+', ' ', 'g')) AS s FROM people GROUP BY job_title),
  pieces AS (SELECT job_title, n, substr(s, i, k) AS gram FROM (SELECT *, unnest(range(1, length(s) - k + 2)) AS i
    FROM t, (SELECT unnest([2, 3, 4]) AS k) WHERE length(s) >= k)),
  counts AS (SELECT job_title, n, gram, count(*)::DOUBLE AS cnt FROM pieces GROUP BY ALL),
  raw AS (SELECT gram, j, 1.0 + (length(gram) + ascii(gram) * (j + 1)) % 7 AS w FROM (SELECT DISTINCT gram FROM counts), (SELECT unnest(range(4)) AS j)),
  w AS (SELECT gram, j, w / sum(w) OVER (PARTITION BY j) AS w FROM raw)"""


@query("gamma_poisson_step", f"""WITH {Q.PEOPLE}, {_STEP_GRAMS},
  h0 AS (SELECT job_title, greatest(1e-10, sum(cnt)) / 4 AS h FROM counts GROUP BY job_title),
  mixed AS (SELECT job_title, gram, n, cnt, h * sum(w) AS m FROM counts JOIN h0 USING (job_title) JOIN w USING (gram) GROUP BY job_title, gram, n, cnt, h),
  h AS (SELECT job_title, j, n, any_value(h) * sum(w * cnt / m) / 2 + 0.1 / 2 AS h FROM mixed JOIN h0 USING (job_title) JOIN w USING (gram)
    GROUP BY job_title, j, n),
  after AS (SELECT job_title, gram, n, cnt, sum(h * w) AS m FROM counts JOIN h USING (job_title, n) JOIN w USING (gram, j) GROUP BY ALL),
  x AS (SELECT gram, j, sum(a.n * h * cnt / m) AS x FROM after a JOIN h USING (job_title) GROUP BY gram, j),
  topic AS (SELECT j, 1e-10 * 0.9 + sum(n * h) AS b FROM h GROUP BY j),
  fresh AS (SELECT gram, j, (1e-10 * 0.9 + w * x) / b AS v FROM w JOIN x USING (gram, j) JOIN topic USING (j))
  SELECT CAST(j AS INTEGER) AS topic, gram, round(v / sum(v) OVER (PARTITION BY j), 9) AS weight FROM fresh""")
def gamma_poisson_step(spark, sf):
    """One step over all rows from given weights, with one round of activations."""
    rows = people(spark, sf, "job_title")
    params = top.TopicParams(n_topics=4, rho=0.9, hashing=False, inner_iter=1, n_batches=1)
    grams = top._grams(rows, "job_title", params).select("gram").distinct()
    first = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda j: 1.0 + F.pmod(F.length("gram") + F.ascii("gram") * j, F.lit(7)))
    model = top.step_topics(top.given_topics(grams.select("gram", first.alias("w")), params), rows, "job_title")
    return top.topic_table(model).withColumn("weight", F.round("weight", 9))


@query("gamma_poisson_transform", f"{P} SELECT row_id, 8 AS n_topics, true AS positive FROM people")
def gamma_poisson_transform(spark, sf):
    rows, model = _topics(spark, sf, init="random")
    out = top.transform_topics(model, people(spark, sf, "row_id", "job_title"), "job_title")
    return out.select("row_id", F.size("topics").alias("n_topics"), F.forall("topics", lambda x: x > 0).alias("positive"))


@query("gamma_poisson_score", "SELECT true AS finite, true AS better_than_start")
def gamma_poisson_score(spark, sf):
    """Divergence over all rows, compared with that of the starting topics."""
    rows, model = _topics(spark, sf)
    start = top._start(rows, "job_title", model.params)[0]
    fitted, begun = (float(top.score_topics(m, rows, "job_title")) for m in (model, start))
    return rows.limit(1).select(F.lit(abs(fitted) < float("inf")).alias("finite"), F.lit(fitted < begun).alias("better_than_start"))


@query("gamma_poisson_topics", """SELECT CAST(t AS INTEGER) AS topic, CAST(r AS INTEGER) AS rank, true AS is_share
  FROM (SELECT unnest(range(8)) AS t), (SELECT unnest([1, 2, 3]) AS r)""")
def gamma_poisson_topics(spark, sf):
    """Three words per topic; which ones depends on the start."""
    rows, model = _topics(spark, sf, init="k-means")
    found = top.topic_labels(model, rows, "job_title")
    return found.select("topic", "rank", F.col("share").between(0, 1).alias("is_share"))


@query("gamma_poisson_partial_fit", _sums_sql(8))
def gamma_poisson_partial_fit(spark, sf):
    """Three chunks of rows, one step each."""
    rows, model = people(spark, sf, "row_id", "job_title"), None
    for k in range(3):
        chunk = rows.where(F.pmod("row_id", F.lit(3)) == k)
        model = top.partial_fit_topics(model, chunk, "job_title", top.TopicParams(n_topics=8))
    return topic_sums(top.topic_table(model))


@query("encode_ethnicity", f"{P} SELECT row_id, 10 AS n_topics, true AS positive FROM people")
def encode_ethnicity(spark, sf):
    """Topics of the ethnicity spellings of all tables together."""
    rows = people(spark, sf, "row_id", "ethnicity")
    model = top.fit_topics(rows, "ethnicity", top.TopicParams(n_topics=10, r=None))
    out = top.transform_topics(model, rows, "ethnicity")
    return out.select("row_id", F.size("topics").alias("n_topics"), F.forall("topics", lambda x: x > 0).alias("positive"))

"""Chunked and streaming queries over the event and document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.encoders import _sums_sql, topic_sums
from catalog.registry import query
from motley.operators.topics import TopicParams, topic_table
from motley.plans.evaluate import accuracy
from motley.sources.people import people, table
from motley.streaming import chunks as ch
from motley.workdir import fresh_path


def chunked(spark, df, key, parts=3):
    """Write a table as several files and read it as a stream of them."""
    path = fresh_path(spark, "source")
    df.repartition(parts, key).write.parquet(path)
    return ch.read_chunks(spark, path, df.schema)


@query("scan_chunks", "SELECT event_id, event_type, value FROM events")
def scan_chunks(spark, sf):
    path = fresh_path(spark, "chunked")
    ch.scan_chunks(chunked(spark, table(spark, sf, "events").select("event_id", "event_type", "value"), "event_id"), path)
    return spark.read.parquet(path).select("event_id", "event_type", "value")


@query("stream_target_stats", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stream_target_stats(spark, sf):
    stream = chunked(spark, table(spark, sf, "events").select("event_id", "event_type", "value"), "event_id")
    newest = ch.stream_target_stats(stream, "event_type", "value", fresh_path(spark, "stats"))
    return newest().withColumn("mean", F.round("mean", 6))


@query("stream_topics", _sums_sql(6))
def stream_topics(spark, sf):
    rows = people(spark, sf, "row_id", "job_title")
    model = ch.stream_topics(chunked(spark, rows, "row_id"), "job_title", TopicParams(n_topics=6),
                             fresh_path(spark, "topics"))
    return topic_sums(topic_table(model))


@query("online_linear", "SELECT true AS better_than_half")
def online_linear(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("y"))
    model = ch.online_linear(chunked(spark, rows, "vec_id"), "embedding", "y", 64, fresh_path(spark, "online"))
    return accuracy(model.predict(rows, "embedding"), "y", "prediction").select(
        (F.col("accuracy") > 0.5).alias("better_than_half"))

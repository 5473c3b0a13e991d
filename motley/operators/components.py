"""Connected groups of a link table, found by Spark joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motley.workdir import fresh_path, remove


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = fresh_path(df.sparkSession, "links")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _state(edges: DataFrame) -> tuple:
    part = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(part)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node on its smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang the smaller neighbours of every node, and the node, on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links``; the root is the smallest node it reaches.

    Alternating large-star and small-star steps until the links no longer change. Neighbours
    are never collected: each step is a grouped minimum and an equi-join, so that a node with
    very many links is split like any skewed key. Each step is written, and the one before
    it deleted. Links with a null end are ignored; repeated links and loops do no harm.
    """
    spark = links.sparkSession
    edges = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct())
    edges, first = _written(edges)
    loops = edges.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("root"))
    edges, path = edges.where("u <> v"), first
    state = _state(edges)
    while state[0]:
        old = path
        edges, path = _written(_small_star(_large_star(edges)))
        if old != first:
            remove(spark, old)
        before, state = state, _state(edges)
        if before == state:
            break
    nodes = (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
             .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).unionByName(loops))
    return nodes.groupBy("node").agg(F.min("root").alias("root"))

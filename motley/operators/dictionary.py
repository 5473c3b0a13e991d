"""Work on distinct values: dictionaries, dense ids and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motley.functions.hashing import seeded
from motley.operators.joins import join_groups


def spread(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of a column over all task slots.

    For work that is heavy per value: adaptive execution would otherwise merge
    a small dictionary into few tasks.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # by a hash of the value: a repartition by the value itself would be dropped as redundant
    return df.select(column).na.drop().distinct().repartition(n, F.xxhash64(column))


def range_bounds(df: DataFrame, column: str, buckets: int, sample: int = 4096) -> list:
    """Upper bounds that cut the values of a column into ordered buckets.

    Taken from a sample of fixed size chosen by hash, so they are stable.
    """
    picked = df.select(column).orderBy(seeded(F.col(column)), column).limit(sample)
    values = sorted(r[0] for r in picked.collect())
    if len(values) <= buckets:
        return []
    return [values[i * len(values) // buckets] for i in range(1, buckets)]


def dense_ids(df: DataFrame, column: str, order: str = "hash", start: int = 1, seed: int = 0,
              name: str = "id", buckets: int | None = None) -> DataFrame:
    """(value, id) with ids start, start+1, ... over the distinct values.

    ``order='value'`` numbers the values in sorted order, ``'hash'`` in an
    order without meaning.  Values are cut into buckets and numbered inside
    each, then shifted by the sizes of the buckets before: no task sees all.
    """
    values = df.select(column).na.drop().distinct()
    if buckets is None:
        buckets = min(max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1024)
    if order == "value":
        bounds = range_bounds(values, column, buckets)
        bucket = (
            F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(column)))
            if bounds else F.lit(0)
        )
        rank: list[Column] = [F.col(column)]
    else:
        bucket = F.pmod(seeded(F.col(column), seed), F.lit(buckets)).cast("int")
        rank = [seeded(F.col(column), seed + 1), F.col(column)]
    tagged = values.withColumn("_bucket", bucket)
    sizes = tagged.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # at most `buckets` (1024) rows: a running total over them is a small task
    shift = sizes.select(
        "_bucket",
        (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_shift"),
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*rank))
    return (
        tagged.withColumn("_pos", inside).join(F.broadcast(shift), "_bucket")
        .select(column, (F.col("_shift") + F.col("_pos") + (start - 1)).alias(name))
    )


def dict_encode_join(df: DataFrame, column: str, name: str = "id", **options) -> DataFrame:
    """Add the dense id of a column to every row."""
    return df.join(dense_ids(df, column, name=name, **options), column, "left")


def ordinal_encode(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Sorted ordinal codes 0, 1, ..."""
    return dict_encode_join(df, column, name, order="value", start=0)


def variants(df: DataFrame, key: list[str], raw: list[str]) -> DataFrame:
    """Distinct (key, raw) pairs."""
    return df.select(*key, *raw).distinct()


def list_variants(df: DataFrame, key: str, raw: str) -> DataFrame:
    """Each raw spelling of a key with the number of spellings of the key.

    Long form: no key's spellings are gathered into one row.
    """
    pairs = variants(df, [key], [raw])
    counts = pairs.groupBy(key).agg(F.count("*").alias("n_variants"))
    return join_groups(pairs, counts, [key])


def canonicalize_by_words(df: DataFrame, column: str, name: str = "canonical") -> DataFrame:
    """One spelling, the last in order, for all permutations of the same words."""
    bag = F.array_join(F.array_sort(F.split(column, " ")), " ")
    spelled = df.select(column).distinct().withColumn("_bag", bag)
    chosen = spelled.groupBy("_bag").agg(F.max(column).alias(name))
    return join_groups(df.withColumn("_bag", bag), chosen, ["_bag"], "left").drop("_bag")


def anti_unseen(values: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Distinct values the model does not know."""
    return values.select(column).distinct().join(known.select(column), column, "left_anti")


def semi_known(values: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Rows whose value the model knows."""
    return values.join(known.select(column).distinct(), column, "left_semi")


def check_known(values: DataFrame, known: DataFrame, column: str, where: str) -> None:
    """Raise when a value is unknown (``handle_unknown='error'``)."""
    unknown = [r[0] for r in anti_unseen(values, known, column).orderBy(column).limit(5).collect()]
    if unknown:
        raise ValueError(f"column {column!r} holds values the encoder was not fitted on, such as {unknown}, in {where}")

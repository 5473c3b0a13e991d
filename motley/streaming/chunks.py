"""Incremental forms on Structured Streaming.

File sources are read with a bounded number of files per trigger and stop when
everything present has been read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motley.operators.aggregates import target_stats
from motley.operators.topics import TopicModel, TopicParams, load_topics, partial_fit_topics, save_topics
from motley.workdir import exists, fresh_path, read_settings, write_settings


def read_chunks(spark: SparkSession, path: str, schema, files_per_chunk: int = 1, fmt: str = "parquet") -> DataFrame:
    """A folder as a stream of chunks of whole files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_chunk).format(fmt).load(path)


def run_chunks(stream: DataFrame, on_chunk: Callable[[DataFrame, int], None], mode: str = "append",
               progress: str | None = None) -> None:
    """Call ``on_chunk(rows, chunk number)`` for every chunk present, then stop.

    With a folder for ``progress`` a later call goes on where this one ended.
    """
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(on_chunk).trigger(availableNow=True)
        .option("checkpointLocation", progress or fresh_path(stream.sparkSession, "stream")).start()
    )
    query.awaitTermination()


def scan_chunks(stream: DataFrame, path: str) -> None:
    """Write every chunk under its number; a chunk that is run again replaces itself."""
    run_chunks(stream, lambda rows, i: rows.write.mode("overwrite").parquet(f"{path}/chunk={i}"))


def stream_target_stats(stream: DataFrame, column: str, y: str, path: str) -> Callable[[], DataFrame]:
    """Running size and mean target per category; gives a reader of the newest state."""
    spark = stream.sparkSession
    newest = {"path": None}

    def save(state: DataFrame, i: int) -> None:
        state.write.mode("overwrite").parquet(f"{path}/batch={i}")
        newest["path"] = f"{path}/batch={i}"

    run_chunks(target_stats(stream, column, y), save, mode="complete")
    return lambda: spark.read.parquet(newest["path"])


def _resumable(stream: DataFrame, path: str, load: Callable, step: Callable, save: Callable):
    """Run ``step(state, rows)`` per chunk, keeping every state below ``path``; gives the last state.

    The state of a chunk is written whole before Spark marks the chunk as done. A chunk that is
    run again starts from the state before it, and a later call from the last one written.
    """
    spark = stream.sparkSession
    mark = f"{path}/newest"

    def at(i: int):
        """The state after chunk i, None before the first."""
        return load(f"{path}/state/{i}") if i >= 0 else None

    def on_chunk(rows: DataFrame, i: int) -> None:
        save(step(at(i - 1), rows), f"{path}/state/{i}")
        write_settings(spark, {"chunk": i}, f"{mark}/{i % 2}")

    run_chunks(stream, on_chunk, progress=f"{path}/progress")
    done = [read_settings(spark, f"{mark}/{k}")["chunk"] for k in (0, 1) if exists(spark, f"{mark}/{k}")]
    return at(max(done, default=-1))


def stream_topics(stream: DataFrame, column: str, params: TopicParams, path: str) -> TopicModel | None:
    """One topic-model step per chunk; states are kept below ``path``, so a later call goes on."""
    spark = stream.sparkSession
    return _resumable(
        stream, path, lambda p: load_topics(spark, p),
        lambda model, rows: partial_fit_topics(model, rows, column, params),
        lambda model, p: save_topics(model, spark, p))


@dataclass
class OnlineLinear:
    """Linear classifier with hinge loss, one averaged gradient step or more per chunk.

    The gradient of a chunk is a sum over its rows, made by the tasks; only
    the weights live on the driver.
    """

    dim: int
    alpha: float = 1e-4
    rate: float = 1.0
    steps: int = 5
    average: bool = True
    w: np.ndarray = field(default=None)
    total: np.ndarray = field(default=None)
    seen: int = 0

    def __post_init__(self):
        self.w = np.zeros(self.dim + 1) if self.w is None else self.w
        self.total = np.zeros(self.dim + 1)

    def partial_fit(self, rows: DataFrame, vec: str, y: str) -> "OnlineLinear":
        """Steps on one chunk of (vector, 0/1 label) rows."""
        data = rows.select(F.col(vec).alias("x"), (2 * F.col(y) - 1).cast("double").alias("y")).persist()
        for _ in range(self.steps):
            gradient, n = self._gradient(data)
            if n == 0:
                break
            self.seen += 1
            decay = np.append(self.alpha * self.w[:-1], 0.0)
            self.w = self.w - self.rate / np.sqrt(self.seen) * (gradient / n + decay)
            self.total += self.w
        data.unpersist()
        return self

    def _gradient(self, data: DataFrame) -> tuple[np.ndarray, float]:
        w = self.w

        def sums(batches):
            out, n = np.zeros(len(w)), 0
            for pdf in batches:
                if pdf.empty:
                    continue
                x = np.column_stack([np.stack(pdf["x"].to_numpy()).astype(float), np.ones(len(pdf))])
                y = pdf["y"].to_numpy()
                wrong = y * (x @ w) < 1
                out -= (x[wrong] * y[wrong, None]).sum(axis=0)
                n += len(pdf)
            yield pd.DataFrame({"i": np.arange(len(w) + 1), "v": np.append(out, n)})

        # one row per weight and task goes through the shuffle
        got = data.mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        full = np.zeros(len(w) + 1)
        full[got["i"]] = got["v"]
        return full[:-1], full[-1]

    def save(self, spark: SparkSession, path: str) -> None:
        write_settings(spark, {"dim": self.dim, "alpha": self.alpha, "rate": self.rate, "steps": self.steps,
                               "average": self.average, "w": self.w.tolist(), "total": self.total.tolist(),
                               "seen": self.seen}, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "OnlineLinear":
        settings = read_settings(spark, path)
        w, total = np.array(settings.pop("w")), np.array(settings.pop("total"))
        model = cls(**settings, w=w)
        model.total = total
        return model

    def weights(self) -> np.ndarray:
        return self.total / self.seen if self.average and self.seen else self.w

    def predict(self, df: DataFrame, vec: str, output: str = "prediction") -> DataFrame:
        w = self.weights()

        @F.pandas_udf("int")
        def side(x: pd.Series) -> pd.Series:
            return pd.Series((np.stack(x.to_numpy()).astype(float) @ w[:-1] + w[-1] > 0).astype("int32"))

        return df.withColumn(output, side(F.col(vec)))


def online_linear(stream: DataFrame, vec: str, y: str, dim: int, path: str, **options) -> OnlineLinear | None:
    """Fit on a stream of chunks; states are kept below ``path``, so a later call goes on."""
    spark = stream.sparkSession
    return _resumable(
        stream, path, lambda p: OnlineLinear.load(spark, p),
        lambda model, rows: (model or OnlineLinear(dim, **options)).partial_fit(rows, vec, y),
        lambda model, p: model.save(spark, p))

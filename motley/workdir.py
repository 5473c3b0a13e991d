"""Shared working folder for tables an operator has to write and read back.

Lineage is cut by writing a Parquet table rather than by keeping blocks on one
executor, so the loss of an executor never loses a result.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_fallback: list[str] = []


def use_local_folder(path: str) -> None:
    """Folder for sessions in one process that leave ``spark.checkpoint.dir`` unset."""
    _fallback[:] = [path]


def work_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, which all executors must share."""
    base = spark.conf.get(_SETTING, None)
    if not base and _fallback and re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        base = _fallback[0]
    if not base:
        raise RuntimeError(f"set {_SETTING} to a folder that the driver and all executors share")
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the working folder."""
    return f"{work_dir(spark)}/motley/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """A few settings as JSON in a folder of their own."""
    spark.createDataFrame([(json.dumps(settings),)], "value STRING").coalesce(1).write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``fresh_path`` that nothing will read again."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)

"""Helpers that the training-data operators share: sessions, tables, words."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.lineage import cut, new_path, shared_dir  # noqa: F401

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: What Python workers are started with: large arrays go back to the system when they are freed, so workers stay small beside the heap.
WORKER_ENV = {"MALLOC_MMAP_THRESHOLD_": "8388608", "MALLOC_TRIM_THRESHOLD_": "16777216", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows that go to a Python worker at a time, where the session doesn't say: texts are long, and each batch is held whole on both sides.
BATCH_ROWS = "1000"
_ROWS, _DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def ship(spark: SparkSession) -> None:
    """Lets Python workers that share this file system import the package (elsewhere: --py-files), and bounds their batches."""
    if spark.conf.get(_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_ROWS, BATCH_ROWS)
    env = spark.sparkContext.environment
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, columns: list[str], schema: str | T.StructType, rows: Callable[..., Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow over the named columns; rows gets the task's iterator of batches."""
    ship(df.sparkSession)
    return df.select(*columns).mapInArrow(rows, schema)


def text_column(df: DataFrame, name: str = "text") -> DataFrame:
    """Null text counts as empty."""
    return df.withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit("")))


def words(text: str) -> list[bytes]:
    """Maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()

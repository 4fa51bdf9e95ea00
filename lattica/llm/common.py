"""Helpers shared by the training-data operators: shared scratch tables and deterministic buckets."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def long_texts(spark: SparkSession, most: int = 1000) -> None:
    """Let Arrow batches to Python hold ``most`` rows at most: 10,000 long texts and their arrays are too much for a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > most or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(most))


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fold(doc_id: str, n: int) -> Column:
    """``crc32(doc_id as text) mod n``; a null id counts as the empty text (crc 0, fold 0)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(n))


def row_key(*cols: str) -> Column:
    """One string for a tuple of columns, nulls kept apart from texts."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in cols])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    long_texts(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hand_back() -> None:
    """Return a Python worker's freed memory to the system: workers live on into later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and the run is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="wattloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_made: list[list[str]] = []  # of each open passing(): the tables written since it was opened


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    for made in _made:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the stored tables of its body at its end, but for those that the body takes off the list it gets."""
    made: list[str] = []
    _made.append(made)
    try:
        yield made
    finally:
        _made.remove(made)
        for path in made:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


UPPER_TO_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, *UPPER_TO_LOWER))


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """df, marked for broadcast only where a count of its rows is within the bound; otherwise Spark shuffles."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def small_batches(spark: SparkSession, rows: int = 2_000, size: str = "4m") -> None:
    """Bounds what one Arrow batch brings to a Python worker, by rows and by bytes; smaller settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


@contextmanager
def few_rows_read(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started in its body decode so few rows of a Parquet file at once: for tables whose rows are long."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def chunks(it: Iterator[pd.DataFrame], column: str, chars: int) -> Iterator[pd.DataFrame]:
    """Batches cut between rows, after about so many characters of a column: memory doesn't follow the rows of a batch."""
    for pdf in it:
        ends = pdf[column].str.len().fillna(0).cumsum().to_numpy() // chars
        for _, part in pdf.groupby(ends, sort=False):
            yield part


def released(make: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives memory back to the system at the end of each partition.

    Python workers live on between stages; what they hold then counts against the next one.
    """

    @wraps(make)
    def run(it: Iterator) -> Iterator:
        try:
            yield from make(it)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library: nothing to trim
                pass

    return run


def schema_with(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of df with the fields of a DDL string after its own."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])

"""Shared plumbing of the training-data operators: tables, shared storage, text guards."""

from __future__ import annotations

import gc
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder, at a fresh path or a given one, and read back.

    This cuts lineage: a lost executor never costs more than the stages after
    the table, and what is nondeterministic upstream is fixed once.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes stored tables that nothing reads any more, and the shuffle files that nothing refers to."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)
    swept(spark)


def swept(spark: SparkSession) -> None:
    """Lets Spark find the shuffle files of finished steps: it deletes those that no object of the driver refers to.

    A step whose result is stored is done with its shuffles; without this they would stay until the driver's memory fills.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, most_rows: int = 50_000) -> DataFrame:
    """``df``, a stored or cheap table of narrow rows, with a broadcast hint if it has at most ``most_rows``."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def text_or_empty(column: str = "text"):
    """The text column with null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def single_threaded() -> None:
    """Keeps native libraries of a Python worker to the one core that its task has."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")


def slices(batches, most: int = 1024):
    """Arrow batches in slices of at most ``most`` rows, so that what Python makes of the rows stays small.

    Memory that Arrow frees goes back to the system, which counts where workers outlive their task.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)

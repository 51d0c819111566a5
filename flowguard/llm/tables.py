"""Reading the corpus tables, and written intermediate tables."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.session import write_through

#: A word is a run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch where whole texts go to Python and back.
BATCH_ROWS = 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that later passes neither repeat nor lose it."""
    return write_through(df, f"llm-{purpose}")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of results that are written and no longer referenced.

    Its cleaner acts when the driver's JVM collects garbage, which a quiet driver may not do for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows in what is written meanwhile.

    A task holds a batch several times over, in the JVM's direct memory and in Python. The setting is put back.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, min(before, rows) if before > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)

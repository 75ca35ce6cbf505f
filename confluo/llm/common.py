"""Session helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.scratch import dropped, is_empty, saved, scratch_path, shared_dir, swept

__all__ = ["batches", "dropped", "is_empty", "saved", "scratch_path", "shared_dir", "short_batches", "swept", "table", "texts"]

#: Rows in an Arrow batch given to Python. Texts can be megabytes long, so batches stay short.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input folder; the path may be in any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's rows per Arrow batch to at most ``rows``, for results that the caller runs later."""
    now = int(spark.conf.get(_KEY, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(_KEY, str(rows))


@contextmanager
def batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Short Arrow batches for what runs inside; the session's setting comes back."""
    before = spark.conf.get(_KEY, "10000")
    short_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(_KEY, before)


def texts(docs: DataFrame, text: str = "text") -> F.Column:
    """The text column as a non-null string."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))

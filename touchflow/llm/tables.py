"""Reading the document tables and small helpers that several operators share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to about ``BATCH_BYTES``, unless it has a bound of its own.

    By default a batch is 10,000 rows or 64 MB: for whole texts, each is held by the task, outside the
    heap and in the Python process.  A text longer than the bound is a batch of its own.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def one_thread() -> None:
    """Task processes share their cores with other tasks: native libraries get one thread each."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

"""Numbered labels of text features, stored so that fit and scoring use the same codes."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchflow.session import stored

_PART = 1 << 33  # the row numbers of a task lie below it in monotonically_increasing_id


def category_labels(table: DataFrame, column: str, after: int = 0) -> DataFrame:
    """(label, position): the sorted distinct values of a column, numbered from ``after`` + 1 on.

    Labels are sorted by ranges that sampling makes equal in size, whatever beginnings they share, and
    a label's number is its place in its range plus the labels of the ranges before.  The sorted labels
    are stored, so whoever reads the result, each micro-batch of a stream for one, gets the same
    numbers; the driver sees the sizes of the ranges only, one number per task.
    """
    ranged = table.select(F.col(column).cast("string").alias("label")).dropna().distinct() \
        .repartitionByRange("label").sortWithinPartitions("label") \
        .select("label", F.monotonically_increasing_id().alias("_id"))
    part, row = F.floor(F.col("_id") / _PART), F.col("_id") % _PART
    sorted_labels = stored(ranged, "labels")
    sizes = {r["part"]: r["n"] for r in sorted_labels.groupBy(part.alias("part")).agg(
        F.count("*").alias("n")).collect()}
    before = accumulate((sizes.get(i, 0) for i in range(max(sizes, default=-1))), initial=after)
    return sorted_labels.select("label", (F.get(F.array(*map(F.lit, before)), part.cast("int"))
                                          + row + 1).cast("long").alias("position"))


def save_labels(table: DataFrame, column: str, path: str, version: int) -> None:
    """Writes version ``version`` of a dictionary: the one before with its numbers, and new labels of
    the column after them.  Version 1 starts it."""
    labels = table.select(F.col(column).cast("string").alias("label"))
    if version == 1:
        numbered = category_labels(labels, "label")
    else:
        known = read_labels(table.sparkSession, path, version - 1)
        last = known.agg(F.coalesce(F.max("position"), F.lit(0))).first()[0]
        numbered = known.unionByName(category_labels(
            labels.join(known, "label", "left_anti"), "label", last))
    numbered.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_labels(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(label, position) of a version, which never changes once it is written."""
    return spark.read.schema("label string, position long").parquet(f"{path}/version={version}")

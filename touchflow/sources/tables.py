"""Batch scans and the batch sink."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from touchflow.schemas import CHANNEL_COLUMNS, CUSTOMER_COLUMNS, ddl
from touchflow.session import stored

log = logging.getLogger(__name__)

_RECORD = "_rejected_record"


def read_csv(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """CSV scan matched to ``columns`` by header name.

    Spark matches a declared CSV schema by position, so the schema is put in header order first.
    Declared columns the file lacks come back null, others are never parsed.  A directory whose
    files disagree on their header raises instead of mixing columns up.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    header = reader.csv(path).columns
    in_file_order = {name: columns.get(name, "string") for name in header}
    return conform(reader.schema(ddl(in_file_order)).csv(path), columns)


def read_csv_checked(spark: SparkSession, path: str, columns: Mapping[str, str]
                     ) -> tuple[DataFrame, DataFrame]:
    """Rows of a CSV scan that fit ``columns``, and the rejected ones: (file, record, reason).

    ``read_csv`` gives null for a value that does not parse; here its row is rejected, with the
    names of the columns whose values do not parse, or ``number of fields``, as the reason.  Both
    results come from one pass over the files, whose outcome is stored.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    header = reader.csv(path).columns
    kinds = {name: columns.get(name, "string") for name in header}
    parsed = stored(
        reader.option("columnNameOfCorruptRecord", _RECORD)
        .schema(f"{ddl(kinds)}, `{_RECORD}` string").csv(path)
        .withColumn("_file", F.col("_metadata.file_path")), "csv-checked")
    fits = F.col(_RECORD).isNull()
    texts = F.from_csv(_RECORD, ddl({name: "string" for name in header}))
    wrong = F.array_compact(F.array(*[
        F.when(F.col(f"`{name}`").isNull() & (texts[name] != ""), F.lit(name))
        for name, kind in kinds.items() if kind != "string"], F.lit(None).cast("string")))
    reason = F.when(F.size(wrong) > 0, F.array_join(wrong, ", ")).otherwise("number of fields")
    rejects = parsed.filter(~fits).select(
        F.col("_file").alias("file"), F.col(_RECORD).alias("record"), reason.alias("reason"))
    return conform(parsed.filter(fits).drop(_RECORD, "_file"), columns), rejects


def conform(table: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Select ``columns`` in order with their types; absent ones become null."""
    present = set(table.columns)
    return table.selectExpr(*[
        f"CAST({f'`{name}`' if name in present else 'NULL'} AS {kind}) AS `{name}`"
        for name, kind in columns.items()
    ])


def read_table(spark: SparkSession, path: str, columns: Mapping[str, str],
               fmt: str = "csv") -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, columns)
    return conform(spark.read.format(fmt).load(path), columns)


def read_channel(spark: SparkSession, channel: str, path: str, fmt: str = "csv") -> DataFrame:
    """One channel's interactions, tagged with the channel name."""
    if channel not in CHANNEL_COLUMNS:
        raise ValueError(f"unknown channel {channel!r}; known: {', '.join(CHANNEL_COLUMNS)}")
    return tag_channel(read_table(spark, path, CHANNEL_COLUMNS[channel], fmt), channel)


def tag_channel(table: DataFrame, channel: str) -> DataFrame:
    return table.withColumn("channel", F.lit(channel))


def read_customers(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, CUSTOMER_COLUMNS, fmt)


class Channels(dict):
    """Tables by channel; ``left_out`` has the reason for each that could not be opened."""

    def __init__(self) -> None:
        super().__init__()
        self.left_out: dict[str, str] = {}


def collect_channels(spark: SparkSession, configs: Mapping[str, Mapping[str, str]],
                     strict: bool = False) -> Channels:
    """Lazy scans of the configured channels, ``{channel: {"path": ..., "format": ...}}``.

    A source that cannot be opened is logged and named in the result's ``left_out``, so that a
    caller knows what its journeys lack; with ``strict`` it is an error.  Row counts cost a pass over the data,
    so they are a separate query (``channel_counts``) instead of one job per source here.
    """
    unknown = sorted(set(configs) - set(CHANNEL_COLUMNS))
    if unknown:
        raise ValueError(f"unknown channels: {', '.join(unknown)}")
    tables = Channels()
    for channel, config in configs.items():
        try:
            tables[channel] = read_channel(spark, channel, config["path"],
                                           config.get("format", "csv"))
        except (PySparkException, KeyError) as error:
            if strict:
                raise
            log.error("channel %s left out: %s", channel, error)
            tables.left_out[channel] = str(error)
    return tables


def save_table(table: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
               partition_by: Iterable[str] = ()) -> None:
    writer = table.write.format(fmt).mode(mode)
    if fmt in ("csv", "json"):
        # The default pattern keeps milliseconds only.
        writer = writer.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    if fmt == "csv":
        writer = writer.option("header", True)
    partitions = list(partition_by)
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.save(path)


def append_log(rows: DataFrame, path: str, time_col: str = "timestamp",
               batch_id: str | None = None) -> None:
    """Append to a Parquet log partitioned by day, so time filters prune whole folders.

    Rows are dealt by day first, so a day gets few files; adaptive execution splits a large day.
    A named batch owns a folder in each of its days and replaces it when it is written again, so
    a repeat adds nothing.
    """
    dated = rows.withColumn("log_date", F.to_date(time_col)).hint("rebalance", "log_date")
    if batch_id is None:
        save_table(dated, path, mode="append", partition_by=["log_date"])
        return
    (dated.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("log_date", "batch_id")
     .parquet(path))

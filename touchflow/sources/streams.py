"""Streaming sources and sinks, kept apart from parsing so that any raw frame can feed it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from touchflow.session import state_on_disk

Sink = Callable[[DataFrame, DataFrame, int], None]


def kafka_stream(spark: SparkSession, servers: str, topic: str, starting_offsets: str = "latest",
                 **options: str) -> DataFrame:
    """Raw messages of a topic.  Needs the public ``spark-sql-kafka`` package on the class path."""
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic)
              .option("startingOffsets", starting_offsets))
    return reader.options(**options).load()


# Bytes that one micro-batch takes from a folder at most; it takes the rest with the next ones.
BATCH_BYTES = 1 << 30


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet",
                **options: str) -> DataFrame:
    """The rows of a table that is one file or a folder of part files, and of files added later.

    A micro-batch takes whole files up to ``BATCH_BYTES`` unless another bound is given.  Files
    are taken in the order of their modification; with a watermark, rows may be out of order
    across micro-batches by its delay.
    """
    bounds = {"maxfilespertrigger", "maxbytespertrigger"}
    if not bounds & {name.lower() for name in options}:
        options["maxBytesPerTrigger"] = str(BATCH_BYTES)
    # As a pattern: a plain path must be a folder.
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.format(fmt).schema(schema).options(**options).load(pattern)


def _trigger(writer, trigger: Mapping | None):
    return writer.trigger(**trigger) if trigger else writer


def write_stream(table: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                 trigger: Mapping | None = None) -> StreamingQuery:
    """Append-only file sink.  Every query needs a checkpoint folder of its own.

    State, if the stream has any, is in RocksDB: that of ``transformWithState`` has to be.
    """
    writer = (table.writeStream.outputMode("append").format(fmt)
              .option("path", path).option("checkpointLocation", checkpoint))
    with state_on_disk(table.sparkSession):
        return _trigger(writer, trigger).start()


def write_kafka(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Sends ``key`` / ``value`` rows to a topic."""
    return (messages.writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint).start())


def run_folder(batch: DataFrame, path: str) -> str:
    """The folder of a micro-batch's query below ``path``; its id is kept in the checkpoint."""
    run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{path}/run_id={run}"


def batch_folder(batch: DataFrame, path: str, batch_id: int) -> str:
    """The folder that a micro-batch owns below ``path``.

    It is named by the query and the batch: a repeated batch replaces its own rows, and a query
    with a new checkpoint, which counts from 0 again, replaces nothing.
    """
    return f"{run_folder(batch, path)}/batch_id={batch_id}"


def to_files(path: str) -> Sink:
    """Sink that writes each micro-batch to its own folder below ``path``."""
    def write(rows: DataFrame, batch: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(batch_folder(batch, path, batch_id))
    return write


def to_kafka(servers: str, topic: str) -> Sink:
    """Sink that sends ``key`` / ``value`` rows to a topic."""
    def write(rows: DataFrame, batch: DataFrame, batch_id: int) -> None:
        (rows.write.format("kafka").option("kafka.bootstrap.servers", servers)
         .option("topic", topic).save())
    return write


def write_batches(table: DataFrame, transform: Callable[[DataFrame], DataFrame],
                  sink: str | Sink, checkpoint: str, trigger: Mapping | None = None,
                  also: Sequence[tuple[Callable[[DataFrame], DataFrame], str | Sink]] = (),
                  finish: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Applies a batch transformation to each micro-batch and hands its rows to a sink.

    A sink is a folder or a function of (rows, micro-batch, number).  The transformed rows are kept
    while they are written, through ``finish`` to ``sink`` and through the first of each pair in
    ``also`` to its second.  ``foreachBatch`` may repeat a batch after a failure; folders hold its
    rows once all the same.
    """
    outputs = [(finish or (lambda rows: rows), sink), *also]
    outputs = [(shape, to_files(to) if isinstance(to, str) else to) for shape, to in outputs]

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        rows = transform(kept).persist() if len(outputs) > 1 else transform(kept)
        try:
            for shape, to in outputs:
                to(shape(rows), batch, batch_id)
        finally:
            rows.unpersist()
            kept.unpersist()

    writer = table.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, trigger).start()

"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_STORE = "spark.sql.streaming.stateStore.providerClass"

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Reduce tasks are sized by bytes at run time; the static count is only an upper limit.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Window state of all customers outgrows the heap; RocksDB keeps it on local disk and
    # uploads changes to the checkpoint.
    _STORE:
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str, master: str | None = None, **overrides: str) -> SparkSession:
    """Session with the library's settings; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = SETTINGS | {name.replace("__", "."): value for name, value in overrides.items()}
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started meanwhile keep their state in RocksDB, whoever built the session.

    A stream takes its settings when it starts; the session's own are as before afterwards.
    """
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, SETTINGS[_STORE])
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


# Folders handed out by this process, for ``release_all``.
_FOLDERS: set[str] = set()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which every executor can reach.

    Where that is unset, a folder in the warehouse; on a cluster that is an error if the warehouse
    is a local folder, as each machine would see its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/work"
        if not spark.sparkContext.master.startswith("local") and root.startswith(("file:", "/")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{root.rstrip('/')}/touchflow/{label}-{uuid.uuid4().hex}"
    _FOLDERS.add(folder)
    return folder


def _deleted(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _FOLDERS.discard(path)


def release_all(spark: SparkSession) -> None:
    """Deletes all working folders of this process: results that read them must have been used."""
    for path in list(_FOLDERS):
        _deleted(spark, path)


# Where stored tables lie, for ``released``.
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(table: DataFrame, label: str) -> DataFrame:
    """The table written to the shared folder and read back.

    Cuts the lineage at a result that several later steps read; it survives lost executors.
    """
    path = shared_folder(table.sparkSession, label)
    table.write.parquet(path)
    result = table.sparkSession.read.parquet(path)
    _PLACES[result] = path
    return result


def released(table: DataFrame) -> None:
    """Deletes a stored table that no later step reads; nothing happens to any other table."""
    path = _PLACES.pop(table, None)
    if path is not None:
        _deleted(table.sparkSession, path)

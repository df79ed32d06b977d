"""The shared working folder."""

from pathlib import Path

import pytest

from touchflow import session


def test_stored_tables_are_released(spark, monkeypatch):
    monkeypatch.setattr(session, "_FOLDERS", set())
    first, second = (session.stored(spark.range(5), "kept") for _ in range(2))
    places = [Path(p.removeprefix("file:")) for p in (session._PLACES[first], session._PLACES[second])]
    assert all(p.is_dir() for p in places) and first.count() == 5
    session.released(first)
    session.released(first)  # nothing to do
    session.released(spark.range(1))
    assert [p.is_dir() for p in places] == [False, True]
    session.release_all(spark)
    assert not places[1].exists() and not session._FOLDERS


class _Cluster:
    """A session that knows its master and settings only."""

    def __init__(self, master, **settings):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = {name.replace("__", "."): value for name, value in settings.items()}


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(_Cluster("yarn", spark__sql__warehouse__dir="file:/home/w"), "x")
    for cluster in (_Cluster("yarn", spark__sql__warehouse__dir="hdfs://n/w"),
                    _Cluster("yarn", spark__checkpoint__dir="s3a://b/c"),
                    _Cluster("local[2]", spark__sql__warehouse__dir="file:/home/w")):
        folder = session.shared_folder(cluster, "x")
        assert "/touchflow/x-" in folder
        session._FOLDERS.discard(folder)

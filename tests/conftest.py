import sys
from datetime import datetime
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from touchflow.session import build_session

    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as plain tuples, sorted."""
    def collect(table, *columns):
        picked = table.select(*columns) if columns else table
        return sorted((tuple(row) for row in picked.collect()), key=repr)
    return collect


@pytest.fixture(scope="session")
def at():
    """``at("10:00:05")`` on a fixed day, or with a date in front."""
    def moment(text):
        return datetime.fromisoformat(text if "-" in text else f"2024-01-15 {text}")
    return moment

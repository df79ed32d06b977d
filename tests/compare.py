"""Runs registered queries next to their SQL counterparts and compares all values."""

from __future__ import annotations

import argparse
import sys
import tempfile
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _kind(value):
    return "null" if value is None else type(value).__name__


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(record[i] for i in order) for record in records), key=repr)


def differences(result, connection, sql: str) -> list[str]:
    """Empty if names, row count, Python types and all values agree."""
    reference = connection.execute(sql)
    names = [d[0] for d in reference.description]
    expected = _rows(names, reference.fetchall())
    actual = _rows(result.columns, [tuple(row) for row in result.collect()])
    if sorted(names) != sorted(result.columns):
        return [f"columns {sorted(result.columns)} expected {sorted(names)}"]
    found = []
    if len(actual) != len(expected):
        found.append(f"{len(actual)} rows, expected {len(expected)}")
    for mine, theirs in zip(actual, expected):
        if mine != theirs or [_kind(v) for v in mine] != [_kind(v) for v in theirs]:
            found.append(f"{mine}\n      expected {theirs}")
        if len(found) > 3:
            break
    return found


def main() -> int:
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as contract
    from touchflow.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    parser.add_argument("--width", type=int, default=400, help="characters shown per error")
    options = parser.parse_args()
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__checkpoint__dir=tempfile.mkdtemp(prefix="compare-"),
                          spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracle = connect(options.sf_dir), contract.oracle_sql()
    bad = 0
    for name, run in contract.queries().items():
        if options.names and name not in options.names:
            continue
        begin = time.time()
        try:
            if name in oracle:
                found = differences(run(spark, options.sf_dir), connection, oracle[name])
            else:
                found = [] if run(spark, options.sf_dir).count() else ["no rows"]
        except Exception as error:  # noqa: BLE001 - reported per query
            found = [f"{type(error).__name__}: {str(error)[:options.width]}"]
        bad += bool(found)
        state = "FAIL" if found else ("ok" if name in oracle else "ok (rows only)")
        print(f"{name:28s} {time.time() - begin:6.2f}s {state}", *found, sep="\n      "
              if found else " ", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())

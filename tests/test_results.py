"""Newest results from the newest day folders."""

import random
from datetime import datetime, timedelta

import pytest

from touchflow.operators import recommend as rec
from touchflow.session import shared_folder

LOG = "customer_id long, test_name string, group string, timestamp timestamp"


@pytest.fixture(scope="module")
def log(spark):
    draw, start = random.Random(6), datetime(2024, 1, 1)
    rows = [(i, draw.choice(["busy", "busy", "busy", "other", None]), draw.choice("AB"),
             start + timedelta(seconds=draw.randrange(30 * 86400))) for i in range(3000)]
    rows += [(9000 + i, "old", "A", start + timedelta(days=i % 3)) for i in range(40)]
    rows += [(9100 + i, test, "B", None) for i in range(30) for test in ("other", "timeless")]
    rows += [(9200 + i, "busy", "A", datetime(2024, 1, 30, 23, 59, 59)) for i in range(25)]  # ties
    return spark.createDataFrame(rows, LOG)


@pytest.fixture(scope="module")
def path(spark, log):
    path = shared_folder(spark, "results")
    for part in range(3):
        for _ in range(2):  # a repeat adds nothing
            rec.append_results(log.filter(log.customer_id % 3 == part), path, f"part{part}")
    return path


@pytest.mark.parametrize("limit", [1, 10, 100, 700, 5000])
def test_equal_to_a_scan_of_the_whole_log(spark, log, path, rows, limit):
    assert rows(rec.newest_results(spark, path, limit)) == rows(rec.latest_results(log, limit))
    for test in ("busy", "old", "timeless", "absent"):
        got = rec.newest_results(spark, path, limit, test)
        assert rows(got) == rows(rec.latest_results(log, limit, test))


def test_only_the_newest_folders_are_read(spark, path, rows):
    def folders(**options):
        plan = rec.newest_results(spark, path, **options)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan
        return rec.newest_days(spark, path, **options).select("day").distinct().count()

    assert folders(limit=100, test_name="busy") == 2  # about 60 a day and 25 ties, of 30 days
    assert folders(limit=100, test_name="other") <= 6
    assert folders(limit=10_000, test_name="busy") == 30

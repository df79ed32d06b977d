import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from touchflow.operators import features as ft, labels as lb

REQUEST = "request_id long, customer_id string, timestamp timestamp"
WRITE = ("customer_id string, feature string, value string, written_at timestamp, "
         "ttl_s long")


def lookup(spark, requests, writes, names=("f",), **options):
    table = ft.lookup_features(spark.createDataFrame(requests, REQUEST),
                               spark.createDataFrame(writes, WRITE), names, **options)
    return {r["request_id"]: tuple(r[f"stored_{n}"] for n in names) for r in table.collect()}


def test_lifetime_edges(spark, at):
    asked = at("10:00:00")
    for age, value in ((0, "v"), (3599, "v"), (3600, None), (3601, None), (-1, None)):
        write = ("c", "f", "v", asked - timedelta(seconds=age), 3600)
        assert lookup(spark, [(1, "c", asked)], [write]) == {1: (value,)}


def test_expired_newer_write_hides_an_older_live_one(spark, at):
    writes = [("c", "f", "old", at("08:00:00"), 86400), ("c", "f", "new", at("09:00:00"), 60)]
    assert lookup(spark, [(1, "c", at("08:30:00")), (2, "c", at("09:00:30")),
                          (3, "c", at("09:30:00"))], writes) == {
        1: ("old",), 2: ("new",), 3: (None,)}


def test_other_keys_features_and_customers_without_writes(spark, at):
    writes = [("c", "f", "1", at("08:00:00"), 86400), ("c", "g", "2", at("08:00:01"), 86400),
              ("c", "h", "3", at("08:00:02"), 86400), ("d", "f", "4", at("08:00:00"), 86400)]
    requests = [(1, "c", at("09:00:00")), (2, "d", at("09:00:00")), (3, "e", at("09:00:00")),
                (4, None, at("09:00:00"))]
    assert lookup(spark, requests, writes, ("f", "g")) == {
        1: ("1", "2"), 2: ("4", None), 3: (None, None), 4: (None, None)}


def brute_force(requests, writes, names):
    found = {}
    for number, customer, moment in requests:
        values = []
        for name in names:
            seen = [(w, v, ttl) for c, f, v, w, ttl in writes
                    if c == customer and f == name and w <= moment]
            last = max(seen, default=None)
            live = last is not None and moment < last[0] + timedelta(seconds=last[2])
            values.append(last[1] if live else None)
        found[number] = tuple(values)
    return found


@pytest.mark.parametrize("slice_seconds", [1, 60, 900, 10 ** 7])
def test_lookup_equals_brute_force_on_a_skewed_store(spark, slice_seconds):
    draw = random.Random(slice_seconds)
    start = datetime(2024, 1, 15)

    def moment():
        return start + timedelta(seconds=draw.randrange(0, 7200))

    def customer():  # one customer holds half of all rows
        return "hot" if draw.random() < 0.5 else f"c{draw.randrange(20)}"

    requests = [(i, customer(), moment()) for i in range(600)]
    writes = [(customer(), draw.choice("fgh"), str(draw.randrange(1000)), moment(),
               draw.choice([30, 600, 3600])) for _ in range(900)]
    expected = brute_force(requests, writes, ("f", "g"))
    assert lookup(spark, requests, writes, ("f", "g"), slice_seconds=slice_seconds) == expected
    assert lookup(spark, requests, writes, ("f", "g"), slice_seconds=slice_seconds,
                  max_ttl_seconds=3600, requested_keys_only=True) == expected


def test_lookup_has_no_range_or_cross_join(spark, at):
    table = ft.lookup_features(
        spark.createDataFrame([(1, "c", at("10:00:00"))], REQUEST),
        spark.createDataFrame([("c", "f", "v", at("09:00:00"), 1)], WRITE), ["f"])
    text = table._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_writes_and_latest_values(spark, rows, at):
    wide = spark.createDataFrame(
        [("c", at("08:00:00"), 1, "x"), ("c", at("09:00:00"), 2, None),
         ("d", at("08:00:00"), 5, "y")],
        "customer_id string, written_at timestamp, n int, s string")
    writes = ft.feature_writes(wide, ["n", "s"])
    assert writes.count() == 6
    assert dict(writes.dtypes)["value"] == "string"
    assert rows(ft.latest_features(writes), "customer_id", "feature", "value", "ttl_s") == [
        ("c", "n", "2", 3600), ("c", "s", None, 3600), ("d", "n", "5", 3600),
        ("d", "s", "y", 3600)]
    at_half = ft.latest_features(writes, "2024-01-15 08:30:00")
    assert ("c", "n", "1") in rows(at_half, "customer_id", "feature", "value")
    at_ten = ft.latest_features(writes, "2024-01-15 10:00:00")  # a lifetime after the last
    assert rows(at_ten) == []


def test_sessions(spark, rows, at):
    events = spark.createDataFrame(
        [("s1", at("10:00:00"), "click"), ("s1", at("10:01:00"), "view"),
         ("s1", at("10:02:00"), "view"), ("s2", at("10:00:00"), "click"),
         (None, at("10:00:00"), "view")],
        "session_id string, timestamp timestamp, event_type string")
    sessions = ft.build_sessions(events)
    assert rows(sessions) == [("s1", at("10:00:00"), 2)]
    requests = spark.createDataFrame(
        [(1, "s1", at("2024-01-17 10:00:01")), (2, "s2", at("10:05:00")),
         (3, "", at("10:05:00")), (4, None, at("10:05:00"))],
        "request_id long, session_id string, timestamp timestamp")
    got = rows(ft.session_features(requests, sessions), "request_id", "session_duration",
               "page_views")
    # two days and a second: whole elapsed time, not the part of the last day
    assert got == [(1, 2 * 86400 + 1, 2), (2, 0, 0), (3, None, None), (4, None, None)]


@pytest.mark.parametrize("day,sunday_first,monday_first,weekend", [
    ("2024-01-13", 7, 5, 1), ("2024-01-14", 1, 6, 1), ("2024-01-15", 2, 0, 0),
    ("2024-01-19", 6, 4, 0)])
def test_day_encodings(spark, at, day, sunday_first, monday_first, weekend):
    table = spark.createDataFrame([(at(f"{day} 23:59:59"),)], "timestamp timestamp")
    event, request = ft.time_features(table).first(), ft.request_time_features(table).first()
    assert (event["hour_of_day"], event["day_of_week"], event["is_weekend"]) == (
        23, sunday_first, weekend)
    assert (request["day_of_week"], request["is_weekend"]) == (monday_first, weekend)


def test_context_before_request_before_unknown(spark, rows):
    table = spark.createDataFrame(
        [(1, {"channel": "web", "region": "A", "session_id": "s"}, "B", "b", "t"),
         (2, {}, "B", None, "t"), (3, None, None, "b", ""), (4, {"brand": "x"}, "B", "b", None)],
        "id long, channel_context map<string,string>, region string, brand string, "
        "session_id string")
    assert rows(ft.context_features(table), "id", "channel", "region", "brand",
                "session_id") == [
        (1, "web", "A", "b", "s"), (2, "unknown", "B", "unknown", "t"),
        (3, "unknown", "unknown", "b", None), (4, "unknown", "B", "x", None)]


def test_request_values_override_stored_ones(spark, rows):
    table = spark.createDataFrame(
        [(1, "web", 5, "app", "7"), (2, "web", None, "app", "2.5"), (3, "web", None, None, "?"),
         (4, None, None, "app", None)],
        "id long, channel string, page_views long, stored_channel string, "
        "stored_page_views string")
    merged = ft.merge_features(table, ("channel", "page_views", "absent"))
    assert rows(merged) == [(1, "web", 5.0, None), (2, "web", 2.5, None),
                            (3, "web", None, None), (4, "app", None, None)]
    only_stored = table.drop("page_views")
    assert rows(ft.merge_features(only_stored, ("page_views",)), "page_views")[0] == ("2.5",)


def test_vector_order_defaults_and_unknown_labels(spark):
    table = spark.createDataFrame([("b", 2, None), ("zzz", None, 1.5), (None, 0, 0.0)],
                                  "channel string, n int, x double")
    got = ft.feature_vector(table, {"channel": ["a", "b"]}, ("x", "channel", "n"))
    assert [r["features"] for r in got.collect()] == [
        [0.0, 2.0, 2.0], [1.5, 0.0, 0.0], [0.0, 0.0, 0.0]]


def test_labels_of_any_number_are_joined(spark):
    names = sorted(f"{chr(97 + i % 7)}{i}" for i in range(1500))
    table = spark.createDataFrame([(n,) for n in names * 2] + [(None,)], "x string").repartition(5)
    labels = lb.category_labels(table, "x")
    assert [tuple(r) for r in labels.orderBy("position").collect()] == [
        (n, i + 1) for i, n in enumerate(names)]
    asked = spark.createDataFrame([(1, names[1400]), (2, "other"), (3, None)],
                                  "id long, brand string")
    got = ft.feature_vector(asked, {"brand": labels}, ("brand",))
    assert got.columns == ["id", "brand", "features"]
    assert {r["id"]: r["features"] for r in got.collect()} == {1: [1401.0], 2: [0.0], 3: [0.0]}


def test_a_longer_lifetime_than_declared_is_refused(spark, at, tmp_path):
    write = ("c", "f", "v", at("10:00:00"), 7200)
    with pytest.raises(Exception, match="max_ttl_seconds"):
        lookup(spark, [(1, "c", at("10:30:00"))], [write], max_ttl_seconds=3600)
    assert lookup(spark, [(1, "c", at("10:30:00"))], [write], max_ttl_seconds=7200) == {1: ("v",)}
    with pytest.raises(Exception, match="max_ttl_seconds"):
        ft.append_features(spark.createDataFrame([write], WRITE), str(tmp_path / "s"), 3600)


def test_small_lookups_read_the_days_in_question(spark, at, tmp_path):
    path, started = str(tmp_path / "store"), str(tmp_path / "sessions")
    days = [datetime(2024, 1, day, 9) for day in range(1, 29)]
    ft.append_features(spark.createDataFrame(
        [("c", "f", str(d.day), d, 86400) for d in days], WRITE), path, 86400)
    ft.append_log(spark.createDataFrame(
        [(f"s{d.day}", d, d.day) for d in days],
        "session_id string, start_time timestamp, page_views long"), started, "start_time")
    asked = spark.createDataFrame(
        [(1, "c", datetime(2024, 1, 15, 10), "s15")], REQUEST + ", session_id string")
    found = ft.lookup_features(asked, spark.read.parquet(path), ("f",), max_ttl_seconds=86400,
                               requested_keys_only=True)
    assert found.first()["stored_f"] == "15"
    timed = ft.session_features(asked, spark.read.parquet(started), max_session_days=1)
    assert (timed.first()["session_duration"], timed.first()["page_views"]) == (3600, 15)
    for table in (found, timed):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(log_date" in plan and "log_date" in plan


def test_equal_values_at_one_instant_are_ordered_by_lifetime(spark, at):
    writes = [("c", "f", "v", at("10:00:00"), ttl) for ttl in (60, 7200)]
    for seconds in (1, 900, 10 ** 6):
        assert lookup(spark, [(1, "c", at("11:00:00"))], writes, slice_seconds=seconds) == {
            1: ("v",)}


def test_labels_with_one_beginning_are_numbered_by_ranges(spark):
    count = 100_000
    table = spark.range(count).select(F.format_string("Brand#%08d", "id").alias("x")).repartition(7)
    numbered = lb.category_labels(table, "x")
    wrong = numbered.filter(F.format_string("Brand#%08d", F.col("position") - 1) != F.col("label"))
    assert wrong.count() == 0 and numbered.count() == count
    sizes = [r["n"] for r in table.distinct().repartitionByRange(8, "x").groupBy(
        F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]  # what they are sorted by
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_codes_stay_when_labels_are_added(spark, rows, tmp_path):
    path = str(tmp_path / "labels")

    def table(*names):
        return spark.createDataFrame([(n,) for n in names], "x string")

    lb.save_labels(table("m", "c", None, "m"), "x", path, 1)
    lb.save_labels(table("z", "a", "c"), "x", path, 2)
    assert rows(lb.read_labels(spark, path, 1)) == [("c", 1), ("m", 2)]
    assert rows(lb.read_labels(spark, path, 2)) == [("a", 3), ("c", 1), ("m", 2), ("z", 4)]
    lb.save_labels(table().limit(0), "x", path, 3)
    assert rows(lb.read_labels(spark, path, 3)) == rows(lb.read_labels(spark, path, 2))
    lb.save_labels(table().limit(0), "x", str(tmp_path / "none"), 1)
    assert rows(lb.read_labels(spark, str(tmp_path / "none"), 1)) == []


def test_a_compacted_store_answers_like_all_writes(spark, rows, tmp_path):
    draw, path, base = random.Random(8), str(tmp_path / "store"), str(tmp_path / "base")

    def moment(first, last):
        return datetime(2024, 1, first) + timedelta(seconds=draw.randrange((last - first) * 86400))

    writes = spark.createDataFrame(
        [(draw.choice(["hot", "hot", "a", "b"]), draw.choice("fg"), draw.choice([None, "1", "2"]),
          moment(1, 12), draw.choice([600, 90_000, 900_000])) for _ in range(400)], WRITE)
    ft.append_features(writes, path, 900_000)
    ft.compact_features(spark, path, base, "2024-01-05")
    ft.compact_features(spark, path, base, "2024-01-09", "2024-01-05")
    ft.compact_features(spark, path, base, "2024-01-09", "2024-01-05")
    kept = ft.read_features(spark, path, base, "2024-01-09")
    closed = kept.filter("log_date < '2024-01-09'")
    assert closed.count() <= 6 < writes.filter("written_at < '2024-01-09'").count()
    asked = spark.createDataFrame([(i, draw.choice(["hot", "a", "b", "new"]), moment(9, 13))
                                   for i in range(200)]
                                  + [(999, "hot", datetime(2024, 1, 9))], REQUEST)
    for options in ({}, {"max_ttl_seconds": 900_000, "requested_keys_only": True}):
        assert rows(ft.lookup_features(asked, kept, ("f", "g"), **options)) == rows(
            ft.lookup_features(asked, writes, ("f", "g")))
    later = F.lit("2024-01-10 07:00:00").cast("timestamp")
    columns = ["customer_id", "feature", "value", "written_at", "ttl_s"]
    assert rows(ft.latest_features(kept, later), *columns) == rows(
        ft.latest_features(writes, later), *columns)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan
    with pytest.raises(Exception, match="a write before 2024-01-09"):
        ft.append_features(writes, path, 900_000, compacted_before="2024-01-09")

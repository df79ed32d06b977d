"""Streams against the same operators on tables."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from touchflow.functions.messages import parse_events
from touchflow.session import shared_folder
from touchflow.sources.streams import file_stream, to_files, write_batches, write_stream
from touchflow.operators.monitoring import alert_windows
from touchflow.plans import queries as plans
from touchflow.streaming import alerts as live
from touchflow.streaming.activity import read_windows, sliding_activity, start_sliding_activity
from touchflow.streaming.panes import read_late
from touchflow.streaming.recommendations import start_recommendations, start_reject_log

EVENTS = "customer_id string, channel string, timestamp timestamp"
RAW = "key string, value string, timestamp timestamp"
NOW = {"availableNow": True}


class Feed:
    """A folder that a file stream watches."""

    def __init__(self, spark, schema):
        self.spark, self.schema = spark, schema
        self.path = shared_folder(spark, "feed")

    def add(self, *records):
        (self.spark.createDataFrame(list(records), self.schema).coalesce(1)
         .write.mode("append").parquet(self.path))

    def stream(self, **options):
        return file_stream(self.spark, self.path, self.schema, **options)


def brute_force(events):
    found = {}
    for customer, channel, moment in events:
        minute = moment.replace(second=0, microsecond=0)
        for back in range(5):
            key = (minute - timedelta(minutes=back), customer)
            entry = found.setdefault(key, [0, [], moment])
            entry[0] += 1
            entry[1] += [channel] if channel is not None else []
            entry[2] = max(entry[2], moment)
    return {key: (n, sorted(used), last) for key, (n, used, last) in found.items()}


def shown(table):
    return {(r["window"]["start"], r["customer_id"]):
            (r["event_count"], list(r["channels_used"]), r["last_activity"])
            for r in table.collect()}


@pytest.fixture(scope="module")
def events():
    draw = random.Random(5)
    start = datetime(2024, 1, 15, 10)
    return [("hot" if draw.random() < 0.4 else f"c{draw.randrange(8)}",
             draw.choice(["web", "email", "fax", None]),
             start + timedelta(seconds=draw.randrange(0, 1800))) for _ in range(400)]


def test_batch_windows_equal_brute_force(spark, events):
    table = spark.createDataFrame(events, EVENTS)
    assert shown(sliding_activity(table, spell_out=True)) == brute_force(events)


@pytest.mark.parametrize("length,slide", [(5, 2), (5, 5), (6, 4), (120, 7)])
def test_any_window_and_slide(spark, events, length, slide):
    # times before 1970 too
    shifted = [(c, ch, t.replace(year=1969)) for c, ch, t in events[:50]]
    table = spark.createDataFrame(events + shifted, EVENTS)
    direct = table.groupBy(
        F.window("timestamp", f"{length} minutes", f"{slide} minutes"), "customer_id").count()
    expected = {(r["window"]["start"], r["customer_id"]): r["count"] for r in direct.collect()}
    got = {k: v[0] for k, v in shown(sliding_activity(table, length, slide, spell_out=True)).items()}
    assert got == expected


def test_channel_counts(spark, events):
    table = spark.createDataFrame(events, EVENTS)
    got = sliding_activity(table).collect()
    expected = brute_force(events)
    assert len(got) == len(expected)
    for row in got:
        used = expected[row["window"]["start"], row["customer_id"]][1]
        assert row["channel_counts"] == dict(Counter(used))


def test_no_step_collects_events(spark, events):
    plan = sliding_activity(spark.createDataFrame(events, EVENTS))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2  # panes, then customer and block
    first = text[text.rindex("Exchange hashpartitioning"):]
    assert "partial_count" in first and "collect_list" not in first


def test_stream_equals_batch_after_a_closing_record(spark, events):
    feed = Feed(spark, EVENTS)
    ordered = sorted(events, key=lambda e: e[2])
    path, checkpoint = shared_folder(spark, "sink"), shared_folder(spark, "checkpoint")

    def run():  # each run restarts from the checkpoint
        query = write_stream(sliding_activity(feed.stream(maxFilesPerTrigger=1),
                                              watermark="10 minutes", spell_out=True),
                             path, checkpoint, trigger=NOW)
        query.awaitTermination()

    for part in (ordered[:150], ordered[150:300], ordered[300:]):
        feed.add(*part)
        run()
    before = spark.read.parquet(path).count()
    feed.add(("closing", "web", datetime(2024, 1, 16)))
    run()
    sunk = spark.read.parquet(path).filter("customer_id <> 'closing'")
    expected = brute_force(events)
    assert before < len(expected)
    assert sunk.count() == len(expected)  # nothing twice
    assert shown(sunk) == expected


def test_late_rows_are_dropped(spark, at):
    feed = Feed(spark, EVENTS)
    path, checkpoint = shared_folder(spark, "sink"), shared_folder(spark, "checkpoint")
    batches = [("c", "web", at("10:00:00")), ("c", "web", at("11:00:00")),
               ("late", "web", at("10:00:30")), ("c", "web", at("10:52:00")),
               ("closing", "web", at("13:00:00"))]
    for record in batches:
        feed.add(record)
        write_stream(sliding_activity(feed.stream(), watermark="10 minutes", spell_out=True), path, checkpoint,
                     trigger=NOW).awaitTermination()
    got = shown(spark.read.parquet(path).filter("customer_id <> 'closing'"))
    assert got == brute_force([batches[0], batches[1], batches[3]])


def test_a_windowed_stream_needs_a_watermark(spark, at):
    feed = Feed(spark, EVENTS)
    feed.add(("c", "web", at("10:00:00")))
    with pytest.raises(Exception, match="watermark"):
        write_stream(sliding_activity(feed.stream()), shared_folder(spark, "sink"),
                     shared_folder(spark, "checkpoint"), trigger=NOW)


def test_parsed_stream_restarts_where_it_stopped(spark, rows, at):
    feed = Feed(spark, RAW)
    path, checkpoint = shared_folder(spark, "sink"), shared_folder(spark, "checkpoint")
    for i in range(3):
        feed.add(("k", json.dumps({"customer_id": f"c{i}"}), at("10:00:00")))
        write_stream(parse_events(feed.stream()), path, checkpoint,
                     trigger=NOW).awaitTermination()
    assert rows(spark.read.parquet(path), "customer_id") == [("c0",), ("c1",), ("c2",)]


def test_a_repeated_batch_replaces_its_rows(spark, rows, at):
    feed = Feed(spark, EVENTS)
    path, checkpoint = shared_folder(spark, "sink"), shared_folder(spark, "checkpoint")
    feed.add(("c1", "web", at("10:00:00")))
    failed = []

    def once(batch):  # fails after its rows are written
        if not failed:
            failed.append(1)
            to_files(path)(batch, batch, 0)
            raise ValueError("lost")
        return batch

    with pytest.raises(Exception, match="lost"):
        write_batches(feed.stream(), once, path, checkpoint, NOW).awaitTermination()
    write_batches(feed.stream(), once, path, checkpoint, NOW).awaitTermination()
    assert rows(spark.read.parquet(path), "customer_id", "batch_id") == [("c1", 0)]


def test_a_new_checkpoint_leaves_earlier_answers(spark, rows, at):
    feed = Feed(spark, EVENTS)
    path = shared_folder(spark, "sink")
    feed.add(("c1", "web", at("10:00:00")))
    for _ in range(2):
        write_batches(feed.stream(), lambda batch: batch, path,
                      shared_folder(spark, "checkpoint"), NOW).awaitTermination()
    found = spark.read.parquet(path)
    assert rows(found, "customer_id", "batch_id") == [("c1", 0), ("c1", 0)]
    assert found.select("run_id").distinct().count() == 2


LOG = "latency_ms double, recommended_action string, timestamp timestamp"
BEAT = "timestamp timestamp"


class Service:
    """A live log with a heartbeat, its alerts, and what has come so far."""

    def __init__(self, spark):
        self.spark, self.log, self.beat, self.came = spark, Feed(spark, LOG), Feed(spark, BEAT), []
        self.path, self.checkpoint = (shared_folder(spark, n) for n in ("alerts", "checkpoint"))

    def run(self, *records, beat=None):
        if records:
            self.log.add(*records)
            self.came += records
        if beat is not None:
            self.beat.add((beat,))
        live.start_alerts(self.log.stream(), self.path, 1, self.checkpoint, NOW,
                          self.beat.stream()).awaitTermination()

    def raised(self):
        return {(r["timestamp"], r["type"], r["message"])
                for r in live.read_alerts(self.spark, self.path).collect()}


def low_volume(service, first, until):
    """Ends of the silent or thin ranges up to ``until``, by counting."""
    found, end = {}, first
    while (end := end + timedelta(minutes=1)) <= until:
        n = sum(end - timedelta(minutes=5) <= r[2] < end for r in service.came)
        if n < 10:
            found[end] = n
    return found


def test_lasting_silence_raises_alerts_without_a_later_request(spark, at):
    service = Service(spark)
    service.beat.add((at("10:00:00"),))
    service.run(*[(1.0, "a", at("10:00:30"))] * 12)
    for minute in (4, 8, 13):  # nothing comes after 10:00
        service.run(beat=at(f"10:{minute:02d}:30"))
        ends = {end for end, _, _ in service.raised()}
        assert ends == set(low_volume(service, at("10:00:00"), at(f"10:{minute - 1:02d}:00")))
    assert at("10:12:00") in ends


def test_a_late_request_changes_the_alerts_of_its_ranges(spark, at):
    service = Service(spark)
    service.beat.add((at("10:00:00"),))
    service.run(*[(1.0, "a", at("10:00:30"))] * 12)
    service.run(beat=at("10:20:30"))
    service.run(*[(1.0, "a", at("10:07:10"))] * 9, (3000.0, "b", at("10:07:20")))
    service.run((1.0, "a", at("09:58:00")), beat=at("10:21:30"))  # before the first of all
    first, until = at("09:58:00"), at("10:20:00")
    assert {(end, n) for end, kind, n in service.raised() if kind == "low_volume"} == {
        (end, f"Low request volume: {n} requests")
        for end, n in low_volume(service, first, until).items()}
    table = spark.createDataFrame(service.came, LOG)
    batch = {(r["timestamp"], r["type"], r["message"]) for r in alert_windows(table).collect()}
    reach = max(r[2] for r in service.came) + timedelta(minutes=5)
    assert {r for r in service.raised() if r[0] <= reach} == {r for r in batch if r[0] <= reach}
    late = read_late(spark, service.path).select("missed", "latency_ms").collect()
    assert len(late) == 11 and {r["missed"] for r in late} == {at("10:07:00"), at("09:58:00")}


def test_alerts_read_the_minutes_of_their_ranges_only(spark, at, monkeypatch):
    service, read = Service(spark), []
    service.beat.add((at("2024-01-01 10:00:00"),))
    service.run(*[(1.0, "a", at("2024-01-01 10:00:30"))] * 12)
    kept = live.read_panes
    monkeypatch.setattr(live, "read_panes", lambda *a, since=None, until=None, **b: (
        read.append((until - since) // 60_000_000), kept(*a, since=since, until=until, **b))[1])
    for hour in range(11, 14):
        service.run(beat=at(f"2024-01-01 {hour}:00:00"))
    assert len(read) == 3 and max(read) <= 60 + 4


def test_late_events_change_their_windows(spark, events):
    feed, path, checkpoint = Feed(spark, EVENTS), *(shared_folder(spark, n) for n in "ab")
    beat = Feed(spark, BEAT)
    beat.add((datetime(2024, 1, 15, 9),))

    def run():
        start_sliding_activity(feed.stream(), path, 10, checkpoint, NOW, beat.stream(),
                               spell_out=True).awaitTermination()

    draw = random.Random(3)
    mixed = draw.sample(events, len(events))
    for part in (mixed[:150], mixed[150:300], mixed[300:], [("c1", "web", datetime(2024, 1, 12))]):
        feed.add(*part)
        run()
    beat.add((datetime(2024, 1, 16),))
    run()
    got = read_windows(spark, path)
    assert shown(got) == brute_force([*events, ("c1", "web", datetime(2024, 1, 12))])
    assert got.count() == len(shown(got))
    on_time_only = len(events) + 1 - read_late(spark, path).count()
    assert 0 < on_time_only < len(events)


STREAMS = ("parse_events", "sliding_activity", "requests_per_minute", "action_distribution",
           "alert_windows", "rejected_requests", "request_log", "session_table", "feature_lookup")


@pytest.fixture(scope="module")
def in_parts(spark, tmp_path_factory):
    """The given tables with the events as a folder of part files."""
    folder = tmp_path_factory.mktemp("parts")
    for file in Path("/root/testdata/sf0.001").iterdir():
        if file.stem != "events":
            (folder / file.name).symlink_to(file)
    (spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3, "event_id")
     .write.parquet(str(folder / "events.parquet")))
    return str(folder)


@pytest.mark.parametrize("name", [f"{n}_stream" for n in STREAMS]
                         + ["recommendations_stream", "experiment_log_stream"])
def test_streams_read_parts_out_of_order_like_a_file(spark, rows, in_parts, name, monkeypatch):
    """Part files dealt by a hash, so each spans all times, and a micro-batch for each."""
    run = contract.queries()[name]
    whole = rows(run(spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(plans, "STREAM_BYTES", 1)
    assert whole and rows(run(spark, in_parts)) == whole


def test_a_stream_that_reads_nothing_is_an_error(spark, in_parts, tmp_path):
    spark.read.parquet(f"{in_parts}/events.parquet").limit(0).write.parquet(
        str(tmp_path / "events.parquet"))
    with pytest.raises(RuntimeError, match="read nothing"):
        contract.queries()["parse_events_stream"](spark, str(tmp_path))


def test_requests_to_responses(spark, rows, at):
    feed = Feed(spark, RAW)
    feed.add(("k1", json.dumps({"customer_id": "c1", "channel_context": {"channel": "web"}}),
              at("10:00:00")), ("k2", "{broken", at("10:00:01")))

    def answer(requests):
        return requests.select(
            "customer_id", F.lit("no_action").alias("recommended_action"),
            F.try_element_at("channel_context", F.lit("channel")).alias("channel"),
            F.lit(0.5).alias("confidence_score"), "timestamp",
            F.lit("1").alias("model_version"), F.lit("A").alias("ab_test_group"))

    path, rejected = shared_folder(spark, "sink"), shared_folder(spark, "sink")
    start_recommendations(feed.stream(), answer, path, shared_folder(spark, "checkpoint"),
                          NOW).awaitTermination()
    start_reject_log(feed.stream(), rejected, shared_folder(spark, "checkpoint"),
                     NOW).awaitTermination()
    sent = spark.read.parquet(path).collect()
    assert [r["key"] for r in sent] == ["c1"]
    assert json.loads(sent[0]["value"])["channel"] == "web"
    assert rows(spark.read.parquet(rejected), "value", "reason") == [("{broken", "not JSON")]

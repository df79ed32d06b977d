"""Feature state and sessions of streams against the same operators on tables."""

import random
from datetime import datetime, timedelta

import pytest
from test_streaming import BEAT, NOW, Feed

from touchflow.operators.features import build_sessions, lookup_features
from touchflow.session import shared_folder
from touchflow.sources.streams import write_stream
from touchflow.streaming.lookups import lookup_features_stream
from touchflow.streaming.sessions import read_sessions, start_sessions

WRITES = "customer_id string, written_at timestamp, feature string, value string, ttl_s long"
REQUESTS = "request_id long, customer_id string, timestamp timestamp, context map<string,string>"
EVENTS = "session_id string, event_type string, timestamp timestamp"
START = datetime(2024, 1, 15, 10)


class Store:
    """A stream of writes and requests with its answers."""

    def __init__(self, spark, delay):
        self.spark, self.delay = spark, delay
        self.writes, self.requests = Feed(spark, WRITES), Feed(spark, REQUESTS)
        self.beat = Feed(spark, BEAT)
        self.path, self.checkpoint = (shared_folder(spark, n) for n in ("answers", "checkpoint"))
        for feed, schema in ((self.writes, WRITES), (self.requests, REQUESTS), (self.beat, BEAT)):
            spark.createDataFrame([], schema).write.parquet(feed.path)

    def answers(self):
        return lookup_features_stream(self.requests.stream(), self.writes.stream(), ["a", "b"],
                                      self.delay, self.beat.stream())

    def run(self, writes=(), requests=(), beat=None):
        for feed, records in ((self.writes, writes), (self.requests, requests),
                              (self.beat, [(beat,)] if beat else ())):
            if records:
                feed.add(*records)
        query = write_stream(self.answers(), self.path, self.checkpoint, trigger=NOW)
        query.awaitTermination()
        return [state.numRowsTotal for state in query.lastProgress.stateOperators]

    def got(self):
        return sorted(map(tuple, self.spark.read.parquet(self.path).collect()), key=repr)


def drawn(seed, writes, requests):
    draw = random.Random(seed)

    def customer():
        return "hot" if draw.random() < 0.4 else draw.choice(["c1", "c2", "c3", None])

    def moment():
        return START + timedelta(seconds=draw.randrange(3600))

    return ([(customer(), moment(), draw.choice("abz"), draw.choice([None, "1", "2"]),
              draw.choice([0, 60, 600, 5000])) for _ in range(writes)],
            [(i, customer(), moment(), {"k": str(i)} if i % 3 else None) for i in range(requests)])


def expected(spark, writes, requests):
    found = lookup_features(spark.createDataFrame(requests, REQUESTS),
                            spark.createDataFrame(writes, WRITES), ["a", "b"])
    return sorted(map(tuple, found.collect()), key=repr)


def test_lookup_equals_the_table_in_any_order(spark):
    writes, requests = drawn(1, 300, 200)
    store = Store(spark, "2 hours")
    for part in range(2):
        store.run(writes[part::2], requests[part::2])
    assert store.got() == []  # the delay has not passed
    store.run(beat=START + timedelta(hours=3, seconds=1))
    keyed = [w for w in writes if w[0] is not None]
    assert store.got() == expected(spark, keyed, requests)


def test_answers_come_within_the_delay_and_the_state_is_forgotten(spark):
    store = Store(spark, "1 minute")
    store.run([("c", START, "a", "1", 60), ("quiet", START, "a", "9", 30)])
    full = store.run(requests=[(1, "c", START + timedelta(seconds=30), None),
                               (2, "c", START + timedelta(seconds=90), None)])
    store.run([("c", START + timedelta(seconds=20), "a", "2", 60)],
              beat=START + timedelta(seconds=95))
    assert [(r[0], r[4]) for r in store.got()] == [(1, "2")]
    store.run(beat=START + timedelta(minutes=9))
    assert [(r[0], r[4]) for r in store.got()] == [(1, "2"), (2, None)]
    # A request behind the watermark is answered from what is still known.
    left = store.run(requests=[(3, "c", START + timedelta(seconds=40), None)])
    assert [(r[0], r[4]) for r in store.got()] == [(1, "2"), (2, None), (3, None)]
    assert sum(left) < sum(full)


def test_no_store_is_scanned(spark):
    plan = Store(spark, "1 minute").answers()._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" in plan and plan.count("StreamingRelation") == 3
    assert plan.replace("LocalRelation <empty>", "").count("Relation") == 3 and "Join" not in plan


def test_sessions_equal_the_table_in_any_order(spark, rows):
    draw = random.Random(2)
    events = [(draw.choice([None, *(f"s{i}" for i in range(30))]), draw.choice(["view", "click"]),
               START + timedelta(minutes=draw.randrange(900))) for _ in range(400)]
    events += [("clicks only", "click", START)] * 3
    feed, beat = Feed(spark, EVENTS), Feed(spark, BEAT)
    beat.add((START - timedelta(days=1),))
    path, checkpoint = (shared_folder(spark, n) for n in ("sessions", "checkpoint"))

    def run():
        start_sessions(feed.stream(), path, 10, checkpoint, NOW, beat.stream()).awaitTermination()

    for part in (events[:150], events[150:300], events[300:]):
        feed.add(*part)
        run()
    beat.add((START + timedelta(days=1),))
    run()
    table = build_sessions(spark.createDataFrame(events, EVENTS))
    columns = ["session_id", "start_time", "page_views"]
    found = read_sessions(spark, path)
    assert rows(found, *columns) == rows(table, *columns)
    assert rows(found.selectExpr("log_date = to_date(start_time) AS same").distinct()) == [(True,)]

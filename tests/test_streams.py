"""Streams: order by event time, late events, whole records, incremental documents, archives."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import Row

from quarterlight.queries.streams import latest_features
from quarterlight.streaming import events as stream

EVENT = "entity long, event_id string, as_of timestamp, hike double, hold double, cut double"


def at(minute: int) -> datetime.datetime:
    return datetime.datetime(2024, 3, 5, 10) + datetime.timedelta(minutes=minute)


def event(entity, name, minute, hike=None):
    return (entity, name, at(minute), hike, None if hike is None else 0.5, None if hike is None else 0.1)


def run(spark, tmp_path, arrivals, watermark):
    path, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    after = []
    for rows in arrivals:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)
        stream.run_available(stream.rolling_predictions(spark.readStream.schema(EVENT).parquet(path), watermark), stream.archive(out), check)
        after.append({r.event_id: (r.entity, r.hike, r.carried) for r in spark.read.parquet(out).collect()})
    return after


def test_a_late_event_changes_what_follows_it(spark, tmp_path):
    first = [event(1, "a", 0, 0.3), event(1, "c", 20), event(1, "d", 30, 0.7), event(1, "e", 40), event(2, "x", 35)]
    late = [event(1, "b", 10, 0.9), event(2, "w", 34, 0.4)]
    after = run(spark, tmp_path, [first, late, [(None, None, at(300), None, None, None)]], "1 hour")
    assert after[0] == {} == after[1]  # nothing is let through before its time is over
    assert after[2] == {"a": (1, 0.3, False), "b": (1, 0.9, False), "c": (1, 0.9, True), "d": (1, 0.7, False), "e": (1, 0.7, True), "w": (2, 0.4, False), "x": (2, 0.4, True)}


def test_an_event_behind_the_watermark_is_dropped_and_the_past_stays(spark, tmp_path):
    tick = [(None, None, at(200), None, None, None)]
    after = run(spark, tmp_path, [[event(1, "a", 0), event(1, "b", 10, 0.6)], tick, [event(1, "late", 5, 0.9), event(1, "c", 250)], [(None, None, at(500), None, None, None)]], "30 minutes")
    assert after[1] == {"a": (1, 0.2, True), "b": (1, 0.6, False)}
    assert after[3] == {**after[1], "c": (1, 0.6, True)}


def test_whole_record_of_an_event(spark):
    predictions = spark.createDataFrame([(1, "a", at(0), 0.3, 0.5, 0.1, False), (1, "b", at(3000), 0.3, 0.5, 0.1, True), (2, "c", at(0), 0.2, 0.65, 0.15, True)], stream.PREDICTION)
    features = spark.createDataFrame([(1, at(-90), 9.0, 0.0, 0.0, 0.0), (1, at(-60), 0.8, 0.9, 0.1, None)], "entity long, at timestamp, ect double, hawkish double, energy double, other double")
    got = {r.event_id: r for r in stream.handled(predictions, features, ["ect", "hawkish", "energy", "other"], top=2).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert a.fresh and not b.fresh and not c.fresh
    assert a.evidence == ["above long-run equilibrium", "hawkish text"] and c.evidence == ["no rule applies"]
    assert [tuple(x) for x in a.risk.top_signals] == [("hawkish", 0.9), ("ect", 0.8)] and c.risk.top_signals == []
    assert a.risk.evidence_count == 2 and a.risk.method == "predictive_attribution"


def test_documents_are_stored_once_and_counted(spark, tmp_path):
    arriving, store, check = f"{tmp_path}/arriving", f"{tmp_path}/store", f"{tmp_path}/check"
    sink = stream.incremental_documents(store, "hash", buckets=4)
    assert stream.stored_documents(spark, store) is None
    schema = "doc_id long, hash string"
    for rows in ([(1, "a"), (2, "a"), (3, "b"), (8, None)], [(4, "b"), (5, "c"), (9, None)], [(6, "a"), (7, "c")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(arriving)
        stream.run_available(spark.readStream.schema(schema).parquet(arriving), sink, check)
    counts = lambda: sorted(tuple(r) for r in stream.fetch_counts(spark, store).collect())
    held = lambda: sorted(((r.batch, r.hash) for r in stream.stored_documents(spark, store).collect()), key=str)
    want = [(0, 4, 3, 1), (1, 3, 2, 1), (2, 2, 0, 2)]
    assert counts() == want and held() == [(0, "a"), (0, "b"), (0, None), (1, "c"), (1, None)]
    sink(spark.createDataFrame([(4, "b"), (5, "c"), (9, None)], schema), 1)  # a replay
    assert counts() == want and held() == [(0, "a"), (0, "b"), (0, None), (1, "c"), (1, None)]


@pytest.mark.parametrize("missing", ["entity", "as_of"])
def test_rows_without_entity_or_time(spark, tmp_path, missing):
    row = event(None, "a", 0, 0.4) if missing == "entity" else (1, "a", None, 0.4, 0.5, 0.1)
    after = run(spark, tmp_path, [[row, event(2, "b", 1)], [(None, None, at(500), None, None, None)]], "1 hour")
    assert after[1]["b"] == (2, 0.2, True)
    assert (after[1].get("a") == (None, 0.4, False)) == (missing == "entity")


class Told:
    """A state of one entity that counts the messages to it."""

    def __init__(self):
        self.calls, self.lists, self.value, self.timers = 0, [], None, set()

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("getListState", "getValueState"):
                return View(self, name)
            return {"registerTimer": self.timers.add, "deleteTimer": self.timers.remove}[name](*args)

        return call


class View:
    def __init__(self, told, kind):
        self.told, self.kind = told, kind

    def __getattr__(self, name):
        def call(*args):
            t = self.told
            t.calls += 1
            if self.kind == "getValueState":
                if name == "update":
                    t.value = args[0]
                return t.value
            if name == "appendValue":
                t.lists.append(args[0])
            elif name in ("put", "clear"):
                t.lists = list(args[0]) if args else []
            return iter(list(t.lists))

        return call


def test_messages_to_the_state_dont_grow_with_the_events(monkeypatch):
    """Two arrivals of an entity, and the watermark passing in two steps: one timer at a time, and all events let through by time and id."""
    told, processor = Told(), stream._InOrder()
    processor.init(told)
    arrive = lambda ids: processor.handleInputRows((1,), iter([Row(event_id=f"{i:04d}", at=i * 1_000_000, hike=0.1 if i % 10 == 0 else None, hold=0.5, cut=float("nan") if i % 20 == 0 else 0.2) for i in ids]), None)
    out, told.calls = [], 0
    for ids in (range(500, 1000), range(0, 500)):
        out += arrive(ids)
        assert len(told.timers) == 1
    assert told.timers == {0} and told.calls <= 10 and not out
    for watermark in (700_500, 10**9):
        due = min(told.timers)
        out += processor.handleExpiredTimer((1,), type("Now", (), {"getCurrentWatermarkInMs": lambda self, w=watermark: w})(), None)
        told.timers.discard(due)
        assert told.timers == ({701_000} if watermark == 700_500 else set())
    assert [r.event_id for r in out] == [f"{i:04d}" for i in range(1000)] and told.lists == [] and told.calls <= 20
    assert [r.carried for r in out] == [i % 20 != 10 for i in range(1000)] and [r.hike for r in out[:11]] == [0.2] * 10 + [0.1]


def test_tied_features_are_the_first_events(spark, tmp_path):
    rows = [(i, datetime.datetime(2024, 1, 5), 1, "view", 60.0) for i in (38, 4, 12, 26, 8)] + [(2, datetime.datetime(2024, 1, 4), 1, "view", 70.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    got = stream.latest(latest_features(spark, str(tmp_path))).collect()
    assert [(r.entity, r.hawkish, r.other) for r in got] == [(1, 0.4, pytest.approx(4 / 13 - 0.5))]

"""Keyed state of usage edges: upserts, repeated batches, late and repeated events."""

import datetime as dt

from reuselake.streaming.ledger import EdgeLedger

SCHEMA = "event_id long, event_ts timestamp, consumer_key string, artifact_fqn string, usage_type string"


def event(i, day, hour=0, who="a"):
    return (i, None if day is None else dt.datetime(2024, 1, day, hour), who, "x", "canonical")


def counts(df):
    return sorted((r.consumer_key, r.day.day, r.events, r.first_seen.hour, r.last_seen.hour) for r in df.collect())


def test_late_and_repeated_events(spark, tmp_path):
    ledger = EdgeLedger(spark, tmp_path.as_uri(), buckets=4)
    batches = [
        [event(1, 1, 3), event(1, 1, 3), event(2, 1, 5), event(None, 1, 6), event(None, 1, 7), event(3, None)],
        [event(1, 1, 3), event(4, 2), event(5, 2, 9, "b")],  # 1 again, in time
        [event(6, 9)],
        [event(2, 1, 5), event(7, 1, 1), event(7, 1, 1), event(8, 2, 2, "b"), event(None, 2, 4), event(9, 8)],  # behind the 7th, but for 9
        [],
    ]
    for k, rows in enumerate(batches):
        ledger.add(spark.createDataFrame(rows, SCHEMA), k)
        if k == 2:
            for again in (2, 1, 2):  # a batch that runs again replaces itself; what came later is not lost
                ledger.add(spark.createDataFrame(batches[again], SCHEMA), again)
    assert counts(ledger.edges()) == [("a", 1, 4, 3, 7), ("a", 2, 1, 0, 0), ("a", 8, 1, 0, 0), ("a", 9, 1, 0, 0), ("b", 2, 1, 9, 9)]
    assert sorted((r.batch_id, r.event_id or 0) for r in ledger.late().collect()) == [(0, 3), (3, 0), (3, 2), (3, 7), (3, 7), (3, 8)]
    assert counts(ledger.settled()) == [("a", 1, 5, 1, 7), ("a", 2, 2, 0, 4), ("a", 8, 1, 0, 0), ("a", 9, 1, 0, 0), ("b", 2, 2, 2, 9)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    ledger = EdgeLedger(spark, tmp_path.as_uri(), buckets=8)
    ledger.add(spark.createDataFrame([event(i, 1, who=f"u{i}") for i in range(40)], SCHEMA), 0)
    before = ledger._current()
    ledger.add(spark.createDataFrame([event(99, 1, who="u3")], SCHEMA), 1)
    after = ledger._current()
    assert len(before) == 8 and sum(before[b] != after[b] for b in after) == 1
    assert sum(r.events for r in ledger.edges().collect()) == 41


def test_nothing_yet(spark, tmp_path):
    ledger = EdgeLedger(spark, (tmp_path / "none").as_uri())
    assert ledger.edges().count() == 0 and ledger.late().count() == 0 and ledger.settled().count() == 0

"""Keyed state of the queue: any split of the events gives what the batch queries give."""

import datetime
import random

import pytest
from pyspark.sql import Row

from conftest import rows_of
from palimpsest.operators import ledger
from palimpsest.streaming import states

EVENTS = "event_id long, ts timestamp, family_id long, state string"
T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def stream(spark, folder):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))


def agree(spark, table, events):
    plain = lambda df: rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert plain(states.attempt_history(spark, table)) == plain(ledger.attempts(events))
    assert plain(states.family_states(spark, table)) == plain(ledger.recovery(events))


def put(spark, rows, folder, k):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/{k}")
    for f in (folder / str(k)).glob("part*"):
        f.rename(folder / f"{k:03d}-{f.name}")


@pytest.mark.parametrize("seed", [1, 2])
def test_random_splits_give_the_batch_rows(spark, tmp_path, seed):
    """Events in any order over several files, with a restart in the middle; the last event moves the clock on, so all timers fire."""
    some = random.Random(seed)
    rows = [(i, T0 + datetime.timedelta(seconds=some.randint(0, 500)), some.randint(1, 9), some.choice(["PENDING", "INFLIGHT", "COMPLETE", "FAILED"])) for i in range(120)]
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    parts = [rows[i::6] for i in range(6)]
    for k in range(3):
        put(spark, parts[k], folder, k)
    states.follow(spark, stream(spark, folder), table, delay="1000 seconds", stale_after_s=600)
    for k in range(3, 6):
        put(spark, parts[k], folder, k)
    clock = (999, T0 + datetime.timedelta(days=1), 0, "COMPLETE")
    put(spark, [clock], folder, 7)
    states.follow(spark, stream(spark, folder), table, delay="1000 seconds", stale_after_s=600)
    agree(spark, table, spark.createDataFrame([*rows, clock], EVENTS))


def test_settled_events_are_folded_and_timers_fire_once_only(spark, tmp_path):
    """In order with a short delay: prefixes are folded away. What is in flight again in time is not taken back."""
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    rows = [(1, at(0), 1, "PENDING"), (2, at(10), 1, "INFLIGHT"), (3, at(10), 2, "INFLIGHT"), (4, at(60), 1, "COMPLETE"), (5, at(90), 2, "INFLIGHT"), (6, at(130), 3, "PENDING"), (7, at(150), 1, "PENDING"), (8, at(300), 3, "COMPLETE")]
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    for k, r in enumerate(rows[:6]):
        put(spark, [r], folder, k)
    states.follow(spark, stream(spark, folder), table, delay="5 seconds", stale_after_s=100)
    now = {r["family_id"]: (r["state"], r["retries"], r["stale_recovered"]) for r in states.family_states(spark, table).collect()}
    assert now == {1: ("COMPLETE", 1, 0), 2: ("INFLIGHT", 2, 0), 3: ("PENDING", 0, 0)}
    for k, r in enumerate(rows[6:], 6):
        put(spark, [r], folder, k)
    put(spark, [(9, at(1), 1, "FAILED"), (10, at(301), 3, None)], folder, 9)  # too late, and no transition
    states.follow(spark, stream(spark, folder), table, delay="5 seconds", stale_after_s=100)
    agree(spark, table, spark.createDataFrame(rows, EVENTS))


def test_a_family_is_read_and_written_once_a_batch():
    """One value of state a family and no table per family: calls to the store and to pandas were most of the time."""
    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, name, schema):
            calls.append("state")
            return Value()

        def registerTimer(self, at):
            calls.append("timer")

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 1

    own = states.FamilyStates(1000)
    own.init(Handle())
    event = Row("us", "event_id", "state")
    got = list(own.handleInputRows((7,), iter([event(5000, 2, "INFLIGHT"), event(900, 1, "PENDING"), event(9000, 3, "COMPLETE"), event(9500, 4, "PENDING")]), Clock()))
    assert [tuple(r) for r in got] == [(7, 0, 0, "RUNNING", "PENDING", 1, 0, 1), (7, 1, 3, "COMPLETED", "PENDING", 1, 0, 1), (7, 2, 1, "PAUSED", "PENDING", 1, 0, 1)]
    assert calls == ["state", "get", "update"]
    assert own.held.held == (900, "PENDING", 1, 1, 0, 1, -1, [5000, 9000, 9500], [2, 3, 4], ["INFLIGHT", "COMPLETE", "PENDING"])

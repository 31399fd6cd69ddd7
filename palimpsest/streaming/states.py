"""The queue's state machine as keyed state of a stream.

Transitions come in any order within the delay that the watermark allows. Of each family the stream
holds a folded prefix of constant size, the few events that are not yet below the watermark, and one
timer. Families in flight for too long go back to pending when their timer fires.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ENDS = {"COMPLETE": "COMPLETED", "FAILED": "FAILED", "PENDING": "PAUSED"}

#: What stands of a family: its last state, attempts begun, events of the open one, times in flight; and the
#: events that are not yet below the watermark. One value, so a batch reads and writes it once for a family.
HELD = "last_us long, state string, attempt long, n_events long, retries long, version long, timer long, open_us array<long>, open_ids array<long>, open_states array<string>"
NEW = (0, None, 0, 0, 0, 0, -1, [], [], [])
#: A row per attempt that a batch touched; the greatest version of a family, and of an attempt, is the one that counts.
CHANGE = "attempt long, n_events long, status string, state string, retries long, stale_recovered int, version long"
_Change = Row("family_id", *(c.split()[0] for c in CHANGE.split(", ")))


class FamilyStates(StatefulProcessor):
    def __init__(self, stale_after_ms: int) -> None:
        self.stale_after_ms = stale_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last_us, state, attempt, n, retries, version, timer, *open_ = self.held.get() or NEW
        events = list(zip(*open_, strict=True))
        fields = None
        for row in rows:
            if fields is None:
                fields = operator.itemgetter(*(row.__fields__.index(c) for c in ("us", "event_id", "state")))
            events.append(fields(row))
        events.sort()
        settled = timerValues.getCurrentWatermarkInMs() * 1000  # nothing at or before this comes any more
        kept = None
        # What came before the first pending one may turn out to be nothing when an earlier event comes late.
        changes: dict[int, tuple[int, str]] = {0: (0, "RUNNING")} if attempt == n == 0 else {}
        for i, (us, _, now) in enumerate(events):
            if us > settled and kept is None:
                kept = (i, (last_us, state, attempt, n, retries))
            attempt, n = (attempt + 1, 1) if now == "PENDING" else (attempt, n + 1)
            last_us, state, retries = us, now, retries + (now == "INFLIGHT")
            changes[attempt] = (n, ENDS.get(now, "RUNNING"))
        first, base = kept if kept is not None else (len(events), (last_us, state, attempt, n, retries))
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = last_us // 1000 + self.stale_after_ms if state == "INFLIGHT" else -1
        if timer >= 0:
            self.handle.registerTimer(timer)
        self.held.update((*base, version + 1, timer, *([e[i] for e in events[first:]] for i in range(3))))
        yield from self._changes(key, changes, state, retries, 0, version + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        *base, version, timer, us, ids, states = self.held.get()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        _, state, attempt, n, retries = base
        for _, _, now in sorted(zip(us, ids, states, strict=True)):
            attempt, n = (attempt + 1, 1) if now == "PENDING" else (attempt, n + 1)
            state, retries = now, retries + (now == "INFLIGHT")
        self.held.update((*base, version + 1, -1, us, ids, states))
        if state == "INFLIGHT":
            yield from self._changes(key, {attempt: (n, "RUNNING")}, "PENDING", retries, 1, version + 1)

    @staticmethod
    def _changes(key, changes: dict[int, tuple[int, str]], state: str, retries: int, stale: int, version: int) -> Iterator[Row]:
        for a, (n, status) in sorted(changes.items()):
            yield _Change(*key, a, n, status, state, retries, stale, version)

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs this store; a query takes the setting over when it starts."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)


def changes(events: DataFrame, *, delay: str = "1 hour", stale_after_s: float = 3600.0) -> DataFrame:
    """A stream of transitions (family_id, ts, event_id, state) to a stream of CHANGE rows by family.

    Events that come later than `delay` behind the greatest ts seen are dropped, as by any watermark; null
    states are no transitions. A family in flight for stale_after_s of event time is pending again.
    """
    moves = events.where("state IS NOT NULL AND family_id IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    kind = events.schema["family_id"].dataType.simpleString()
    keyed = moves.select("family_id", "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), "state").groupBy("family_id")
    return keyed.transformWithState(FamilyStates(int(stale_after_s * 1000)), f"family_id {kind}, {CHANGE}", "Update", "EventTime")


def follow(spark: SparkSession, events: DataFrame, table: str, *, delay: str = "1 hour", stale_after_s: float = 3600.0) -> None:
    """Take in all events that are there now and keep what changed below `table`; called again, it goes on where it ended.

    A batch overwrites its own folder when it is replayed.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/changes/batch_no={number:09d}")

    with _rocks(spark):
        query = changes(events, delay=delay, stale_after_s=stale_after_s).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{table}/stream").trigger(availableNow=True).start()
    query.awaitTermination()


def _changes(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(f"{table}/changes")


def family_states(spark: SparkSession, table: str) -> DataFrame:
    """Where each family stands: state, retries, and whether it was taken back from flight."""
    last = _changes(spark, table).groupBy("family_id").agg(F.max_by(F.struct("state", "retries", "stale_recovered"), "version").alias("_r"))
    return last.select("family_id", "_r.*")


def attempt_history(spark: SparkSession, table: str) -> DataFrame:
    """Attempts of each family with their events and ends."""
    last = _changes(spark, table).groupBy("family_id", "attempt").agg(F.max_by(F.struct("n_events", "status"), "version").alias("_r"))
    return last.select("family_id", "attempt", "_r.*").where("n_events > 0")

"""The run ledger as an event log: state, progress, recovery, attempts, heartbeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_state(events: DataFrame) -> DataFrame:
    """The last transition of each family by (ts, event_id)."""
    return events.groupBy("family_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"))


def progress(states: DataFrame) -> DataFrame:
    """Families by state; zeros for an empty queue."""
    return states.agg(*[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("PENDING", "INFLIGHT", "COMPLETE", "FAILED")])


def pending(families: DataFrame, states: DataFrame) -> DataFrame:
    """Families that are not complete; those without an event are pending too."""
    return families.join(states.where("state = 'COMPLETE'"), "family_id", "left_anti")


def recovery(events: DataFrame) -> DataFrame:
    """Families whose last state is INFLIGHT go back to PENDING; retries count their INFLIGHT events."""
    s = events.groupBy("family_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.count_if(F.col("state") == "INFLIGHT").alias("retries"))
    stale = F.col("state") == "INFLIGHT"
    return s.select("family_id", F.when(stale, "PENDING").otherwise(F.col("state")).alias("state"), "retries", stale.cast("int").alias("stale_recovered"))


def attempts(events: DataFrame) -> DataFrame:
    """An attempt runs from a PENDING event to the next; its end is its last state."""
    at = Window.partitionBy("family_id").orderBy("ts", "event_id")
    n = events.withColumn("attempt", F.sum((F.col("state") == "PENDING").cast("int")).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by("state", F.struct("ts", "event_id"))
    ends = F.when(last == "COMPLETE", "COMPLETED").when(last == "FAILED", "FAILED").when(last == "PENDING", "PAUSED").otherwise("RUNNING")
    return n.groupBy("family_id", "attempt").agg(F.count("*").alias("n_events"), ends.alias("status"))


def heartbeat(events: DataFrame, least_gap: float = 1e-6) -> DataFrame:
    """Per family the smoothed rate 0.8 / 0.2 over its steps in order, and a stall flag for the last gap.

    The fold runs over an array of gaps per family, which holds one number per step.
    """
    at = Window.partitionBy("family_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    step = micros - F.lag(micros).over(at)
    gaps = events.withColumn("gap", F.when(step.isNotNull(), F.greatest(step / F.lit(1e6), F.lit(least_gap))))
    g = gaps.groupBy("family_id").agg(F.sort_array(F.collect_list(F.when(F.col("gap").isNotNull(), F.struct("ts", "event_id", "gap")))).alias("g"))
    rates = F.transform("g", lambda x: F.lit(1.0) / x["gap"])
    ewma = F.aggregate(rates, F.lit(0.0), lambda acc, r: F.when(acc == 0.0, r).otherwise(F.lit(0.8) * acc + F.lit(0.2) * r))
    gap = F.element_at(F.transform("g", lambda x: x["gap"]), -1)
    return g.where(F.size("g") > 0).select("family_id", F.size("g").cast("long").alias("n_steps"), ewma.alias("rate_ewma"), (gap > F.greatest(F.lit(120.0), 5.0 / ewma)).alias("stalled"))

"""The resumable judge run: a stream over family files into an append-only ledger."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.runs import utc_now
from palimpsest.sources.shared import Lease, Locked, Lost, Shared
from palimpsest.streaming.control import Control, Heartbeat, Progress

__all__ = ["Lease", "Locked", "Lost", "append", "batches", "matrix", "record", "results", "run", "scan", "states"]

#: Prompts of a family without a column of them: four variants in both orders. Fixed value.
PROMPTS_A_FAMILY = 8
COMMIT = "batch long, term long, path string, families long, prompts long, last_family_id string, at string"
EVENT = "run_id string, attempt_id string, at double, state string, phase string, note string"


def run(
    spark: SparkSession, families: str, schema: T.StructType, judge: Callable[[DataFrame], DataFrame], ledger: str, *,
    files_per_batch: int = 1, stop: Callable[[], bool] | Control = lambda: False, progress: Callable[[int, int], None] | None = None, heartbeat: Heartbeat | None = None, lease: Lease | None = None,
) -> str:
    """Judge all family files that the ledger has not seen; COMPLETED, or PAUSED after a stop request.

    A batch writes one nested row per family (prompts and variants inside) into a folder of its own
    and then creates its commit, a small file that names the folder; only what a commit names
    counts. Creation is exclusive, so the three grains of a batch stand or fall together, a batch
    that is replayed after a crash is left as it is, and of two writers one commits it. A lease is
    asked before each commit; the run ends with Lost where it was taken over. The stream's
    checkpoint is the queue.

    heartbeat: started and stopped here, told by a listener of each batch that Spark reports done, and
    written by its own timer meanwhile. progress is told the number of each batch and of its families.
    """
    name = f"judge-{uuid.uuid4().hex}"
    listener = Progress(name, heartbeat, progress)
    paused, ended = [], []

    def commit(batch: DataFrame, number: int) -> None:
        try:
            asked = stop()
        except KeyboardInterrupt as error:  # it must not end the thread that answers Spark
            ended.append(KeyboardInterrupt("the run was given up"))
            raise InterruptedError("given up") from error
        if asked:
            paused.append(number)
            raise InterruptedError("stop requested")
        try:
            held = append(spark, ledger, number, lambda: judge(batch), lease)
        except Lost as error:
            ended.append(error)
            raise
        if held is None:
            return
        listener.counts[number] = (held["families"], held["prompts"], held["last_family_id"])
        if isinstance(stop, Control):
            stop.done += held["families"]

    spark.streams.addListener(listener)
    if heartbeat is not None:
        heartbeat.spark = heartbeat.spark or spark
        heartbeat.state, heartbeat.phase = "RUNNING", "INFERENCE"
        heartbeat.start()
    state = "FAILED"
    try:
        query = (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(families)
            .writeStream.queryName(name).foreachBatch(commit).option("checkpointLocation", f"{ledger}/queue").trigger(availableNow=True).start()
        )
        try:
            query.awaitTermination()
            state = "COMPLETED"
        except Exception:
            if ended:
                raise ended[0] from None
            if not paused:
                raise
            if isinstance(stop, Control):
                stop.paused()
            state = "PAUSED"
        return state
    finally:
        listener.finished.wait(timeout=30)
        spark.streams.removeListener(listener)
        if heartbeat is not None:
            heartbeat.stop_requested = bool(paused)
            heartbeat.state, heartbeat.inflight = state, 0
            heartbeat.stop()


def append(spark: SparkSession, ledger: str, number: int, judged: Callable[[], DataFrame], lease: Lease | None = None) -> dict | None:
    """Commit one batch of rows with family_id; its entry, or None where the batch stands already and nothing is judged."""
    files, at = Shared(spark), f"{ledger}/commits/{number:09d}.json"
    if files.exists(at):
        return None
    term = lease.term if lease is not None else 0
    part = f"batch_no={number:09d}/part={term:09d}-{uuid.uuid4().hex}"
    seen, rows = Observation(), judged().withColumn("batch", F.lit(number))
    prompts = F.sum(F.size("prompts")) if "prompts" in rows.columns else F.count("*") * PROMPTS_A_FAMILY
    rows.observe(seen, F.count("*").alias("families"), F.coalesce(prompts, F.lit(0)).cast("long").alias("prompts"), F.max("family_id").alias("last")).write.parquet(f"{ledger}/rows/{part}")
    held = seen.get
    if lease is not None:
        lease.check()
    entry = {"batch": number, "term": term, "path": part, "families": held["families"], "prompts": held["prompts"], "last_family_id": None if held["last"] is None else str(held["last"]), "at": utc_now()}
    if not files.create(at, json.dumps(entry)):
        raise Lost(f"batch {number} was committed by another writer")
    return entry


def batches(spark: SparkSession, ledger: str) -> DataFrame:
    """The commits of a ledger, a row per batch."""
    if not Shared(spark).names(f"{ledger}/commits"):
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).json(f"{ledger}/commits")


def rows(spark: SparkSession, ledger: str, after: int = -1) -> DataFrame:
    """All committed rows of batches after a number. Folders that no commit names are leftovers of a crash and are passed over.

    Commits are as many as batches and are joined by their folder's name.
    """
    held = spark.read.option("basePath", f"{ledger}/rows").parquet(f"{ledger}/rows/*/*").where(F.col("batch_no") > after)
    named = batches(spark, ledger).select(F.regexp_extract("path", "part=(.*)$", 1).alias("part"))
    return held.join(named, "part", "left_semi").drop("part")


def results(spark: SparkSession, ledger: str) -> DataFrame:
    """The latest row of each family."""
    held = rows(spark, ledger)
    rest = [c for c in held.columns if c not in ("family_id", "batch", "batch_no")]
    return held.groupBy("family_id").agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select("family_id", "_r.*")


def scan(spark: SparkSession, ledger: str, grain: str = "family") -> DataFrame:
    """Rows of one grain in order, for export: families by id, `variants` and `prompts` (arrays of the nested row) by
    id, variant and order of display."""
    held = results(spark, ledger)
    if grain == "family":
        return held.drop("variants", "prompts").orderBy("family_id")
    if grain not in ("variant", "prompt"):
        raise ValueError("the grain is family, variant or prompt")
    out = held.select("family_id", F.explode(f"{grain}s").alias("_x")).select("family_id", "_x.*")
    return out.orderBy("family_id", "variant_id", *(["order_id"] if grain == "prompt" else []))


def record(spark: SparkSession, ledger: str, run_id: str, attempt_id: str, state: str, phase: str, note: str = "") -> None:
    """A change of a run's state, as one small file of its own: events are only ever added."""
    at = time.time()
    entry = {"run_id": run_id, "attempt_id": attempt_id, "at": at, "state": state, "phase": phase, "note": note}
    Shared(spark).create(f"{ledger}/events/{at:018.6f}-{uuid.uuid4().hex[:8]}.json", json.dumps(entry))


def states(spark: SparkSession, ledgers: str) -> DataFrame:
    """Where each run stands, by its last event; ledgers may hold wildcards. n_attempts counts the attempts begun."""
    held = spark.read.schema(EVENT).json(f"{ledgers}/events")
    last = lambda c: F.max_by(c, "at").alias(c)
    return held.groupBy("run_id").agg(last("attempt_id"), last("state"), last("phase"), F.count_distinct("attempt_id").alias("n_attempts"), F.max("at").alias("updated_at"))


def matrix(spark: SparkSession, ledgers: list[str]) -> DataFrame:
    """A row per slice: identity, state, families in all, completed and pending; a slice not begun is MISSING.

    A ledger's manifest (run.json) names its run; counts are sums over its commits.
    """
    files, out = Shared(spark), []
    for at in ledgers:  # a slice is a run; there are few
        meta = json.loads(files.read(f"{at}/run.json") or "{}")
        begun = bool(files.names(f"{at}/events"))
        state = states(spark, at).first() if begun else None
        done = batches(spark, at).agg(F.coalesce(F.sum("families"), F.lit(0))).first()[0]
        total = (meta.get("queue") or {}).get("n")
        told = (meta.get("run_id"), meta.get("task_family"), meta.get("model_id"), meta.get("prompt_id"), meta.get("split"))
        out.append((at, *told, state["state"] if state else "MISSING", state["phase"] if state else None, state["n_attempts"] if state else 0, total, done, None if total is None else total - done))
    return spark.createDataFrame(out, "ledger string, run_id string, task_family string, model_id string, prompt_id string, split string, state string, phase string, n_attempts long, total_families long, completed_families long, pending_families long")

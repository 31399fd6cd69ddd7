"""A ledger that stays fast: bucketed, sorted generations with compaction.

A generation holds the latest row of each family as of some batch, in buckets of the family. The
queue lies in the same buckets. So what is latest, and which families are pending, is read and
joined bucket by bucket without a shuffle; only rows of batches after the generation, the tail, move.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.shared import Lease, Lost, Shared
from palimpsest.streaming import runner


class Store:
    """Generations and queue of one ledger. buckets must stay the same for its life; it is told by the queue's and each generation's entry."""

    def __init__(self, spark: SparkSession, ledger: str, buckets: int = 64, id_col: str = "family_id") -> None:
        self.spark, self.ledger, self.buckets, self.id_col, self.files = spark, ledger.rstrip("/"), buckets, id_col, Shared(spark)

    def _name(self, path: str) -> str:
        return "ledger_" + hashlib.sha256(path.encode()).hexdigest()[:24]

    def _write(self, rows: DataFrame, path: str) -> None:
        """Rows in buckets of the id, sorted within them, below path; the catalog's entry is dropped, the files stay."""
        name = self._name(path)
        rows.write.bucketBy(self.buckets, self.id_col).sortBy(self.id_col).format("parquet").mode("errorifexists").option("path", path).saveAsTable(name)

    def _read(self, entry: dict) -> DataFrame:
        """The table of an entry; another session learns its buckets from the entry."""
        name = self._name(entry["path"])
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{c}` {t}" for c, t in entry["columns"])
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{self.id_col}`) SORTED BY (`{self.id_col}`) INTO {entry['buckets']} BUCKETS LOCATION '{entry['path']}'")
        return self.spark.table(name)

    def _commit(self, kind: str, number: int, rows: DataFrame, more: dict) -> dict:
        """Write a table into a folder of its own, then create the entry that names it: a crash in between leaves a folder that nobody reads."""
        path = f"{self.ledger}/{kind}/{number:09d}-{uuid.uuid4().hex}"
        self._write(rows, path)
        entry = {"path": path, "buckets": self.buckets, "columns": [[f.name, f.dataType.simpleString()] for f in rows.schema.fields]} | more
        if not self.files.create(f"{self.ledger}/{kind}-entries/{number:09d}.json", json.dumps(entry)):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(path)}")
            self.files.delete(path)
            raise Lost(f"{kind} {number} was written by another")
        return entry

    def _last(self, kind: str) -> tuple[int, dict] | None:
        names = self.files.names(f"{self.ledger}/{kind}-entries")
        if not names:
            return None
        entry = json.loads(self.files.read(f"{self.ledger}/{kind}-entries/{names[-1]}"))
        if entry["buckets"] != self.buckets:
            raise ValueError(f"the ledger has {entry['buckets']} buckets")
        return int(names[-1][:9]), entry

    def enqueue(self, families: DataFrame) -> None:
        """The queue of the run, once; ids are distinct."""
        if self._last("queue") is None:
            self._commit("queue", 0, families.repartition(self.buckets, self.id_col), {})

    def _tail(self, after: int) -> DataFrame | None:
        """The latest row of each family of the batches after a number; None without any."""
        if not any(int(n[:9]) > after for n in self.files.names(f"{self.ledger}/commits")):
            return None
        rows = runner.rows(self.spark, self.ledger, after).drop("batch_no")
        rest = [c for c in rows.columns if c != self.id_col]
        return rows.groupBy(self.id_col).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(self.id_col, "_r.*")

    def compact(self, lease: Lease | None = None) -> int:
        """Fold the tail into a new generation; the number of the last batch in it.

        Only the tail is shuffled: it meets the last generation bucket by bucket. The former
        generation and all batches stay until vacuum(), so a crash at any moment loses nothing.
        """
        last = self._last("generation")
        number, through = (last[0] + 1, last[1]["through"]) if last else (0, -1)
        newest = max((int(n[:9]) for n in self.files.names(f"{self.ledger}/commits")), default=-1)
        tail = self._tail(through)
        if tail is None:
            return through
        rows = tail.repartition(self.buckets, self.id_col) if last is None else self._over(self._read(last[1]), tail)
        if lease is not None:
            lease.check()
        self._commit("generation", number, rows, {"through": newest})
        return newest

    def _over(self, held: DataFrame, tail: DataFrame) -> DataFrame:
        """Rows of held, replaced and completed by those of tail: a bucket meets its own part of the tail."""
        new = tail.select(F.col(self.id_col).alias("_id"), F.struct(*tail.columns).alias("_new"))
        met = held.select(F.col(self.id_col), F.struct(*held.columns).alias("_old")).hint("merge").join(new.hint("merge"), F.col(self.id_col) == F.col("_id"), "full_outer")
        return met.select(*[F.when(F.col("_id").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in held.columns])

    def latest(self) -> DataFrame:
        """The latest row of each family."""
        last = self._last("generation")
        tail = self._tail(last[1]["through"] if last else -1)
        if last is None:
            return tail if tail is not None else runner.rows(self.spark, self.ledger).drop("batch_no")
        return self._read(last[1]) if tail is None else self._over(self._read(last[1]), tail)

    def pending(self) -> DataFrame:
        """Queued families without a row, joined bucket by bucket."""
        queue = self._last("queue")
        if queue is None:
            raise ValueError("nothing was queued")
        held = self._read(queue[1])
        last = self._last("generation")
        tail = self._tail(last[1]["through"] if last else -1)
        for done in ([self._read(last[1])] if last else []) + ([tail] if tail is not None else []):
            held = held.hint("merge").join(done.select(self.id_col).hint("merge"), self.id_col, "left_anti")
        return held

    def vacuum(self) -> None:
        """Delete what the last generation has replaced: former generations, folders that no entry names, and rows of batches that it holds.

        The commits stay: they say that a batch is done. Not to be run beside a compaction.
        """
        last = self._last("generation")
        if last is None:
            return
        kept = last[1]["path"].rsplit("/", 1)[1]
        for name in self.files.names(f"{self.ledger}/generation"):
            if name != kept:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._name(f'{self.ledger}/generation/{name}')}")
                self.files.delete(f"{self.ledger}/generation/{name}")
        for name in self.files.names(f"{self.ledger}/rows"):
            if int(name.split("=")[1]) <= last[1]["through"]:
                self.files.delete(f"{self.ledger}/rows/{name}")

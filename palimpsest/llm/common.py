"""Helpers that the operators share: reading tables, shared scratch tables, splitting batches."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: what the contracts of the operators call `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where it is unset (tests on one machine) a local folder stands in for it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            named = held.get()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/palimpsest-{spark.sparkContext.applicationId}"


#: Tables that the open passing() blocks have made, innermost last.
_made: list[list[str]] = []


def cut(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Lost executors then cost no recomputation, and a table that is used twice is made once. It is
    deleted at the end of the passing() block around it; a lasting one, at that of the block further out.
    """
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if len(_made) > lasting:
        _made[-1 - lasting].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that cut() makes within serve until the block ends; what leaves it must be cut() as lasting."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete all tables that cut() has left for this application."""
    _delete(spark, scratch_dir(spark))


#: Rows and bytes of whole texts that go to a Python worker at once.
ROWS_A_BATCH, BYTES_A_BATCH = 1000, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches held to ROWS_A_BATCH rows and BYTES_A_BATCH bytes: batches of whole texts stay small.

    Spark reads the setting when a plan runs, which is after this returns, so it stays; batches of
    other queries of the session become smaller too, which changes no result.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_A_BATCH), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_A_BATCH)):
        now = int(conf.get(key).rstrip("bB"))
        if now <= 0 or now > most:
            conf.set(key, most)
    return df


def made_in_a_task(rows: DataFrame, make: Callable[[pd.DataFrame], object]) -> object:
    """What `make` makes of a table of bounded size, in one task; only the pickled result comes to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"made": [pickle.dumps(make(pd.concat(list(batches), ignore_index=True)))]})

    return pickle.loads(rows.repartition(1).mapInPandas(run, "made binary").first()["made"])


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lowered(text):
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def n_words(text):
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut positions 0..len(sizes) into runs of about `most` in all, one item at least."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def in_chunks(texts: list, most_chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of bounded length in all, so that a batch's arrays stay small."""
    return runs([len(x) for x in texts], most_chars)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Exclusive running sum."""
    return np.concatenate(([0], np.cumsum(lengths)))[:-1]


def meet(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which nulls agree; of each pair of key columns a's is kept."""
    b = b.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = [a[c].eqNullSafe(b[f"_right_{c}"]) for c in on]
    return a.join(b, same, how).drop(*[f"_right_{c}" for c in on])

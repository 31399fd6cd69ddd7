"""Bucketed generations: plans without a shuffle, crashes in the middle of a compaction."""

import pytest

from palimpsest.sources.shared import Shared
from palimpsest.streaming import runner
from palimpsest.streaming.store import Store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def put(spark, ledger, number, ids, value):
    return runner.append(spark, ledger, number, lambda: spark.createDataFrame([(i, value) for i in ids], "family_id string, v int"))


def rows(df):
    return sorted((r["family_id"], r["v"]) for r in df.collect())


def test_latest_and_pending_need_no_shuffle(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    store = Store(spark, ledger, buckets=4)
    store.enqueue(spark.createDataFrame([(f"f{i:02d}", i) for i in range(30)], "family_id string, ordinal int"))
    assert store.pending().count() == 30
    put(spark, ledger, 0, [f"f{i:02d}" for i in range(10)], 0)
    assert rows(store.latest()) == [(f"f{i:02d}", 0) for i in range(10)] and store.pending().count() == 20
    assert store.compact() == 0 and store.compact() == 0
    put(spark, ledger, 1, [f"f{i:02d}" for i in range(5, 15)], 1)
    want = [(f"f{i:02d}", 0) for i in range(5)] + [(f"f{i:02d}", 1) for i in range(5, 15)]
    # The tail is shuffled, the generation is not.
    assert rows(store.latest()) == want and plan(store.latest()).count("Exchange hashpartitioning(family_id") <= 2
    assert sorted(r["family_id"] for r in store.pending().collect()) == [f"f{i:02d}" for i in range(15, 30)]
    assert store.compact() == 1 and rows(store.latest()) == want
    assert "Exchange" not in plan(store.latest()) and "Exchange" not in plan(store.pending()) and "SortMergeJoin" in plan(store.pending())
    files = [f.name for f in (tmp_path / "ledger/generation").rglob("part-*.parquet")]
    assert len({f.split("_")[-1] for f in files}) <= 4
    # Another session knows the tables by their entries.
    other = Store(spark.newSession(), ledger, buckets=4)
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("ledger_")]:
        spark.sql(f"DROP TABLE {name}")
    assert rows(other.latest()) == want and "Exchange" not in plan(other.pending())
    store.vacuum()
    assert rows(store.latest()) == want and Shared(spark).names(f"{ledger}/rows") == [] and len(Shared(spark).names(f"{ledger}/generation")) == 1
    assert put(spark, ledger, 1, ["f00"], 9) is None  # a batch that was folded is not judged again
    with pytest.raises(ValueError, match="4 buckets"):
        Store(spark, ledger, buckets=8).latest()


def test_crash_in_a_compaction_loses_nothing(spark, tmp_path, monkeypatch):
    ledger = str(tmp_path / "ledger")
    store = Store(spark, ledger, buckets=3)
    put(spark, ledger, 0, ["a", "b"], 0)
    store.compact()
    put(spark, ledger, 1, ["b", "c"], 1)
    want = [("a", 0), ("b", 1), ("c", 1)]

    def dies(*_):
        raise RuntimeError("gone")

    for broken in ("_write", None):
        with monkeypatch.context() as m:
            if broken:  # while files are written
                m.setattr(store, "_write", lambda rows, path: (rows.limit(1).write.parquet(path), dies()))
            else:  # between the files and their entry
                m.setattr(store.files, "create", dies)
            with pytest.raises(RuntimeError, match="gone"):
                store.compact()
        assert rows(Store(spark, ledger, buckets=3).latest()) == want
    assert store.compact() == 1 and rows(store.latest()) == want
    store.vacuum()
    assert rows(store.latest()) == want and len(Shared(spark).names(f"{ledger}/generation")) == 1

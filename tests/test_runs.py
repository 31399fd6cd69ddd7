"""Runs on shared storage: leases, commits, live progress, stored state."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.sources import sinks
from palimpsest.sources.shared import Lease, Locked, Lost, Shared
from palimpsest.streaming import runner
from palimpsest.streaming.control import Control, Heartbeat

SCHEMA = T.StructType([T.StructField("family_id", T.StringType())])


def family_files(folder, n, each=2, start=0):
    folder.mkdir(exist_ok=True)
    for i in range(start, start + n):
        (folder / f"{i}.jsonl").write_text("\n".join(json.dumps({"family_id": f"f{i}{k}"}) for k in range(each)))
    return str(folder)


def plain(df):
    return df.withColumn("ok", F.lit(1))


def test_files_are_whole_or_absent(spark, tmp_path):
    files = Shared(spark)
    at = f"file://{tmp_path}/deep/er/x.json"
    files.write(at, "é")
    sinks.write_text("日本", at, spark)
    assert files.read(at) == "日本" and files.read(f"{tmp_path}/none") is None and files.names(f"{tmp_path}/deep/er") == ["x.json"] and files.names(f"{tmp_path}/none") == []
    won = []
    threads = [threading.Thread(target=lambda i=i: files.create(f"{tmp_path}/one", str(i)) and won.append(i)) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and files.read(f"{tmp_path}/one") == str(won[0])


def test_lease_has_one_holder(spark, tmp_path):
    now = [1000.0]
    ask = lambda **o: Lease(spark, str(tmp_path / "lease"), seconds=40, clock=lambda: now[0], **o)
    first = ask(holder="one").__enter__()
    with pytest.raises(Locked, match="one"):
        ask().__enter__()
    first.check()
    second = ask(force=True, holder="two").__enter__()
    with pytest.raises(Lost):
        first.check()
    first.__exit__()
    assert second.held()
    with pytest.raises(Locked, match="two"):
        ask().__enter__()
    second.renew()
    now[0] += 39
    with pytest.raises(Locked):
        ask().__enter__()
    second._ended.set()  # its driver is gone: nobody renews
    now[0] += 2
    with ask() as third:
        assert third.term == 3 and not second.held()
    with ask() as fourth:  # released: at once
        assert fourth.term == 4


def test_two_runners_on_one_ledger(spark, tmp_path):
    """One is refused; after a forced takeover the former holder stops before its next commit, and no batch counts twice."""
    data, ledger = family_files(tmp_path / "in", 3), str(tmp_path / "ledger")
    ask = lambda force=False: Lease(spark, f"{ledger}/lease", force=force)
    taken = []

    def slow(df):
        if not taken:
            with pytest.raises(Locked):
                ask().__enter__()
            taken.append(ask(force=True).__enter__())
        return plain(df)

    with pytest.raises(Lost), ask() as lease:
        runner.run(spark, data, SCHEMA, slow, ledger, lease=lease)
    assert runner.batches(spark, ledger).count() == 0 and Shared(spark).names(f"{ledger}/rows") == ["batch_no=000000000"]
    assert runner.run(spark, data, SCHEMA, plain, ledger, lease=taken[0]) == "COMPLETED"
    assert runner.results(spark, ledger).count() == 6 and runner.rows(spark, ledger).count() == 6
    assert sorted(r["term"] for r in runner.batches(spark, ledger).collect()) == [2, 2, 2]


def test_replayed_batch_counts_once(spark, tmp_path):
    """A crash between the commit and the checkpoint: the batch is asked for again and stays as it is."""
    data, ledger = family_files(tmp_path / "in", 2), str(tmp_path / "ledger")
    assert runner.run(spark, data, SCHEMA, plain, ledger) == "COMPLETED"
    for name in ("1", ".1.crc"):
        Shared(spark).delete(f"{ledger}/queue/commits/{name}")
    judged = []
    assert runner.run(spark, data, SCHEMA, lambda df: judged.append(1) or plain(df), ledger) == "COMPLETED"
    assert not judged and runner.rows(spark, ledger).count() == 4


def test_stall_is_told_while_it_lasts(spark, tmp_path):
    data, ledger, beat = family_files(tmp_path / "in", 3), str(tmp_path / "ledger"), str(tmp_path / "beat.json")
    heart = Heartbeat(beat, {"run_id": "r"}, pending=6, least_stall=0.5, interval=0.2)
    seen, number = [], []

    @F.udf("int")
    def sleeping(x):
        time.sleep(2.5)
        return 1

    def judge(df):
        number.append(1)
        return df.withColumn("ok", sleeping("family_id") if len(number) == 2 else F.lit(1))

    ended = threading.Event()

    def watch():
        while not ended.wait(0.1):
            if text := Shared(spark).read(beat):
                seen.append(json.loads(text))

    watcher = threading.Thread(target=watch)
    watcher.start()
    told = []
    try:
        assert runner.run(spark, data, SCHEMA, judge, ledger, heartbeat=heart, progress=lambda k, n: told.append((k, n))) == "COMPLETED"
    finally:
        ended.set()
        watcher.join()
    hung = [s for s in seen if s["stalled"]]
    assert hung and all(s["state"] == "RUNNING" and s["completed_families"] == 2 for s in hung)
    last = json.loads(Shared(spark).read(beat))
    assert (last["state"], last["completed_families"], last["pending_families"], last["scored_prompts"], last["last_completed_family_id"], last["stalled"]) == ("COMPLETED", 6, 0, 48, "f21", False)
    assert told == [(0, 2), (1, 2), (2, 2)] and heart._thread is None


def test_heartbeat_of_pause_and_failure(spark, tmp_path):
    data, ledger, beat = family_files(tmp_path / "in", 2), str(tmp_path / "ledger"), str(tmp_path / "beat.json")
    heart = Heartbeat(beat, pending=4)
    assert runner.run(spark, data, SCHEMA, plain, ledger, stop=Control(stop_after=2), heartbeat=heart) == "PAUSED"
    held = json.loads(Shared(spark).read(beat))
    assert (held["state"], held["stop_requested"], held["completed_families"], held["pending_families"]) == ("PAUSED", True, 2, 2)
    with pytest.raises(Exception, match="broken"):
        runner.run(spark, data, SCHEMA, lambda df: df.withColumn("ok", F.raise_error(F.lit("broken")).cast("int")), ledger, heartbeat=Heartbeat(beat, pending=2))
    assert json.loads(Shared(spark).read(beat))["state"] == "FAILED"


def test_states_and_matrix(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    for state, phase, attempt in (("RUNNING", "INFERENCE", "a1"), ("PAUSED", "INFERENCE", "a1"), ("RUNNING", "INFERENCE", "a2")):
        runner.record(spark, one, "r1", attempt, state, phase)
    assert [(r["run_id"], r["state"], r["attempt_id"], r["n_attempts"]) for r in runner.states(spark, f"{tmp_path}/*").collect()] == [("r1", "RUNNING", "a2", 2)]
    sinks.write_json({"run_id": "r1", "task_family": "qa_key", "queue": {"n": 5}}, f"{one}/run.json", spark)
    assert runner.run(spark, family_files(tmp_path / "in", 1), SCHEMA, plain, one) == "COMPLETED"
    got = {r["ledger"]: (r["run_id"], r["state"], r["total_families"], r["completed_families"], r["pending_families"]) for r in runner.matrix(spark, [one, two]).collect()}
    assert got == {one: ("r1", "RUNNING", 5, 2, 3), two: (None, "MISSING", None, 0, None)}

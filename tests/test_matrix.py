"""Family files to ledgers, metrics, audits and bundles over a matrix of slices, with a pause in between."""

import json
import random

import pytest
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import functions as F

from palimpsest.fixed import VARIANTS
from palimpsest.operators import judging, metrics, resample, runs, scoring
from palimpsest.sources.shared import Locked, Shared
from palimpsest.streaming import matrix, runner
from palimpsest.streaming.control import Control

KINDS = ("base", "paraphrase", "paraphrase", "counterfactual")


def families(folder, task, n):
    folder.mkdir(parents=True)
    for k in range(0, n, 3):
        lines = []
        for i in range(k, min(k + 3, n)):
            variants = [{"variant_id": v, "kind": kind, "criterion_text": f"{task} key {'B' if kind == 'counterfactual' else 'A'} {v}", "semantics_id": "s_counterfactual" if kind == "counterfactual" else "s_base", "gold_winner_cid": "c2" if kind == "counterfactual" else "c1"} for v, kind in zip(VARIANTS[task], KINDS, strict=True)]
            lines.append(json.dumps({"family_id": f"{task}_{i:03d}", "task_family": task, "split": "test" if i % 5 else "dev", "task_text": f"task {i}", "candidates": [{"cid": "c1", "text": f"one {i}"}, {"cid": "c2", "text": f"two {i}"}], "variants": variants}))
        (folder / f"{k:03d}.jsonl").write_text("\n".join(lines) + "\n")
    return str(folder)


def loader(seed):
    """A scorer whose scores follow from the text alone."""

    def load():
        def scorer(texts):
            out = []
            for t in texts:
                r = random.Random(f"{seed}{t}")
                out.append((-r.random(), -r.random() if r.random() > 0.1 else -0.5))
            return out

        return scorer

    return load


def test_matrix_of_slices(spark, tmp_path):
    data = {t: families(tmp_path / t, t, 11) for t in ("qa_key", "biorubric")}
    specs = matrix.slices(data, ["m2", "m1"], ["standard"], "test", {t: f"sha-{t}" for t in data}, "cfg")
    assert [s.run_id for s in specs] == ["biorubric__m2__standard__test", "qa-key__m2__standard__test", "biorubric__m1__standard__test", "qa-key__m1__standard__test"]
    root, loaders = str(tmp_path / "runs"), {"m1": loader(1), "m2": loader(2)}
    options = {"replicates": 50, "seed": 7, "audit": 3}
    with pytest.raises(runs.RunError, match="no loader"):
        matrix.run_matrix(spark, specs, root, {"m1": loader(1)})
    # The first pause comes within the second slice.
    stands = {}
    for stop_after in (4, 7, None):
        stop = Control(stop_after=stop_after)
        stands = {r["run_id"]: (r["state"], r["completed_families"], r["total_families"]) for r in matrix.run_matrix(spark, specs, root, loaders, stop=stop, **options).collect()}
        if stop_after:
            assert "PAUSED" in {s for s, *_ in stands.values()}
    assert set(stands.values()) == {("COMPLETED", 8, 8)}
    assert all(json.loads(Shared(spark).read(f"{root}/{s.run_id}/bundle/summary_metrics.json"))["n_families"] == 8 for s in specs)
    for spec in specs[1:3]:  # one of each task and model
        at = f"{root}/{spec.run_id}"
        own = matrix.read_families(spark, spec.dataset_path, spec.task_family, "test")
        # The same by the plain operators, in one go.
        scored = scoring.score(matrix.prompts_of(own, "standard"), loaders[spec.model_id])
        variants = judging.variant_results(scoring.mirrored(scored))
        want = judging.family_results(variants)
        cols = ["family_id", "base_correct", "paraphrase_all_correct", "counterfactual_correct", "tie_count", "variant_count", "order_disagreement_count", "gcf_success"]
        assert sorted(map(tuple, runner.scan(spark, at).select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
        assert runner.scan(spark, at, "prompt").count() == 64 and runner.scan(spark, at, "variant").count() == 32
        summary = json.loads(Shared(spark).read(f"{at}/bundle/summary_metrics.json"))
        assert summary == pytest.approx(metrics.summary(want).first().asDict())
        intervals = json.loads(Shared(spark).read(f"{at}/bundle/bootstrap_ci.json"))["metrics"]
        for r in resample.bootstrap(want, resample.exact_draws(want, 50, 7), []).collect():
            assert (intervals[r["metric"]]["ci_lower"], intervals[r["metric"]]["ci_upper"]) == (pytest.approx(r["ci_lower"]), pytest.approx(r["ci_upper"]))
        failed = want.where("gcf_success = 0").count()
        assert sum(json.loads(Shared(spark).read(f"{at}/audit/labels.json")).values()) == failed and spark.read.json(f"{at}/audit/sample").count() == min(3, failed)
        beat = json.loads(Shared(spark).read(f"{at}/heartbeat.json"))
        assert (beat["state"], beat["phase"], beat["completed_families"], beat["run_id"]) == ("COMPLETED", "EXPORT", 8, spec.run_id)
    # Complete ones are passed over; a changed identity does not go on.
    before = Shared(spark).names(f"{root}/{specs[0].run_id}/events")
    matrix.run_matrix(spark, specs, root, loaders, **options)
    assert Shared(spark).names(f"{root}/{specs[0].run_id}/events") == before
    with pytest.raises(runs.RunError, match="config_fingerprint"):
        matrix.run_slice(spark, matrix.slices(data, ["m1"], ["standard"], "test", {t: f"sha-{t}" for t in data}, "other")[0], root, loader(1))
    assert matrix.run_slice(spark, specs[0], root, None, **options) == "COMPLETED"  # only what follows the judging


def test_failed_slice_is_told(spark, tmp_path):
    data = {"qa_key": families(tmp_path / "in", "qa_key", 6)}
    spec = matrix.slices(data, ["m"], ["standard"], "test", {"qa_key": "x"}, "cfg", keep=lambda task, model, prompt: model == "m")[0]
    root = str(tmp_path / "runs")

    def broken():
        raise RuntimeError("no such model")

    with pytest.raises(Exception, match="no such model"):
        matrix.run_slice(spark, spec, root, broken)
    assert [r["state"] for r in runner.states(spark, f"{root}/{spec.run_id}").collect()] == ["FAILED"]
    with pytest.raises(runs.RunError, match="were not judged"):
        matrix.run_slice(spark, spec, root, None)
    with runner.Lease(spark, f"{root}/{spec.run_id}/lease"), pytest.raises(Locked):
        matrix.run_slice(spark, spec, root, loader(1))
    assert matrix.run_slice(spark, spec, root, loader(1), replicates=5) == "COMPLETED"
    assert runner.states(spark, f"{root}/{spec.run_id}").first()["n_attempts"] == 3


def test_worker_keeps_one_model():
    loads = []
    load = lambda name: lambda: loads.append(name) or (lambda texts: [])
    first = scoring.held("a", load("a"))
    assert scoring.held("a", load("a")) is first and scoring.held("b", load("b")) is not first
    scoring.held("a", load("a"))
    assert loads == ["a", "b", "a"]


def test_profile_is_for_clusters(spark):
    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(2)).build
    prompts = spark.createDataFrame([("x",)], "prefix string")
    assert scoring.score_kept(prompts, lambda: lambda texts: [(-1.0, -2.0)] * len(texts), "m", profile=profile).select(F.col("score_a") - F.col("score_b")).first()[0] == 1.0

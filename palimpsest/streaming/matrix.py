"""A matrix of judge runs, from family files to bundles.

Each slice (task, model, prompt, split) has a ledger of its own with lease, manifest, events and
heartbeat. Slices of one model run one after the other, so Python workers keep the model they have
loaded; a resource profile can give the scoring stage machines of its own.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.fixed import VARIANTS
from palimpsest.operators import judging, metrics, rendering, resample, runs, scoring, validate
from palimpsest.operators.runs import Slice
from palimpsest.sources import sinks
from palimpsest.sources.files import SourceError
from palimpsest.sources.shared import Lease, Shared
from palimpsest.streaming import runner
from palimpsest.streaming.control import Control, Heartbeat

FAMILY = "family_id string, task_family string, split string, task_text string, candidates array<struct<cid:string,text:string>>, variants array<struct<variant_id:string,kind:string,criterion_text:string,semantics_id:string,gold_winner_cid:string>>"


def slices(datasets: Mapping[str, str], models: Sequence[str], prompts: Sequence[str], split: str, digests: Mapping[str, str], config_fingerprint: str, keep: Callable[[str, str, str], bool] = lambda task, model, prompt: True) -> list[Slice]:
    """P25: tasks x models x prompts with a filter, by model. datasets and digests: of each task its path and digest."""
    out = []
    for model, task, prompt in itertools.product(models, sorted(datasets), prompts):
        if keep(task, model, prompt):
            out.append(Slice(runs.run_stem(task, model, prompt, split), task, model, prompt, split, digests[task], config_fingerprint, dataset_path=datasets[task], code_version=runs.code_version()))
    if len({s.run_id for s in out}) < len(out):
        raise runs.RunError("two slices have one name")
    return out


def read_families(spark: SparkSession, path: str, task: str, split: str) -> DataFrame:
    """All families of a folder of JSON lines keep their contract; those of the split, which must not be none."""
    held = spark.read.schema(FAMILY).option("mode", "FAILFAST").json(path)
    validate.abort_on(held.withColumn("violations", validate.family(task)))
    own = held.where(F.col("split") == split)
    if own.isEmpty():
        raise SourceError(f"no family in {path} for split {split}")
    return own


def prompts_of(families: DataFrame, prompt_id: str) -> DataFrame:
    """Eight prompts a family: each variant in both orders of display."""
    text = lambda cid: F.get(F.filter("candidates", lambda c: c["cid"] == cid), F.lit(0))["text"]
    v = families.select("family_id", "task_text", text("c1").alias("c1_text"), text("c2").alias("c2_text"), F.explode("variants").alias("v"))
    p = v.select("family_id", "v.variant_id", "v.gold_winner_cid", "task_text", "v.criterion_text", "c1_text", "c2_text", F.explode(F.array(F.lit("AB"), F.lit("BA"))).alias("order_id"))
    ab = F.col("order_id") == "AB"
    a, b = (F.when(ab, F.col(x)).otherwise(F.col(y)) for x, y in (("c1_text", "c2_text"), ("c2_text", "c1_text")))
    return p.withColumn("prefix", rendering.prefix(prompt_id, F.col("task_text"), F.col("criterion_text"), a, b)).select("family_id", "variant_id", "gold_winner_cid", "order_id", "prefix")


def judged(families: DataFrame, prompt_id: str, load: Callable[[], scoring.Scorer], model_id: str, batch: int = 64, profile: ResourceProfile | None = None) -> DataFrame:
    """One nested row a family: its results, its variants and its prompts with their scores."""
    scored = scoring.score_kept(prompts_of(families, prompt_id), load, model_id, batch, profile)
    variants = judging.variant_results(scoring.mirrored(scored))
    # Scores cost by far the most, so prompts are told by the variants' scores instead of being kept for a second use.
    prompts = judging.prompt_results(variants).select("family_id", F.struct("variant_id", "order_id", "displayed_cid_a", "displayed_cid_b", "score_a", "score_b", "score_gap", "pred_display_label").alias("x"), "variant_id", *[c for c in variants.columns if c not in ("family_id", "variant_id")])
    own = [c for c in variants.columns if c != "family_id"]
    both = prompts.groupBy("family_id", *own).agg(F.collect_list("x").alias("shown"))
    nested = both.groupBy("family_id").agg(F.sort_array(F.collect_list(F.struct(*own))).alias("variants"), F.sort_array(F.flatten(F.collect_list("shown"))).alias("prompts"))
    right = lambda name: F.transform(F.filter("variants", lambda v: _is(v, name)), lambda v: (v["pred_winner_cid"] == v["gold_winner_cid"]).cast("int"))
    total = lambda c: F.aggregate("variants", F.lit(0), lambda acc, v: acc + v[c])
    whole = F.when((F.size("variants") != 4) | (F.size(right("base")) != 1) | (F.size(right("counterfactual")) != 1), F.raise_error(F.lit("a family must hold its four variants once each"))).otherwise(F.get(right("base"), F.lit(0)))
    out = nested.withColumns({"base_correct": whole, "paraphrase_all_correct": F.array_min(right("paraphrase")), "counterfactual_correct": F.get(right("counterfactual"), F.lit(0)),
        "tie_count": total("pred_tie").cast("long"), "variant_count": F.size("variants").cast("long"), "order_disagreement_count": total("order_disagree").cast("long")})
    return out.withColumn("gcf_success", F.col("base_correct") * F.col("paraphrase_all_correct") * F.col("counterfactual_correct"))


def _is(variant, kind: str):
    if kind == "paraphrase":
        return ~variant["variant_id"].isin("base", "counterfactual")
    return variant["variant_id"] == kind


def failures(ledger_families: DataFrame, families: DataFrame, variants: Sequence[str]) -> DataFrame:
    """Failing families with their first failing variant in canonical order, a label and what was asked."""
    place = lambda v: F.array_position(F.array(*[F.lit(x) for x in variants]), v)
    wrong = F.filter("variants", lambda v: v["pred_winner_cid"] != v["gold_winner_cid"])
    first = F.array_sort(wrong, lambda a, b: (place(a["variant_id"]) - place(b["variant_id"])).cast("int"))
    failed = ledger_families.where("gcf_success = 0").select("family_id", F.get(first, F.lit(0)).alias("p"))
    label = F.when(F.col("p.pred_tie") == 1, "model_tie").when(F.col("p.order_disagree") == 1, "order_effect").otherwise("genuine_criterion_failure")
    said = families.select("family_id", "task_text", "candidates", F.col("variants").alias("_asked"))
    criterion = F.get(F.filter("_asked", lambda v: v["variant_id"] == F.col("p.variant_id")), F.lit(0))["criterion_text"]
    return failed.join(said, "family_id").select("family_id", F.col("p.variant_id").alias("primary_variant_id"), label.alias("primary_label"), "p.pred_winner_cid", "p.gold_winner_cid", "p.scores_agg_c1", "p.scores_agg_c2", "task_text", criterion.alias("criterion_text"), "candidates")


def run_slice(
    spark: SparkSession, spec: Slice, root: str, load: Callable[[], scoring.Scorer] | None, *, stop: Control | None = None, files_per_batch: int = 1, replicates: int = 2000, seed: int = 2026, audit: int = 50,
    batch: int = 64, profile: ResourceProfile | None = None, force: bool = False, interval: float = 15.0,
) -> str:
    """Run or resume one slice: COMPLETED with its bundle and audit, or PAUSED. Without load only what follows the judging is made.

    The ledger stands at <root>/<run_id>. A manifest of another run, or a lease that is held, is an
    error before anything is judged; any later error leaves the state FAILED.
    """
    ledger, files, stop = f"{root}/{spec.run_id}", Shared(spark), stop or Control()
    families = read_families(spark, spec.dataset_path, spec.task_family, spec.split)
    with Lease(spark, f"{ledger}/lease", force=force) as lease:
        saved = files.read(f"{ledger}/run.json")
        if saved is not None:
            runs.check_resume(json.loads(saved), spec, families)
        else:
            sinks.write_json(runs.manifest(spec, families), f"{ledger}/run.json", spark)
        total, attempt = families.count(), runs.attempt_id()
        told = lambda state, phase, note="": runner.record(spark, ledger, spec.run_id, attempt, state, phase, note)
        told("RUNNING", "INFERENCE")
        done = runner.batches(spark, ledger).agg(F.coalesce(F.sum("families"), F.lit(0))).first()[0]
        identity = {k: v for k, v in asdict(spec).items() if k in ("run_id", "task_family", "split", "model_id", "prompt_id", "dataset_sha256")} | {"attempt_id": attempt}
        heart = Heartbeat(f"{ledger}/heartbeat.json", identity, completed=done, pending=total - done, interval=interval, spark=spark)
        try:
            if load is not None:
                judge = lambda df: judged(df.where(F.col("split") == spec.split), spec.prompt_id, load, spec.model_id, batch, profile)
                state = runner.run(spark, spec.dataset_path, families.schema, judge, ledger, files_per_batch=files_per_batch, stop=stop, heartbeat=heart, lease=lease)
                if state == "PAUSED":
                    told("PAUSED", "INFERENCE")
                    return state
            told("POSTPROCESS", "BOOTSTRAP")
            heart.set_state("POSTPROCESS", "BOOTSTRAP")
            if not files.names(f"{ledger}/commits"):
                raise runs.RunError(f"{total} families were not judged")
            held = runner.results(spark, ledger)
            if (missing := families.join(held, "family_id", "left_anti").count()) > 0:
                raise runs.RunError(f"{missing} families were not judged")
            flat = held.drop("variants", "prompts")
            grain = lambda g: held.select("family_id", F.explode(g).alias("x")).select("family_id", "x.*")
            intervals = resample.bootstrap(flat, resample.exact_draws(flat, replicates, seed), [])
            lease.check()
            sinks.write_bundle(f"{ledger}/bundle", summary=metrics.summary(flat), bootstrap=intervals, families=flat, variants=grain("variants"), prompts=grain("prompts"), identity=identity | {"replicates": replicates, "seed": seed})
            told("POSTPROCESS", "AUDIT_SAMPLE")
            heart.set_state("POSTPROCESS", "AUDIT_SAMPLE")
            failed = failures(held, families, VARIANTS[spec.task_family])
            failed.write.mode("overwrite").parquet(f"{ledger}/audit/failures")
            failed = spark.read.parquet(f"{ledger}/audit/failures")
            sinks.write_jsonl(resample.exact_sample(failed, audit, seed, "family_id"), f"{ledger}/audit/sample")
            sinks.write_json({r["primary_label"]: r["n"] for r in failed.groupBy("primary_label").agg(F.count("*").alias("n")).collect()}, f"{ledger}/audit/labels.json", spark)
            told("COMPLETED", "EXPORT")
            heart.set_state("COMPLETED", "EXPORT")
            return "COMPLETED"
        except BaseException as error:
            told("FAILED", "INFERENCE", repr(error)[:500])
            heart.set_state("FAILED")
            raise


def run_matrix(spark: SparkSession, specs: Sequence[Slice], root: str, loaders: Mapping[str, Callable[[], scoring.Scorer]], *, stop: Control | None = None, **options) -> DataFrame:
    """All slices by model, those that are complete passed over; a pause ends the matrix until it is called again.

    Returns where each slice stands. A slice of a model without a loader is an error before any runs.
    """
    if lacking := sorted({s.model_id for s in specs} - set(loaders)):
        raise runs.RunError(f"no loader for {', '.join(lacking)}")
    for spec in sorted(specs, key=lambda s: (s.model_id, s.run_id)):
        ledger = f"{root}/{spec.run_id}"
        if Shared(spark).names(f"{ledger}/events") and runner.states(spark, ledger).first()["state"] == "COMPLETED":
            continue
        if run_slice(spark, spec, root, loaders[spec.model_id], stop=stop, **options) == "PAUSED":
            break
    return runner.matrix(spark, [f"{root}/{s.run_id}" for s in specs])

"""Counters from one scan, and counters that arise while a table is written."""

import json

from conftest import DATA
from palimpsest.fixed import SLOTS
from palimpsest.operators import canonical, quality
from palimpsest.plans import registry
from palimpsest.sources.shared import Shared
from palimpsest.sources.tables import ADAPTED, qa_facts, raw_facts, relations


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_report_reads_its_source_once(spark):
    df = registry.QUERIES["canonical_qa_report"](spark, DATA)
    assert scans(df) == scans(qa_facts(spark, DATA)) and "Expand" in df._jdf.queryExecution().optimizedPlan().toString()
    assert scans(registry.QUERIES["fact_report"](spark, DATA)) == scans(raw_facts(spark, DATA))


def nested(rows):
    out = {}
    for r in rows:
        if r["key"]:
            out.setdefault(r["counter"], {})[r["key"]] = r["n"]
        else:
            out[r["counter"]] = r["n"]
    return out


def test_what_is_observed_agrees_with_the_report(spark, tmp_path):
    reasons = canonical.qa_reasons(qa_facts(spark, DATA), relations(spark))
    ids, types = [r[0] for r in ADAPTED], [r[2] for r in ADAPTED]
    at = f"file://{tmp_path}/qa"
    held = quality.written(reasons, canonical.qa_items, at, anchor="subject_id", skips=quality.QA_SKIPS, by={"relation_output_counts": ("relation_id", ids), "coarse_type_output_counts": ("coarse_type", types)}, task_family="qa_key")
    told = nested(quality.qa_report(reasons, ids, types).collect())
    assert held == json.loads(Shared(spark).read(f"{at}/qc.json")) and all(held[k] == told[k] for k in held if k != "task_family")
    assert spark.read.parquet(f"{at}/items").count() == held["output_row_count"] == sum(held["relation_output_counts"].values())
    assert spark.read.parquet(f"{at}/split_manifest").count() == sum(held["split_counts"].values())
    facts = canonical.fact_reasons(raw_facts(spark, DATA))
    held = quality.written(facts, canonical.facts, str(tmp_path / "facts"), anchor="entity_id", skips=quality.FACT_SKIPS, by={"slot_row_counts": ("slot", SLOTS)}, task_family="biorubric")
    told = nested(quality.fact_report(facts).collect())
    assert all(held[k] == told[k] for k in held if k != "task_family")


def test_zeros_of_an_empty_table(spark):
    reasons = canonical.qa_reasons(qa_facts(spark, DATA).where("false"), relations(spark))
    told = nested(quality.qa_report(reasons, ["p_brand"], ["brand"]).collect())
    assert told["input_row_count"] == 0 and told["skip_reasons"] == dict.fromkeys(quality.QA_SKIPS, 0) and told["split_counts"] == {"train": 0, "dev": 0, "test": 0}

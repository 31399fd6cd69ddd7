"""Writers (K01-K06, K09, K11, K12)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.shared import Shared


def write_jsonl(df: DataFrame, path: str) -> None:
    """Null fields stay, and what is beyond ASCII is escaped."""
    df.write.mode("overwrite").option("ignoreNullFields", False).option("writeNonAsciiCharacterAsCodePoint", True).json(path)


def write_json(value: object, path: str, spark: SparkSession | None = None) -> None:
    """A small report, written beside its place and moved there, on the file system that the path names."""
    write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=True) + "\n", path, spark)


def write_csv(df: DataFrame, path: str) -> None:
    """A small table as one file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def markdown(df: DataFrame, rows: int = 1000) -> str:
    """A report table; more than `rows` rows are an error, since it is made by the driver."""
    held = df.limit(rows + 1).collect()
    if len(held) > rows:
        raise ValueError(f"a report table has at most {rows} rows")
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *(line("" if c is None else c for c in r) for r in held)]) + "\n"


def write_text(text: str, path: str, spark: SparkSession | None = None) -> None:
    """A small text, written beside its place and moved there; readers see the former text or this one."""
    Shared(spark or SparkSession.active()).write(str(path), text)


def write_frozen(frozen: DataFrame, path: str, targets: dict[str, int], invalid: DataFrame | None = None, qc: dict | None = None) -> dict:
    """Selected families by split and all together, the split manifest, the discard log with its reason, the
    log of invalid anchors, and a quality report with the counts; a split below its target is an error, before anything is written.
    """
    from palimpsest.operators.pairing import freeze_stats

    stats = {r["split"]: r.asDict() for r in freeze_stats(frozen).collect()}  # one row per split
    short = {s: n - stats.get(s, {}).get("selected", 0) for s, n in targets.items() if stats.get(s, {}).get("selected", 0) < n}
    if short:
        raise ValueError(f"splits below their target, by so many families: {short}")
    selected = frozen.where("selected").drop("selected", "place")
    selected.write.mode("overwrite").partitionBy("split").parquet(f"{path}/families")
    write_jsonl(selected, f"{path}/combined")
    write_jsonl(selected.select("family_id", "split"), f"{path}/split_manifest")
    frozen.where("NOT selected").drop("selected").withColumn("reason", F.lit("split_quota_exceeded")).write.mode("overwrite").parquet(f"{path}/discarded")
    if invalid is not None:
        write_jsonl(invalid, f"{path}/invalid")
    write_json(stats, f"{path}/manifest.json", frozen.sparkSession)
    write_json((qc or {}) | {"splits": stats, "targets": targets, "selection_policy": "sorted_by_family_id_with_per_split_targets"}, f"{path}/qc.json", frozen.sparkSession)
    return stats


def sidecar_paths(output: str) -> dict[str, str]:
    """Where the quality report and the split manifest of a canonical table stand: beside it."""
    stem, slash, name = output.rpartition("/")
    base = name.rsplit(".", 1)[0] if "." in name else name
    return {"qc_report_path": f"{stem}{slash}{base}_qc.json", "split_manifest_path": f"{stem}{slash}{base}_splits.jsonl"}


def write_source_artifacts(rows: DataFrame, path: str, asked: dict) -> dict:
    """Fetched rows, with a summary of what was asked for and how many came; files.reusable() reads it."""
    write_jsonl(rows, f"{path}/rows")
    summary = asked | {"row_count": rows.count()}
    write_json(summary, f"{path}/summary.json", rows.sparkSession)
    return summary


def write_bundle(path: str, *, summary: DataFrame, bootstrap: DataFrame, families: DataFrame, variants: DataFrame, prompts: DataFrame | None = None, identity: dict | None = None) -> None:
    """What one slice leaves behind: rows of every grain, the summary and its intervals as small JSON, and who made it."""
    families.write.mode("overwrite").parquet(f"{path}/family_results")
    variants.write.mode("overwrite").parquet(f"{path}/variant_results")
    if prompts is not None:
        prompts.write.mode("overwrite").parquet(f"{path}/prompt_results")
    held = summary.limit(2).collect()
    if len(held) != 1:
        raise ValueError("a slice has one summary")
    write_json(held[0].asDict(), f"{path}/summary_metrics.json", summary.sparkSession)
    bounds = {r["metric"]: {"point_estimate": r["point_estimate"], "ci_lower": r["ci_lower"], "ci_upper": r["ci_upper"]} for r in bootstrap.collect()}  # one row per metric
    write_json({"metrics": bounds} | (identity or {}), f"{path}/bootstrap_ci.json", summary.sparkSession)


def _number(x: float | None, form: str) -> str:
    return "n/a" if x is None else format(x, form)


def decision_note(delta: DataFrame, decision: DataFrame, keys: tuple[str, ...] = ("task_family",)) -> str:
    """What the strict prompt changed, slice by slice, and what follows."""
    d = decision.first()
    lines = ["# Strict prompt: decision", "", f"- Status: `{d['status']}`", "", "## Slices"]
    for r in delta.orderBy(*keys).collect():  # one row per slice
        lines.append(
            f"- {' / '.join(str(r[k]) for k in keys)}: gap {_number(r['gap_standard'], '.6f')} -> {_number(r['gap_strict'], '.6f')} (delta {_number(r['gap_delta'], '+.6f')}); "
            f"sensitivity {_number(r['sensitivity_at_base_correct_standard'], '.6f')} -> {_number(r['sensitivity_at_base_correct_strict'], '.6f')}; gate passed: {r['gate_passed']}"
        )
    lines += ["", "## Counts", f"- Supported slices: {d['supported_slice_count']}", f"- Helped slices: {d['helped_slice_count']}", f"- Slices with a gap left: {d['residual_slice_count']}"]
    return "\n".join(lines) + "\n"


def diagnostics_note(stability: DataFrame, rates: DataFrame, preference: DataFrame, top: int = 6) -> str:
    """Gaps by order stability, and the `top` slices by order disagreement and by preference for the second place.

    All three have slice_label.
    """
    lines = ["# Diagnostics", "", "## Gap by order stability"]
    wide = stability.groupBy("slice_label").pivot("subset", ["all_families", "order_stable", "order_unstable"]).agg(F.first(F.struct("gap", "n_families")))
    for r in wide.where("all_families IS NOT NULL").orderBy("slice_label").collect():  # one row per slice
        parts = [f"{name} gap {_number(r[c]['gap'], '.3f')} over n={r[c]['n_families']}" for name, c in (("order-stable", "order_stable"), ("order-unstable", "order_unstable")) if r[c] is not None]
        lines.append("; ".join([f"- {r['slice_label']}: all families gap {_number(r['all_families']['gap'], '.3f')}", *parts]))
    lines += ["", "## Order disagreement by variant"]
    for r in rates.orderBy(F.desc("order_disagreement_rate"), "slice_label", "variant_id").limit(top).collect():
        lines.append(f"- {r['slice_label']} / {r['variant_id']}: order disagreement {r['order_disagreement_rate']:.3f}, ties {r['pred_tie_rate']:.3f}, errors {r['variant_error_rate']:.3f}")
    lines += ["", "## Preference for a place", "- A is the candidate that is shown first."]
    for r in preference.orderBy(F.desc("position_bias_second_minus_first"), "slice_label").limit(top).collect():
        lines.append(f"- {r['slice_label']}: second minus first {r['position_bias_second_minus_first']:+.3f}, ties {r['tie_rate']:.3f}, c2 minus c1 {r['underlying_bias_c2_minus_c1']:+.3f}")
    return "\n".join(lines) + "\n"

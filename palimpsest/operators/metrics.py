"""Summary metrics and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = ("n", "base", "gcf", "base_cf", "base_para", "variants", "ties", "disagreements")
#: Columns of a family that the sums are made from.
COUNTED = ("base_correct", "paraphrase_all_correct", "counterfactual_correct", "tie_count", "variant_count", "order_disagreement_count", "gcf_success")


def sums(families: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """The eight integer sums that all metrics follow from; weight: multiplicity in a resample."""
    w = F.lit(1) if weight is None else weight
    parts = (
        F.lit(1), F.col("base_correct"), F.col("gcf_success"), F.col("base_correct") * F.col("counterfactual_correct"),
        F.col("base_correct") * F.col("paraphrase_all_correct"), F.col("variant_count"), F.col("tie_count"), F.col("order_disagreement_count"),
    )
    return families.groupBy(*by).agg(*[F.sum(x * w).cast("long").alias(s) for s, x in zip(SUMS, parts, strict=True)])


def from_sums(df: DataFrame) -> DataFrame:
    """A10; the four rates at base-correct are null where no family is."""
    d = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    out = df.withColumns({
        "n_families": F.col("n"), "n_base_correct": F.col("base"), "n_logical_variants": F.col("variants"),
        "base_acc": d("base", "n"), "gcf_rate": d("gcf", "n"),
        "sensitivity_at_base_correct": d("base_cf", "base"), "invariance_at_base_correct": d("base_para", "base"),
        "tie_rate": d("ties", "variants"), "order_disagreement": d("disagreements", "variants"),
    })
    out = out.drop(*SUMS).withColumnRenamed("gcf_rate", "gcf")
    return out.withColumns({
        "underreaction_at_base_correct": F.lit(1.0) - F.col("sensitivity_at_base_correct"),
        "overreaction_at_base_correct": F.lit(1.0) - F.col("invariance_at_base_correct"), "gap": F.col("base_acc") - F.col("gcf"),
    })


def summary(families: DataFrame, by: list[str] | None = None) -> DataFrame:
    return from_sums(sums(families, by or []).where("n > 0"))


def by_stability(families: DataFrame) -> DataFrame:
    """Four overlapping subsets of the families; empty ones are left out."""
    stable = F.col("order_disagreement_count") == 0
    names = F.array_compact(F.array(
        F.lit("all_families"), F.when(stable, "order_stable"), F.when(~stable, "order_unstable"), F.when(stable & (F.col("tie_count") == 0), "order_stable_no_ties"),
    ))
    out = sums(families.withColumn("subset", F.explode(names)), ["subset"])
    total = families.agg(F.count("*").alias("total"))
    return from_sums(out.crossJoin(F.broadcast(total)).withColumn("share_of_total_families", F.col("n") / F.col("total")).drop("total"))  # one row


def variant_rates(variants: DataFrame) -> DataFrame:
    """Rates per variant; a tie counts as an error."""
    return variants.groupBy("variant_id").agg(
        F.count("*").alias("n_variants"), F.avg("order_disagree").alias("order_disagreement_rate"), F.avg("pred_tie").alias("pred_tie_rate"),
        F.avg(F.greatest("order_tie_ab", "order_tie_ba")).alias("order_tie_any_rate"), F.avg((F.col("pred_winner_cid") != F.col("gold_winner_cid")).cast("int")).alias("variant_error_rate"),
    )


def position_preference(prompts: DataFrame, chosen: Column) -> DataFrame:
    """A15."""
    n = F.count("*")
    c = lambda cond: F.count_if(cond)
    first, second = c(F.col("pred_display_label") == "A"), c(F.col("pred_display_label") == "B")
    one, two = c(chosen == "c1"), c(chosen == "c2")
    rate = lambda x: x / F.nullif(n, F.lit(0))
    return prompts.agg(
        n.alias("n_prompt_instances"), rate(first).alias("first_position_rate"), rate(second).alias("second_position_rate"),
        rate(second - first).alias("position_bias_second_minus_first"), rate(c(F.col("pred_display_label") == "TIE")).alias("tie_rate"),
        rate(one).alias("choose_c1_rate"), rate(two).alias("choose_c2_rate"), rate(two - one).alias("underlying_bias_c2_minus_c1"),
    )


def strict_delta(standard: DataFrame, strict: DataFrame, ci: DataFrame, keys: list[str], metrics: tuple[str, ...], rubric: Column) -> DataFrame:
    """Both prompts side by side; a slice that only one side has is an error.

    Null rates at base-correct stay null, and so does what is computed from them.
    """
    a = standard.select(*keys, *[F.col(m).alias(f"{m}_standard") for m in metrics], F.lit(1).alias("_a"))
    b = strict.select(*keys, *[F.col(m).alias(f"{m}_strict") for m in metrics], F.lit(1).alias("_b"))
    met = a.join(b, keys, "full_outer")
    lone = F.col("_a").isNull() | F.col("_b").isNull()
    met = met.withColumn("_a", F.when(lone, F.raise_error(F.lit("both prompts must cover the same slices"))).otherwise(F.col("_a"))).where("_a = 1").drop("_a", "_b")
    met = met.withColumns({f"{m}_delta": F.col(f"{m}_strict") - F.col(f"{m}_standard") for m in metrics}).join(ci, keys)
    gap = (F.col("gap_strict") >= 0.05) & (F.col("gap_ci_lower") > 0.0)
    sens = rubric & (F.col("sensitivity_at_base_correct_strict") <= 0.90) & (F.col("sens_ci_upper") < 0.95)
    return met.withColumns({"strict_gap_gate": F.coalesce(gap, F.lit(False)), "strict_rubric_gate": F.coalesce(sens, F.lit(False))}).withColumn("gate_passed", F.col("strict_gap_gate") | F.col("strict_rubric_gate"))


def decision(delta: DataFrame) -> DataFrame:
    """A17."""
    out = delta.agg(F.count_if("gate_passed").alias("supported_slice_count"), F.count_if(F.col("gap_delta") <= -0.01).alias("helped_slice_count"), F.count_if(F.col("gap_strict") > 0.0).alias("residual_slice_count"))
    status = F.when(F.col("supported_slice_count") > 0, "supported").when((F.col("helped_slice_count") > 0) & (F.col("residual_slice_count") > 0), "partially supported").otherwise("unsupported")
    return out.withColumn("status", status)

"""From scores of both orders to variant and family results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.fixed import TIE_EPSILON


def winner(c1: Column, c2: Column) -> Column:
    """A tie within epsilon, else the larger."""
    return F.when(F.abs(c1 - c2) <= F.lit(TIE_EPSILON), "tie").when(c1 > c2, "c1").otherwise("c2")


def display_label(a: Column, b: Column) -> Column:
    """X19."""
    return F.when(F.abs(a - b) <= F.lit(TIE_EPSILON), "TIE").when(a > b, "A").otherwise("B")


def variant_results(scores: DataFrame) -> DataFrame:
    """Mirror-averaged scores and predictions per (family, variant)."""
    s = scores
    for c in ("c1", "c2"):
        s = s.withColumn(f"scores_agg_{c}", F.lit(0.5) * (F.col(f"scores_ab_{c}") + F.col(f"scores_ba_{c}")))
    for at, name in (("agg", "pred_winner_cid"), ("ab", "order_pred_ab"), ("ba", "order_pred_ba")):
        s = s.withColumn(name, winner(F.col(f"scores_{at}_c1"), F.col(f"scores_{at}_c2")))
    flag = lambda c: c.cast("int")
    return s.withColumns({
        "pred_tie": flag(F.col("pred_winner_cid") == "tie"), "order_tie_ab": flag(F.col("order_pred_ab") == "tie"),
        "order_tie_ba": flag(F.col("order_pred_ba") == "tie"), "order_disagree": flag(F.col("order_pred_ab") != F.col("order_pred_ba")),
    })


def prompt_results(scores: DataFrame) -> DataFrame:
    """One row per order; AB shows c1 as A, BA shows c2 as A."""
    order = F.explode(F.array(F.lit("AB"), F.lit("BA"))).alias("order_id")
    p = scores.select("*", order)
    ab = F.col("order_id") == "AB"
    p = p.withColumns({
        "displayed_cid_a": F.when(ab, "c1").otherwise("c2"), "displayed_cid_b": F.when(ab, "c2").otherwise("c1"),
        "score_a": F.when(ab, F.col("scores_ab_c1")).otherwise(F.col("scores_ba_c2")), "score_b": F.when(ab, F.col("scores_ab_c2")).otherwise(F.col("scores_ba_c1")),
    })
    return p.withColumn("score_gap", F.col("score_a") - F.col("score_b")).withColumn("pred_display_label", display_label(F.col("score_a"), F.col("score_b")))


def chosen(prompts: DataFrame) -> Column:
    """The candidate behind the label; null for a tie."""
    return F.when(F.col("pred_display_label") == "A", F.col("displayed_cid_a")).when(F.col("pred_display_label") == "B", F.col("displayed_cid_b"))


def family_results(variants: DataFrame, keys: tuple[str, ...] = ("family_id",)) -> DataFrame:
    """One row per family; families without the four variants are an error."""
    right = (F.col("pred_winner_cid") == F.col("gold_winner_cid")).cast("int")
    of = lambda v: F.max(F.when(F.col("variant_id") == v, right))
    out = variants.groupBy(*keys).agg(
        of("base").alias("base_correct"),
        F.min(F.when(~F.col("variant_id").isin("base", "counterfactual"), right)).alias("paraphrase_all_correct"),
        of("counterfactual").alias("counterfactual_correct"),
        F.sum("pred_tie").alias("tie_count"), F.count("*").alias("variant_count"), F.sum("order_disagree").alias("order_disagreement_count"),
        F.count_distinct("variant_id").alias("_kinds"),
    )
    bad = (F.col("_kinds") != 4) | (F.col("variant_count") != 4)
    checked = F.when(bad, F.raise_error(F.lit("a family must hold its four variants once each"))).otherwise(F.col("base_correct"))
    out = out.withColumn("base_correct", checked).drop("_kinds")
    return out.withColumn("gcf_success", F.col("base_correct") * F.col("paraphrase_all_correct") * F.col("counterfactual_correct"))

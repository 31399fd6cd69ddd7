"""Contracts as one array of violations per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.fixed import KINDS, RELATIONS, SLOTS, SPLITS, VARIANTS


def violations(checks: dict[str, Column]) -> Column:
    """Names of the checks that do not hold, in order; a null check does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def filled_in(*columns: str) -> dict[str, Column]:
    return {f"blank_{c}": F.trim(F.col(c)) != "" for c in columns}


def qa_item(types: dict[str, str] | None = None) -> Column:
    """No blank field, and the relation's frozen coarse type."""
    types = types or {k: v[1] for k, v in RELATIONS.items()}
    frozen = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    return violations(filled_in("qa_id", "subject_id", "answer_text", "answer_norm") | {"unknown_relation": frozen[F.col("relation_id")].isNotNull(), "wrong_coarse_type": frozen[F.col("relation_id")] == F.col("coarse_type")})


def entity_fact() -> Column:
    """V03."""
    return violations(filled_in("entity_id", "entity_name", "value_text", "value_norm") | {"disallowed_slot": F.col("slot").isin(*SLOTS)})


def manifest(df: DataFrame, id_col: str = "anchor_id") -> DataFrame:
    """Rows with their violations; duplicates are counted by id, with one shuffle."""
    n = df.groupBy(id_col).agg(F.count("*").alias("_n"))
    met = df.join(n, id_col, "left")
    checks = filled_in(id_col) | {"unknown_split": F.col("split").isin(*SPLITS), "bucket_out_of_range": F.col("bucket").between(0, 19), "duplicate_id": F.col("_n") == 1}
    return met.withColumn("violations", violations(checks)).drop("_n")


def family(task: str = "qa_key") -> Column:
    """V01 on a nested family: candidates, variants, kinds, gold winners, paraphrases that keep and a
    counterfactual that flips meaning and gold."""
    v, c = F.col("variants"), F.col("candidates")
    want = F.array(*[F.lit(x) for x in VARIANTS[task]])
    ids, cids = F.transform(v, lambda x: x["variant_id"]), F.transform(c, lambda x: x["cid"])
    kind_of = F.create_map(*[F.lit(x) for kv in zip(VARIANTS[task], KINDS, strict=True) for x in kv])
    base = F.filter(v, lambda x: x["variant_id"] == "base")[0]
    para, flip = F.filter(v, lambda x: x["kind"] == "paraphrase"), F.filter(v, lambda x: x["kind"] == "counterfactual")
    return violations({
        "unknown_split": F.col("split").isin(*SPLITS),
        "wrong_candidates": F.array_sort(cids) == F.array(F.lit("c1"), F.lit("c2")),
        "wrong_variants": F.array_sort(ids) == F.array_sort(want),
        "kind_mismatch": F.forall(v, lambda x: kind_of[x["variant_id"]] == x["kind"]),
        "gold_not_a_candidate": F.forall(v, lambda x: F.array_contains(cids, x["gold_winner_cid"])),
        "paraphrase_changed": F.forall(para, lambda x: (x["semantics_id"] == base["semantics_id"]) & (x["gold_winner_cid"] == base["gold_winner_cid"])),
        "counterfactual_not_flipped": F.forall(flip, lambda x: (x["semantics_id"] != base["semantics_id"]) & (x["gold_winner_cid"] != base["gold_winner_cid"])),
    })


def abort_on(df: DataFrame, column: str = "violations", show: int = 5) -> DataFrame:
    """df if no row has a violation; else an error with the first few."""
    bad = df.where(F.size(column) > 0).select(column).limit(show).collect()
    if bad:
        raise ValueError(f"rows break their contract: {[r[0] for r in bad]}")
    return df

"""Raw facts to canonical tables with their split and their skip counters (L2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.fixed import SLOTS
from palimpsest.functions import text as X
from palimpsest.operators.rendering import question


def required(c: str) -> Column:
    """Trimmed; a missing or blank required field aborts the build."""
    t = F.trim(F.col(c))
    return F.when(t.isNull() | (t == ""), F.raise_error(F.lit(f"field {c} is missing or blank"))).otherwise(t)


def aliases(c: Column) -> Column:
    """Normalized, without empty ones, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), X.normalize), lambda x: x.isNotNull() & (x != ""))))


def qa_reasons(raw: DataFrame, relations: DataFrame) -> DataFrame:
    """Every raw row with answer_norm, relation columns, and skip_reason (null: it is kept).

    First failing reason wins: relation, empty normalization, several answers to one question (A04:
    spelling counts), then duplicates, of which the first by (object, source) stays.
    """
    met = raw.join(F.broadcast(relations), "relation_id", "left").withColumn("answer_norm", X.normalize(F.col("object_text")))  # the relations are a fixed list
    # Null object ids are values here, so both sides are structs.
    key = F.struct("object_id", "answer_norm")
    early = F.when(F.col("relation_name").isNull(), "relation_not_whitelisted").when(F.coalesce(F.col("answer_norm"), F.lit("")) == "", "empty_answer_after_normalization")
    met = met.withColumn("_early", early)
    own = Window.partitionBy("subject_id", "relation_id")
    live = F.when(F.col("_early").isNull(), key)
    met = met.withColumn("_several", F.min(live).over(own) != F.max(live).over(own))
    first = own.orderBy(F.col("_early").isNotNull(), "object_id", "object_text", "source_ref")
    met = met.withColumn("_at", F.row_number().over(first))
    late = F.when(F.col("_several"), "multi_gold_object").when(F.col("_at") > 1, "duplicate_row")
    return met.withColumn("skip_reason", F.coalesce("_early", late)).drop("_early", "_several", "_at")


def qa_items(reasons: DataFrame) -> DataFrame:
    out = reasons.where("skip_reason IS NULL").withColumn("qa_id", F.concat_ws(":", "subject_id", "relation_id"))
    out = out.withColumn("question", question(F.col("question_template"), F.col("subject_text")))
    return out.select("qa_id", "question", "subject_id", "subject_text", "relation_id", "relation_name", F.col("object_id").alias("answer_id"), F.col("object_text").alias("answer_text"), "answer_norm", "coarse_type", "source_ref")


def fact_reasons(raw: DataFrame) -> DataFrame:
    """Human, slot, empty normalization, then duplicates of (entity, slot, value): the first stays."""
    met = raw.withColumn("value_norm", X.normalize(F.col("value_text")))
    early = F.when(~F.col("is_human"), "non_human_entity").when(~F.col("slot").isin(*SLOTS), "disallowed_slot").when(F.col("value_norm") == "", "empty_value_after_normalization")
    met = met.withColumn("_early", early)
    at = F.row_number().over(Window.partitionBy("entity_id", "slot", "value_id").orderBy(F.col("_early").isNotNull(), "value_text", "source_ref"))
    return met.withColumn("skip_reason", F.coalesce("_early", F.when(at > 1, "duplicate_row"))).drop("_early")


def facts(reasons: DataFrame) -> DataFrame:
    return reasons.where("skip_reason IS NULL").select("entity_id", "entity_name", "slot", "value_id", "value_text", "value_norm", "source_ref")


def skip_counts(reasons: DataFrame) -> DataFrame:
    """Absent reasons are left out."""
    return reasons.where("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count("*").alias("n"))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of equal keys the last by order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def best_rank(claims: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """Without deprecated claims; preferred ones where there are any, else normal ones."""
    live = claims.where(F.col(rank).isin("preferred", "normal"))
    has = F.max((F.col(rank) == "preferred").cast("int")).over(Window.partitionBy(*keys))
    return live.withColumn("_has", has).where((F.col("_has") == 0) | (F.col(rank) == "preferred")).drop("_has")

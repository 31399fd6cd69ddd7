"""Quality reports of the canonical tables (A01, A02, A25): all counters from one scan, zeros told.

report() counts over GROUPING SETS of the rows with their skip reasons; written() observes the same
counters while the table is written, so a build reads its source once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from palimpsest.fixed import SLOTS, SPLITS
from palimpsest.functions import text as X
from palimpsest.sources.sinks import write_json

# The reasons for which rows are skipped, in the order in which they win.
QA_SKIPS = ("relation_not_whitelisted", "empty_answer_after_normalization", "multi_gold_object", "duplicate_row")
FACT_SKIPS = ("non_human_entity", "disallowed_slot", "empty_value_after_normalization", "duplicate_row")



def _kept() -> Column:
    return F.col("skip_reason").isNull()


def _live() -> Column:
    """Of a listed relation and with an answer."""
    return _kept() | F.col("skip_reason").isin("multi_gold_object", "duplicate_row")


def _split(anchor: str) -> Column:
    return X.split_of(X.split_bucket(F.col(anchor)))


def _long(spark, sets: DataFrame, told: Sequence[tuple[str, Column, Column, Column]]) -> DataFrame:
    """(counter, key, n) from rows of grouping sets: told holds for each counter which rows are its own, their key and number."""
    each = F.array(*[F.struct(F.lit(c).alias("counter"), own.alias("own"), key.cast("string").alias("key"), n.cast("long").alias("n")) for c, own, key, n in told])
    return sets.select(F.explode(each).alias("x")).where("x.own").select("x.counter", "x.key", "x.n")


def _with_zeros(found: DataFrame, keys: dict[str, Sequence[str]]) -> DataFrame:
    """Zeros for keys that did not occur; other keys of these counters, and rows of null keys, go. keys are fixed lists."""
    zeros = found.sparkSession.createDataFrame([(c, k, 0) for c, ks in keys.items() for k in ks], "counter string, key string, n long")
    known = reduce(lambda a, b: a | b, [(F.col("counter") == c) & F.col("key").isin(*ks) for c, ks in keys.items()], ~F.col("counter").isin(*keys))
    return zeros.unionByName(found.where(F.col("key").isNotNull() & known)).groupBy("counter", "key").agg(F.sum("n").alias("n"))


def qa_report(reasons: DataFrame, relation_ids: Sequence[str], coarse_types: Sequence[str]) -> DataFrame:
    """counter, key, n of canonical.qa_reasons(): rows read, alive, in groups, kept, by reason, relation, type and split of the anchor."""
    rows = reasons.select("subject_id", "relation_id", "coarse_type", "skip_reason", _split("subject_id").alias("split"), F.struct("subject_id", "relation_id").alias("pair"))
    n, kept = F.count("*").alias("n"), F.count_if(_kept()).alias("kept")
    sets = rows.groupingSets([[], [F.col("skip_reason")], [F.col("relation_id")], [F.col("coarse_type")], [F.col("split")]], "skip_reason", "relation_id", "coarse_type", "split").agg(
        F.grouping_id().alias("gid"), n, kept, F.count_if(_live()).alias("live"), F.count_if(F.col("skip_reason") == "duplicate_row").alias("duplicates"),
        F.count_if(F.coalesce(F.col("skip_reason") != "relation_not_whitelisted", F.lit(True))).alias("listed"),
        F.count_distinct(F.when(_live(), F.col("pair"))).alias("groups"), F.count_distinct(F.when(_kept(), F.col("subject_id"))).alias("anchors"),
    )
    # A bit is set where the column is not part of the set.
    whole, by_reason, by_relation, by_type, by_split = (F.col("gid") == g for g in (15, 7, 11, 13, 14))
    none = F.lit("")
    found = _long(reasons.sparkSession, sets, [
        ("input_row_count", whole, none, F.col("n")), ("rows_after_whitelist_and_normalization", whole, none, F.col("live")), ("group_count", whole, none, F.col("groups")),
        ("output_row_count", whole, none, F.col("kept")), ("duplicate_raw_row_count", whole, none, F.col("duplicates")), ("skip_reasons", by_reason, F.col("skip_reason"), F.col("n")),
        ("relation_input_counts", by_relation, F.col("relation_id"), F.col("listed")), ("relation_output_counts", by_relation, F.col("relation_id"), F.col("kept")),
        ("coarse_type_output_counts", by_type, F.col("coarse_type"), F.col("kept")), ("split_counts", by_split, F.col("split"), F.col("anchors")),
    ])
    whole_table = ("input_row_count", "rows_after_whitelist_and_normalization", "group_count", "output_row_count", "duplicate_raw_row_count")
    return _with_zeros(found, dict.fromkeys(whole_table, [""]) | {"skip_reasons": QA_SKIPS, "relation_input_counts": relation_ids, "relation_output_counts": relation_ids, "coarse_type_output_counts": coarse_types, "split_counts": SPLITS})


def fact_report(reasons: DataFrame) -> DataFrame:
    """counter, key, n of canonical.fact_reasons(): rows and entities by slot, anchors by split, rows by reason."""
    rows = reasons.select("entity_id", "slot", "skip_reason", _split("entity_id").alias("split"))
    sets = rows.groupingSets([[], [F.col("skip_reason")], [F.col("slot")], [F.col("split")]], "skip_reason", "slot", "split").agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n"), F.count_if(_kept()).alias("kept"), F.count_if(F.col("skip_reason") == "duplicate_row").alias("duplicates"),
        F.count_distinct(F.when(_kept(), F.col("entity_id"))).alias("entities"),
    )
    whole, by_reason, by_slot, by_split = (F.col("gid") == g for g in (7, 3, 5, 6))
    none = F.lit("")
    found = _long(reasons.sparkSession, sets, [
        ("input_row_count", whole, none, F.col("n")), ("output_row_count", whole, none, F.col("kept")), ("duplicate_raw_row_count", whole, none, F.col("duplicates")),
        ("skip_reasons", by_reason, F.col("skip_reason"), F.col("n")), ("slot_row_counts", by_slot, F.col("slot"), F.col("kept")), ("slot_entity_counts", by_slot, F.col("slot"), F.col("entities")),
        ("split_counts", by_split, F.col("split"), F.col("entities")),
    ])
    return _with_zeros(found, dict.fromkeys(("input_row_count", "output_row_count", "duplicate_raw_row_count"), [""]) | {"skip_reasons": FACT_SKIPS, "slot_row_counts": SLOTS, "slot_entity_counts": SLOTS, "split_counts": SPLITS})


def written(reasons: DataFrame, kept: Callable[[DataFrame], DataFrame], path: str, *, anchor: str, skips: Sequence[str], by: dict[str, tuple[str, Sequence[str]]], task_family: str) -> dict:
    """A canonical table with its split manifest and quality report, whose counters arise while the table is written.

    kept makes the table of the rows with their reasons (canonical.qa_items, canonical.facts). by: of each
    counter over kept rows its column and that column's fixed values. Values of no list are not told apart.
    """
    seen, split_seen = Observation(), Observation()
    count = lambda cond, name: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    counters = [F.count("*").alias("input_row_count"), count(_kept(), "output_row_count"), *[count(F.col("skip_reason") == s, f"skip_reasons {s}") for s in skips]]
    counters += [count(_kept() & (F.col(c) == k), f"{name} {k}") for name, (c, keys) in by.items() for k in keys]
    kept(reasons.observe(seen, *counters)).write.mode("overwrite").parquet(f"{path}/items")
    anchors = reasons.sparkSession.read.parquet(f"{path}/items").select(anchor).distinct().withColumn("bucket", X.split_bucket(F.col(anchor))).withColumn("split", _split(anchor))
    anchors.observe(split_seen, *[count(F.col("split") == s, s) for s in SPLITS]).write.mode("overwrite").parquet(f"{path}/split_manifest")
    held: dict = {"task_family": task_family, "split_counts": split_seen.get}
    for name, n in seen.get.items():
        counter, _, key = name.partition(" ")
        held[counter] = held.get(counter, {}) | {key: n} if key else n
    held["duplicate_raw_row_count"] = held["skip_reasons"].get("duplicate_row", 0)
    write_json(held, f"{path}/qc.json", reasons.sparkSession)
    return held

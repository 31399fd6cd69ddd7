"""Families from canonical tables: donors for keyed answers, slots for rubrics (L3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.fixed import FORBIDDEN, SHARED_SLOT, SLOT_PRIORITY
from palimpsest.functions import text as X
from palimpsest.operators.rendering import sentence
from palimpsest.operators.resample import ordinals
from palimpsest.sources.shared import workspace

POOL = ["relation_id", "coarse_type", "split"]
CHECKS = (
    "different_subject_id", "different_answer_id", "different_answer_norm", "different_from_gold_aliases", "forbidden_char_absent", "forbidden_and_absent",
    "token_count_in_range", "char_length_in_range", "char_length_ratio_in_range",
)


#: Values that are kept of a bucket of equal lengths, and of all buckets around an anchor's, ring by ring: nearly all anchors find theirs in the first.
RINGS = (8, 64, 512)


def aliased(items: DataFrame) -> DataFrame:
    """items with answer_aliases_norm (the answer itself where there is none), subject_id and lengths of the answer."""
    out = items if "answer_aliases_norm" in items.columns else items.withColumn("answer_aliases_norm", F.array("answer_norm"))
    if "subject_id" not in items.columns:
        out = out.withColumn("subject_id", F.lit(None).cast("string"))  # then no two rows have the same
    return out.withColumn("tokens", X.token_count(F.col("answer_norm"))).withColumn("chars", X.char_length(F.col("answer_norm")))


def answers(items: DataFrame) -> DataFrame:
    """Distinct answers per pool: least qa_id, its subject, and number of rows, with lengths."""
    held = ["answer_id", "answer_norm", "answer_text", "answer_aliases_norm", "tokens", "chars"]
    return aliased(items).groupBy(*POOL, *held).agg(F.min("qa_id").alias("qa_id"), F.min_by("subject_id", "qa_id").alias("subject_id"), F.count("*").alias("n_rows"))


def donor_only() -> dict[str, Column]:
    """Checks that look at the donor alone: they hold below the join."""
    date = F.col("coarse_type") == "date"
    return {
        "forbidden_char_absent": ~F.col("answer_norm").rlike(FORBIDDEN), "forbidden_and_absent": ~F.contains("answer_norm", F.lit(" and ")),
        "token_count_in_range": F.when(date, F.col("tokens").between(1, 4)).otherwise(F.col("tokens").between(1, 6)),
        "char_length_in_range": F.when(date, F.col("chars").between(4, 20)).otherwise(F.col("chars").between(2, 40)),
    }


def pairs(items: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Pairs of anchor and donor answers of each pool with the named checks (for looking into, not for choosing).

    anchors (qa_id): only answers of these rows are anchors, so as many pairs arise as they have pools'
    answers. Without it every answer is one, which is for pools of few distinct answers.
    """
    donors = answers(items).withColumns(donor_only())
    held = answers(items if anchors is None else items.join(anchors.select("qa_id").distinct(), "qa_id", "left_semi"))
    d = donors.select(*POOL, *[F.col(c).alias(f"d_{c}") for c in donors.columns if c not in POOL])
    p = held.join(d, POOL)
    return p.withColumns({
        "different_subject_id": F.coalesce(F.col("subject_id") != F.col("d_subject_id"), F.lit(True)), "different_answer_id": F.coalesce(F.col("answer_id") != F.col("d_answer_id"), F.lit(True)), "different_answer_norm": F.col("answer_norm") != F.col("d_answer_norm"),
        "different_from_gold_aliases": ~F.array_contains("answer_aliases_norm", F.col("d_answer_norm")),
        **{c: F.col(f"d_{c}") for c in donor_only()},
        "char_length_ratio_in_range": ratio_fits(F.col("d_chars"), F.col("chars")),
    })


def ratio_fits(donor: Column, own: Column) -> Column:
    return F.coalesce((donor / own).between(0.67, 1.5), F.lit(False))


def admissible() -> Column:
    out = F.lit(True)
    for c in CHECKS:
        out &= F.col(c)
    return out


def _identifier(prefix: str = "") -> Column:
    return F.coalesce(F.nullif(F.col(f"{prefix}answer_id"), F.lit("")), F.col(f"{prefix}qa_id"))


def donors_of(rows: DataFrame) -> DataFrame:
    """Rows that can be a donor at all; of equal values the few among which every anchor finds the first that suits it.

    An anchor rejects one id and one subject. So of a value's rows with one id the first two with
    different subjects matter, of those with one subject the first two with different ids, and of what
    is left the first five: however many ids and rows a value has, it brings five at most. A null
    id or subject is never rejected, so its rows count as one group too.
    """
    value = [*POOL, "answer_norm", "tokens", "chars"]
    fine = rows.withColumns(donor_only()).where(" AND ".join(donor_only()))
    order = F.struct(_identifier().alias("ident"), "qa_id", "answer_text")
    held = fine.groupBy(*value, "answer_id", "subject_id").agg(F.min(order).alias("_o"))
    for keys, most in (([*value, "answer_id"], 2), ([*value, "subject_id"], 2), (value, 5)):
        held = held.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("_o"))).where(F.col("_at") <= most).drop("_at")
    return held.select(*value, "answer_id", "subject_id", "_o.qa_id", "_o.answer_text")


def values_of(donors: DataFrame) -> DataFrame:
    """A row per value of a pool with its donors, five at most, in the order of choice."""
    donor = F.struct(_identifier().alias("ident"), F.col("qa_id").alias("d_qa_id"), F.col("answer_id").alias("d_answer_id"), F.col("subject_id").alias("d_subject_id"), F.col("answer_text").alias("d_answer_text"))
    return donors.groupBy(*POOL, F.col("answer_norm").alias("d_answer_norm"), F.col("tokens").alias("d_tokens"), F.col("chars").alias("d_chars")).agg(F.sort_array(F.collect_list(donor)).alias("donors"))


def nearest(rows: DataFrame, values: DataFrame, most: int) -> DataFrame:
    """For each pool and (tokens, chars) of rows the `most` nearest values in the order of choice, and whether these are all.

    Donors are bounded in length, so a pool has a bounded number of buckets (tokens, chars), and of
    each only the first `most` can be among the nearest of any anchor: what is joined here does
    not grow with the rows.
    """
    bucket = [*POOL, "d_tokens", "d_chars"]
    sizes = values.groupBy(*bucket).agg(F.count("*").alias("_n"))
    first = values.withColumn("_at", F.row_number().over(Window.partitionBy(*bucket).orderBy("d_answer_norm"))).where(F.col("_at") <= most)
    lengths = rows.select(*POOL, "tokens", "chars").distinct()
    fits = ratio_fits(F.col("d_chars"), F.col("chars"))
    whole = [*POOL, "tokens", "chars"]
    order = F.struct(F.abs(F.col("tokens") - F.col("d_tokens")).alias("t"), F.abs(F.col("chars") - F.col("d_chars")).alias("c"), "d_answer_norm")
    met = lengths.join(first, POOL).where(fits).withColumn("_o", order).withColumn("_rank", F.row_number().over(Window.partitionBy(*whole).orderBy("_o"))).where(F.col("_rank") <= most)
    near = met.groupBy(*whole).agg(F.sort_array(F.collect_list(F.struct("_rank", "d_answer_norm", "donors"))).alias("near"))
    every = lengths.join(sizes, POOL).where(fits).groupBy(*whole).agg(F.sum("_n").alias("_all"))
    return near.join(every, whole).select(*whole, "near", (F.col("_all") <= most).alias("complete"))


def _first_that_suits(near: Column) -> Column:
    """Of the nearest values in order, without the anchor's own and its aliases, the first donor of another id and subject."""
    other = lambda c, d: F.coalesce(F.col(c) != d[f"d_{c}"], F.lit(True))
    of = F.filter(near, lambda v: (F.col("answer_norm") != v["d_answer_norm"]) & ~F.array_contains("answer_aliases_norm", v["d_answer_norm"]))
    return F.get(F.flatten(F.transform(of, lambda v: F.filter(v["donors"], lambda d: other("subject_id", d) & other("answer_id", d)))), F.lit(0))


def _kept(df: DataFrame, at: str) -> DataFrame:
    """df as a written table: made once, whoever reads it."""
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _of_whole_pool(rest: DataFrame, donors: DataFrame) -> DataFrame:
    """The donor of anchors that reject everything near them: each meets all values of its pool."""
    d = donors.select(*POOL, *[F.col(c).alias(f"d_{c}") for c in donors.columns if c not in POOL])
    other = lambda c: F.coalesce(F.col(c) != F.col(f"d_{c}"), F.lit(True))
    suits = other("subject_id") & other("answer_id") & (F.col("answer_norm") != F.col("d_answer_norm")) & ~F.array_contains("answer_aliases_norm", F.col("d_answer_norm"))
    wide = rest.join(d, POOL).where(ratio_fits(F.col("d_chars"), F.col("chars")) & suits)
    order = F.struct(F.abs(F.col("tokens") - F.col("d_tokens")), F.abs(F.col("chars") - F.col("d_chars")), "d_answer_norm", _identifier("d_"), "d_qa_id")
    return wide.groupBy("qa_id", *POOL, "answer_text").agg(F.min_by(F.struct("d_qa_id", "d_answer_text"), order).alias("donor"))


def chosen_donors(items: DataFrame) -> DataFrame:
    """Per anchor row the admissible donor nearest in tokens, then characters, then by text and id.

    Items are read once and written to the session's workspace. An anchor meets the list of the
    nearest values for its lengths and takes the first donor that suits. Values, not rows, are
    listed, so an anchor finds none only if it rejects nearly all of a list by its aliases or its
    subject; those few go outward to ever longer lists, and what is left at the end searches its pool.
    """
    spark = items.sparkSession
    at = workspace(spark, "donors")
    left = _kept(aliased(items).select("qa_id", *POOL, "subject_id", "answer_id", "answer_norm", "answer_text", "answer_aliases_norm", "tokens", "chars"), f"{at}/items")
    donors = _kept(donors_of(left), f"{at}/donors")
    values = values_of(donors)
    out = None
    said = ["qa_id", *POOL, "answer_text"]
    for most in RINGS:
        met = left.join(nearest(left, values, most), [*POOL, "tokens", "chars"]).withColumn("donor", _first_that_suits(F.col("near"))).drop("near")
        met = _kept(met, f"{at}/ring-{most}")
        found = met.where("donor IS NOT NULL").select(*said, "donor.d_qa_id", "donor.d_answer_text")
        out = found if out is None else out.union(found)
        left = met.where("donor IS NULL AND NOT complete").drop("complete", "donor")
        if left.isEmpty():
            break
    else:
        out = out.union(_of_whole_pool(left, donors).select(*said, "donor.d_qa_id", "donor.d_answer_text"))
    return out.select(*said, F.col("d_qa_id").alias("donor_qa_id"), F.col("d_answer_text").alias("donor_answer_text"))


def invalid_anchors(items: DataFrame) -> DataFrame:
    """One row per anchor without a donor: qa_id, pool, donor_pool_size, and by check how many rows of its pool fail it.

    Failures are counted, not listed: per pool for what the donor alone decides, per value for what
    compares values, and per length for the ratio, so no pair is made.
    """
    rows = aliased(items)
    lone = rows.join(chosen_donors(items).select("qa_id"), "qa_id", "left_anti")
    failed = lambda c: F.count_if(~c)
    pools = rows.groupBy(*POOL).agg(F.count("*").alias("donor_pool_size"), *[failed(c).alias(name) for name, c in donor_only().items()])
    out = lone.join(pools, POOL)
    for column, name in (("subject_id", "different_subject_id"), ("answer_id", "different_answer_id"), ("answer_norm", "different_answer_norm")):
        held = rows.where(F.col(column).isNotNull()).groupBy(*POOL, column).agg(F.count("*").alias(name))
        out = out.join(held, [*POOL, column], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    norms = rows.groupBy(*POOL, F.col("answer_norm").alias("_alias")).agg(F.count("*").alias("_n"))
    named = lone.select("qa_id", *POOL, F.explode(F.array_distinct("answer_aliases_norm")).alias("_alias")).join(norms, [*POOL, "_alias"])
    out = out.join(named.groupBy("qa_id").agg(F.sum("_n").alias("different_from_gold_aliases")), "qa_id", "left").withColumn("different_from_gold_aliases", F.coalesce("different_from_gold_aliases", F.lit(0)))
    lengths = rows.groupBy(*POOL, "chars").agg(F.count("*").alias("_n"))
    others = lengths.withColumnsRenamed({"chars": "d_chars"})
    off = lone.select(*POOL, "chars").distinct().join(others, POOL).where(~ratio_fits(F.col("d_chars"), F.col("chars"))).groupBy(*POOL, "chars").agg(F.sum("_n").alias("char_length_ratio_in_range"))
    out = out.join(off, [*POOL, "chars"], "left").withColumn("char_length_ratio_in_range", F.coalesce("char_length_ratio_in_range", F.lit(0)))
    family = F.concat(F.lit("qakey_"), F.replace("qa_id", F.lit(":"), F.lit("_"))).alias("family_id")
    return out.select(family, "qa_id", *POOL, F.lit("no_admissible_donor").alias("skip_reason"), "donor_pool_size", *CHECKS)


def failure_counts(items: DataFrame) -> DataFrame:
    """Over all invalid anchors and the rows of their pools, how often each check fails."""
    each = F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("n")) for c in CHECKS])
    long = invalid_anchors(items).select(F.explode(each).alias("x")).select("x.*").where("n > 0")
    return long.groupBy("check_name").agg(F.sum("n").cast("long").alias("n"))


def admissible_value(norm: Column) -> Column:
    """P08, P09."""
    return (norm != "") & X.token_count(norm).between(1, 8) & X.char_length(norm).between(2, 60) & ~norm.rlike(FORBIDDEN) & ~F.contains(norm, F.lit(" and "))


def slot_values(facts: DataFrame) -> DataFrame:
    """Per (entity, slot, value_norm) the least fact; place by value_norm within the slot."""
    fine = facts.where(admissible_value(F.col("value_norm")))
    one = fine.groupBy("entity_id", "slot", "value_norm").agg(F.min(F.struct("value_text", "value_id", "source_ref")).alias("v"))
    own = Window.partitionBy("entity_id", "slot")
    return one.select("entity_id", "slot", "value_norm", "v.value_text", F.row_number().over(own.orderBy("value_norm")).alias("place"), F.count("*").over(own).alias("n_values"))


def rubric_outcomes(facts: DataFrame) -> DataFrame:
    """One row per entity with its slot, texts and skip_reason (null: a family).

    Only the first slot of the priority with two values is tried.
    """
    names = facts.groupBy("entity_id").agg(F.min_by("entity_name", F.struct("slot", "value_norm", "value_id")).alias("entity_name"))
    v = slot_values(facts)
    order = F.array_position(F.array(*[F.lit(s) for s in SLOT_PRIORITY]), F.col("slot"))
    shared = v.where((F.col("slot") == SHARED_SLOT) & (F.col("place") == 1)).select("entity_id", F.col("value_text").alias("shared_text"))
    two = v.where((F.col("slot") != SHARED_SLOT) & (F.col("n_values") >= 2) & (F.col("place") <= 2)).groupBy("entity_id", order.alias("priority"), "slot").agg(
        F.max(F.when(F.col("place") == 1, F.col("value_text"))).alias("f1_text"), F.max(F.when(F.col("place") == 2, F.col("value_text"))).alias("f2_text"))
    slot = two.groupBy("entity_id").agg(F.min_by(F.struct("slot", "f1_text", "f2_text"), "priority").alias("s")).select("entity_id", "s.*")
    out = names.join(shared, "entity_id", "left").join(slot, "entity_id", "left")
    name = F.col("entity_name")
    text = lambda c: F.concat_ws(" ", sentence(F.lit(SHARED_SLOT), name, F.col("shared_text")), sentence(F.col("slot"), name, F.col(c)))
    out = out.withColumn("c1_text", text("f1_text")).withColumn("c2_text", text("f2_text"))
    a, b = (X.token_count(X.normalize(F.col(c))) for c in ("c1_text", "c2_text"))
    out = out.withColumn("length_ratio", X.ratio_or_inf(F.greatest(a, b).cast("double"), F.least(a, b)))
    reason = F.when(F.col("shared_text").isNull(), "no_shared_occupation").when(F.col("slot").isNull(), "no_distinguishing_slot").when(F.col("length_ratio") > 1.25, "candidate_length_ratio_exceeded")
    return out.withColumn("skip_reason", reason)


def invalid_entities(facts: DataFrame) -> DataFrame:
    """A07 for rubrics: one row per entity without a family: ids, skip_reason, source_row_count, and its rows and
    admissible values by slot as `slot:n`, in order of the slots."""
    lone = rubric_outcomes(facts).where("skip_reason IS NOT NULL").select("entity_id", "entity_name", "skip_reason")
    fine = F.count_distinct(F.when(admissible_value(F.col("value_norm")), F.col("value_norm")))
    per = facts.groupBy("entity_id", "slot").agg(F.count("*").alias("n"), fine.alias("fine"))
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", c))), lambda x: F.concat_ws(":", x["slot"], x[c])), ",")
    counts = per.groupBy("entity_id").agg(F.sum("n").alias("source_row_count"), listed("n").alias("slot_row_counts"), listed("fine").alias("admissible_slot_counts"))
    return lone.join(counts, "entity_id").select(F.concat(F.lit("biorubric_"), "entity_id").alias("family_id"), "entity_id", "entity_name", "skip_reason", "source_row_count", "slot_row_counts", "admissible_slot_counts")


def freeze(df: DataFrame, targets: dict[str, int], id_col: str = "family_id") -> DataFrame:
    """Rows with their place in the split by id, and whether the split's target takes them.

    Places are ordinals: they are counted within ranges of the id, so no split is sorted in one task.
    """
    goal = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])[F.col("split")]
    placed = ordinals(df, ["split"], id_col).withColumn("place", F.col("ordinal") + 1).drop("ordinal")
    return placed.withColumn("selected", F.coalesce(F.col("place") <= goal, F.lit(False)))


def freeze_stats(frozen: DataFrame) -> DataFrame:
    """A21, A24."""
    out = frozen.groupBy("split").agg(F.count("*").alias("available"), F.count_if("selected").alias("selected"))
    return out.withColumns({"discarded": F.col("available") - F.col("selected"), "n_candidates": 2 * F.col("selected"), "n_variants": 4 * F.col("selected")})

"""Entity payloads as text to fact rows without a fixed schema (S15, P26-P28): VARIANT, and broken claims counted.

A payload is parsed once where it is read; what is not JSON, not an object, or a claim that says
nothing usable is told by name instead of becoming null or ending the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import variable_date
from palimpsest.operators.claims import eligible

HUMAN, INSTANCE_OF, OCCUPATION = "Q5", "P31", "P106"
VALUE = "$.mainsnak.datavalue.value"


def parse(texts: DataFrame, id_col: str = "entity_id", text_col: str = "payload") -> DataFrame:
    """entity_id, payload (VARIANT; null where the text is null or no JSON) and is_json."""
    held = F.try_parse_json(text_col)
    return texts.select(F.col(id_col).alias("entity_id"), held.alias("payload"), (F.col(text_col).isNull() | held.isNotNull()).alias("is_json"))


def at(value: Column | str, path: str, kind: str = "variant") -> Column:
    """What stands at the path, null where there is nothing or it is of another kind."""
    return F.try_variant_get(value, path, kind)


def text_at(value: Column | str, path: str) -> Column:
    """A string at the path; numbers are none."""
    held = at(value, path)
    return F.when(F.schema_of_variant(held) == "STRING", at(value, path, "string"))


def target(claim: Column) -> Column:
    """The id of a claim with a value, else Q and the numeric id; only a text is an id and only a whole number a numeric one."""
    number = at(claim, f"{VALUE}['numeric-id']")
    numbered = F.when(F.schema_of_variant(number).isin("BIGINT", "INT"), F.concat(F.lit("Q"), at(claim, f"{VALUE}['numeric-id']", "bigint").cast("string")))
    return F.when(text_at(claim, "$.mainsnak.snaktype") == "value", F.coalesce(F.nullif(text_at(claim, f"{VALUE}.id"), F.lit("")), numbered))


def date_of(claim: Column) -> Column:
    return F.when(text_at(claim, "$.mainsnak.snaktype") == "value", variable_date(text_at(claim, f"{VALUE}.time"), at(claim, f"{VALUE}.precision", "int")))


def truthy(payload: Column | str, property_id: str, value: object = target) -> Column:
    """Distinct usable values of a property's claims, of preferred rank if there are any, else of normal rank."""
    claims = at(payload, f"$.claims.{property_id}", "array<variant>")
    held = F.transform(F.coalesce(claims, F.array().cast("array<variant>")), lambda c: F.struct(text_at(c, "$.rank").alias("rank"), value(c).alias("value")))
    of = lambda rank: F.array_sort(F.array_distinct(F.transform(F.filter(held, lambda c: (c["rank"] == rank) & c["value"].isNotNull()), lambda c: c["value"])))
    return F.when(F.size(of("preferred")) > 0, of("preferred")).otherwise(of("normal"))


def label(payload: Column | str) -> Column:
    """The English label, else the first by language that is not blank."""
    held = at(payload, "$.labels", "map<string,variant>")
    own = lambda k: F.nullif(F.trim(text_at(held[k], "$.value")), F.lit(""))
    others = F.filter(F.transform(F.array_sort(F.map_keys(held)), own), lambda x: x.isNotNull())
    return F.coalesce(own(F.lit("en")), F.get(others, F.lit(0)))


def fact_rows(texts: DataFrame, value_labels: DataFrame, properties: dict[str, str], least: int = 2) -> DataFrame:
    """Raw fact rows of humans with a name and an occupation and a slot of at least `least` labelled values.

    value_labels: value_id, label. properties: of each slot, occupation apart. Values without a label
    drop out. Nothing is shuffled before values meet their labels.
    """
    slots = {"occupation": OCCUPATION} | properties
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(p).alias("property"), truthy("payload", p).alias("ids")) for s, p in slots.items()])).alias("s")
    human = parse(texts).where(F.array_contains(truthy("payload", INSTANCE_OF), HUMAN)).withColumn("entity_name", label("payload")).where("entity_name IS NOT NULL")
    rows = human.select("entity_id", "entity_name", each).select("entity_id", "entity_name", "s.slot", "s.property", F.explode("s.ids").alias("value_id")).distinct()
    met = rows.join(value_labels.select("value_id", F.col("label").alias("value_text")).where("label IS NOT NULL"), "value_id")
    ref = F.concat_ws(":", F.lit("wikidata"), "entity_id", "property", "value_id").alias("source_ref")
    return eligible(met, least).select("entity_id", "entity_name", F.lit(True).alias("is_human"), "slot", "value_id", "value_text", ref)


def claims(texts: DataFrame) -> DataFrame:
    """Every claim of every property, whatever it is: entity_id, property, rank, target, date, problem.

    problem: claim_not_an_object, unknown_rank, no_value (the claim says so itself), no_target; null for a
    usable one. A property that holds no list is one row with claims_not_a_list.
    """
    spark = texts.sparkSession
    held = parse(texts).where("payload IS NOT NULL").withColumn("claims", at("payload", "$.claims"))
    lists = held.lateralJoin(spark.tvf.variant_explode(F.col("claims").outer())).where("key IS NOT NULL").select("entity_id", F.col("key").alias("property"), F.col("value").alias("held"))
    is_list = F.startswith(F.schema_of_variant("held"), F.lit("ARRAY"))
    each = lists.where(is_list).lateralJoin(spark.tvf.variant_explode(F.col("held").outer())).select("entity_id", "property", F.col("value").alias("claim"))
    c, rank = F.col("claim"), text_at("claim", "$.rank")
    problem = (
        F.when(~F.startswith(F.schema_of_variant(c), F.lit("OBJECT")), "claim_not_an_object")
        .when(rank.isNull() | ~rank.isin("preferred", "normal", "deprecated"), "unknown_rank")
        .when(F.coalesce(text_at(c, "$.mainsnak.snaktype"), F.lit("")) != "value", "no_value")
        .when(target(c).isNull() & date_of(c).isNull(), "no_target")
    )
    usable = each.select("entity_id", "property", rank.alias("rank"), target(c).alias("target"), date_of(c).alias("date"), problem.alias("problem"))
    none = F.lit(None).cast("string")
    return usable.unionByName(lists.where(~is_list).select("entity_id", "property", none.alias("rank"), none.alias("target"), none.alias("date"), F.lit("claims_not_a_list").alias("problem")))


def problems(texts: DataFrame) -> DataFrame:
    """How many payloads and claims were passed over, and why: problem, n. A null text is payload_missing."""
    whole = parse(texts)
    kind = F.schema_of_variant("payload")
    reason = F.when(~F.col("is_json"), "payload_not_json").when(F.col("payload").isNull(), "payload_missing").when(~F.startswith(kind, F.lit("OBJECT")), "payload_not_an_object")
    told = whole.select(reason.alias("problem")).union(claims(texts).select("problem"))
    return told.where("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n"))

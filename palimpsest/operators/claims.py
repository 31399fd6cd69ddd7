"""Payloads of entities to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import variable_date

CLAIM = "struct<rank:string,mainsnak:struct<snaktype:string,datavalue:struct<value:struct<id:string,`numeric-id`:bigint,time:string,precision:int>>>>"
PAYLOAD = f"id string, labels map<string,struct<value:string>>, claims map<string,array<{CLAIM}>>"


def truthy(claims: Column) -> Column:
    """Without deprecated claims; the preferred ones if there are any, else the normal ones."""
    of = lambda rank: F.filter(claims, lambda c: c["rank"] == rank)
    return F.when(claims.isNull(), F.array().cast(f"array<{CLAIM}>")).when(F.size(of("preferred")) > 0, of("preferred")).otherwise(of("normal"))


def target(claim: Column) -> Column:
    """The id, else Q and the numeric id."""
    value = claim["mainsnak"]["datavalue"]["value"]
    return F.coalesce(value["id"], F.concat(F.lit("Q"), value["numeric-id"]))


def date_of(claim: Column) -> Column:
    value = claim["mainsnak"]["datavalue"]["value"]
    return variable_date(value["time"], value["precision"])


def label(labels: Column) -> Column:
    """The English label, else the first that is not blank, by language."""
    others = F.filter(F.transform(F.array_sort(F.map_keys(labels)), lambda k: labels[k]["value"]), lambda x: F.trim(x) != "")
    return F.coalesce(F.nullif(F.trim(labels["en"]["value"]), F.lit("")), F.get(others, F.lit(0)))


def rows(payloads: DataFrame, properties: dict[str, str], dates: tuple[str, ...] = ()) -> DataFrame:
    """One row per truthy claim of the listed properties: entity_id, entity_name, slot, value_id (null for dates), value_text (dates only)."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(s in dates).alias("dated"), truthy(F.col("claims")[p]).alias("c")) for s, p in properties.items()])).alias("s")
    p = payloads.select(F.col("id").alias("entity_id"), label(F.col("labels")).alias("entity_name"), each).select("entity_id", "entity_name", "s.slot", "s.dated", F.explode("s.c").alias("c"))
    out = p.select("entity_id", "entity_name", "slot", F.when(~F.col("dated"), target(F.col("c"))).alias("value_id"), F.when(F.col("dated"), date_of(F.col("c"))).alias("value_text"))
    return out.where("coalesce(value_id, value_text) IS NOT NULL").distinct()


def eligible(facts: DataFrame, least: int = 2) -> DataFrame:
    """Entities with an occupation, and a slot of `least` rows; all their rows stay."""
    n = facts.groupBy("entity_id", "slot").agg(F.count("*").alias("n"))
    good = n.groupBy("entity_id").agg(F.max((F.col("slot") == "occupation").cast("int")).alias("o"), F.max(((F.col("slot") != "occupation") & (F.col("n") >= least)).cast("int")).alias("d"))
    return facts.join(good.where("o = 1 AND d = 1").select("entity_id"), "entity_id", "left_semi")

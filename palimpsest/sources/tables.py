"""Readers of Parquet tables, and adapters that give them the engine's shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as X


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str, prompt: str = "standard") -> DataFrame:
    """Scores of both orders per (family, variant) from lineitem: lines 1 to 4 of orders that hold all four.

    Dealt by family once; the later groupings by family need no further shuffle.
    """
    li = read(spark, sf_dir, "lineitem").where("l_linenumber <= 4").repartition("l_orderkey")
    least = F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")).alias("r")
    own = li.groupBy("l_orderkey", "l_linenumber").agg(least)
    whole = own.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "r")).alias("v")).where(F.size("v") == 4)
    v = whole.select(F.col("l_orderkey").alias("family_id"), F.explode("v").alias("v")).select("family_id", F.col("v.l_linenumber").alias("k"), "v.r.*")
    names = F.array(*[F.lit(x) for x in ("base", "para_1", "para_2", "counterfactual")])
    strict = prompt != "standard"
    return v.select(
        "family_id",
        names[F.col("k") - 1].alias("variant_id"),
        F.when(F.col("k") == 4, "c2").otherwise("c1").alias("gold_winner_cid"),
        (-F.col("l_discount")).alias("scores_ab_c1"),
        (-F.col("l_tax")).alias("scores_ab_c2"),
        (-(F.col("l_quantity").cast("int") % (7 if strict else 10)) / F.lit(100.0)).alias("scores_ba_c1"),
        (-(F.col("l_suppkey" if strict else "l_partkey") % 10) / F.lit(100.0)).alias("scores_ba_c2"),
    )


def orders_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of the families: the order's status as task, its priority as model."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("family_id"), F.col("o_orderstatus").alias("task_family"), F.col("o_orderpriority").alias("model_id"))


def raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw entity facts: entity C<custkey> with its segment, and slots from its orders' lines."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    li, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    entity = F.concat(F.lit("C"), F.col("c_custkey"))
    base = [entity.alias("entity_id"), F.col("c_name").alias("entity_name"), (F.col("c_custkey") % 17 != 0).alias("is_human")]
    own = c.where("c_acctbal >= 0").select(*base, F.lit("occupation").alias("slot"), F.lower("c_mktsegment").alias("value_id"), F.lower("c_mktsegment").alias("value_text"), F.lit("customer").alias("source_ref"))
    lines = li.where("l_linenumber <= 4").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    slot = (
        F.when((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R") & (F.col("o_orderstatus") == "F"), "notable_work")
        .when((F.col("l_linenumber") == 2) & (F.col("o_orderstatus") == "P"), "award")
        .when(F.col("l_linenumber") == 3, "field")
        .when(F.col("l_linenumber") == 4, "spouse")
    )
    value = (
        F.when(slot == "notable_work", F.col("p_name"))
        .when(slot == "award", F.col("o_orderpriority"))
        .when(slot == "field", F.concat(F.lower("p_type"), F.when(F.col("p_size") > 40, " extra large industrial grade").otherwise("")))
        .otherwise(F.col("p_brand"))
    )
    return own.unionByName(lines.select(*base, slot.alias("slot"), value.alias("value_id"), value.alias("value_text"), F.lit("lineitem").alias("source_ref")).where("slot IS NOT NULL"))


def qa_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw keyed answers: parts with brand and name, nations with their region, plus an unlisted relation."""
    p, n, r = read(spark, sf_dir, "part"), read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    subject = F.concat(F.lit("P"), F.col("p_partkey"))
    # Every 31st part has a second brand: two answers to one question.
    twice = p.where("p_partkey % 31 = 0").withColumn("p_brand", F.concat("p_brand", F.lit(" II")))
    brands = p.unionByName(twice).select(subject.alias("subject_id"), F.col("p_name").alias("subject_text"), F.lit("p_brand").alias("relation_id"), F.col("p_brand").alias("object_id"), F.col("p_brand").alias("object_text"))
    types = p.select(subject.alias("subject_id"), F.col("p_name").alias("subject_text"), F.lit("p_type").alias("relation_id"), F.col("p_type").alias("object_id"), F.col("p_type").alias("object_text"))
    nations = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(  # 5 regions
        F.concat(F.lit("N"), F.col("n_nationkey")).alias("subject_id"), F.col("n_name").alias("subject_text"), F.lit("n_region").alias("relation_id"),
        F.concat(F.lit("R"), F.col("r_regionkey")).alias("object_id"), F.col("r_name").alias("object_text"),
    )
    out = brands.unionByName(types).unionByName(nations)
    return out.withColumn("source_ref", F.concat_ws(":", "subject_id", "relation_id"))


#: Relations of the adapter: id, name, coarse type, question.
ADAPTED = (("p_brand", "brand", "brand", "Which brand is {SUBJECT}?"), ("n_region", "region", "location", "Where is {SUBJECT}?"))


def relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADAPTED, "relation_id string, relation_name string, coarse_type string, question_template string")


def with_split(df: DataFrame, anchor: str) -> DataFrame:
    return df.withColumn("bucket", X.split_bucket(F.col(anchor))).withColumn("split", X.split_of(F.col("bucket")))

"""Queries from payload texts to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import canonical, payloads, quality
from palimpsest.plans.building import _FACTS, _QA, bucket_sql, split_sql
from palimpsest.plans.registry import query
from palimpsest.sources.tables import ADAPTED, qa_facts, raw_facts, read, relations

PROPERTIES = {"award": "P166", "field": "P101"}


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload text per customer: who it is, what it does, and its orders as claims of an award or a field.

    Some texts are cut off, and some claims are no objects, hold no value, or name their target by number alone.
    """
    o = read(spark, sf_dir, "orders")
    key, number = F.col("o_orderkey"), 1000 + F.col("o_orderkey") % 50
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", "preferred").when(F.col("o_orderpriority") == "5-LOW", "deprecated").otherwise("normal")
    value = F.when(key % 11 == 0, F.format_string('{"numeric-id":%d}', number)).otherwise(F.format_string('{"id":"Q%d"}', number))
    snak = F.when(key % 13 == 0, F.lit('{"snaktype":"novalue"}')).otherwise(F.format_string('{"snaktype":"value","datavalue":{"value":%s}}', value))
    claim = F.when(key % 7 == 0, F.lit('"nothing"')).otherwise(F.format_string('{"rank":"%s","mainsnak":%s}', rank, snak))
    of = lambda done: F.concat(F.lit("["), F.array_join(F.collect_list(F.when(done, claim)), ","), F.lit("]"))
    done = F.col("o_orderstatus") == "F"
    held = o.groupBy("o_custkey").agg(of(done).alias("award"), of(~done).alias("field"))
    c = read(spark, sf_dir, "customer").join(held, F.col("c_custkey") == F.col("o_custkey"), "left")
    own = lambda q: F.format_string('[{"rank":"normal","mainsnak":{"snaktype":"value","datavalue":{"value":{"id":"Q%d"}}}}]', q)
    kind = own(F.when(F.col("c_custkey") % 17 == 0, 6).otherwise(5))
    name = F.when(F.col("c_custkey") % 5 == 0, F.format_string('{"de":{"value":" %s "},"en":{"value":" "}}', "c_name")).otherwise(F.format_string('{"en":{"value":"%s"}}', "c_name"))
    text = F.format_string('{"labels":%s,"claims":{"P31":%s,"P106":%s,"P166":%s,"P101":%s}}', name, kind, own(2000 + F.length("c_mktsegment")), F.coalesce("award", F.lit("[]")), F.coalesce("field", F.lit("7")))
    cut = F.when(F.col("c_custkey") % 19 == 0, F.substring(text, 1, 40)).otherwise(text)
    return c.select(F.format_string("Q%d", "c_custkey").alias("entity_id"), cut.alias("payload"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of most values: names of parts and segments."""
    p, c = read(spark, sf_dir, "part"), read(spark, sf_dir, "customer")
    parts = p.where("p_partkey < 50 AND p_partkey % 5 <> 0").select(F.format_string("Q%d", 1000 + F.col("p_partkey")).alias("value_id"), F.col("p_name").alias("label"))
    kinds = c.groupBy(F.format_string("Q%d", 2000 + F.length("c_mktsegment")).alias("value_id")).agg(F.min("c_mktsegment").alias("label"))
    return parts.union(kinds)


_CLAIMS = """WITH claims AS (
  SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'award' ELSE 'field' END AS slot, CASE WHEN o_orderstatus = 'F' THEN 'P166' ELSE 'P101' END AS property,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'preferred' WHEN '5-LOW' THEN 'deprecated' ELSE 'normal' END AS rank, 'Q' || (1000 + o_orderkey % 50) AS value_id,
    CASE WHEN o_orderkey % 7 = 0 THEN 'claim_not_an_object' WHEN o_orderkey % 13 = 0 THEN 'no_value' END AS problem
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 19 <> 0
)"""


@query(f"""{_CLAIMS}, best AS (SELECT *, bool_or(rank = 'preferred') OVER (PARTITION BY o_custkey, slot) AS preferred FROM claims WHERE problem IS NULL AND rank <> 'deprecated'
), labels AS (
  SELECT 'Q' || (1000 + p_partkey) AS value_id, p_name AS value_text FROM part WHERE p_partkey < 50 AND p_partkey % 5 <> 0
  UNION ALL SELECT 'Q' || (2000 + length(c_mktsegment)), min(c_mktsegment) FROM customer GROUP BY 1
), held AS (
  SELECT DISTINCT o_custkey, slot, property, value_id FROM best WHERE rank = CASE WHEN preferred THEN 'preferred' ELSE 'normal' END
  UNION ALL SELECT c_custkey, 'occupation', 'P106', 'Q' || (2000 + length(c_mktsegment)) FROM customer
), met AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, slot) AS n FROM held JOIN labels USING (value_id)
), fit AS (SELECT o_custkey FROM met GROUP BY 1 HAVING bool_or(slot = 'occupation') AND bool_or(slot <> 'occupation' AND n >= 2))
SELECT 'Q' || c_custkey AS entity_id, c_name AS entity_name, true AS is_human, slot, value_id, value_text, 'wikidata:Q' || c_custkey || ':' || property || ':' || value_id AS source_ref
FROM met JOIN fit USING (o_custkey) JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 17 <> 0 AND c_custkey % 19 <> 0""")
def payload_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of payloads to fact rows."""
    return payloads.fact_rows(_payloads(spark, sf_dir), _labels(spark, sf_dir), PROPERTIES)


@query(f"""{_CLAIMS} SELECT problem, count(*) AS n FROM claims WHERE problem IS NOT NULL GROUP BY problem
  UNION ALL SELECT 'payload_not_json', count(*) FROM customer WHERE c_custkey % 19 = 0
  UNION ALL SELECT 'claims_not_a_list', count(*) AS n FROM customer WHERE c_custkey % 19 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders) HAVING count(*) > 0""")
def payload_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the payloads was passed over, by reason."""
    return payloads.problems(_payloads(spark, sf_dir))


def _counted(counter: str, keys: str, found: str) -> str:
    """Zeros for the keys of a fixed list."""
    return f"SELECT '{counter}' AS counter, k AS key, coalesce(n, 0) AS n FROM (SELECT unnest([{keys}]) AS k) LEFT JOIN ({found}) USING (k)"


_SPLIT_NAMES = "'train', 'dev', 'test'"
_RELATION_NAMES = ", ".join(f"'{r[0]}'" for r in ADAPTED)
_TYPE_NAMES = ", ".join(f"'{r[2]}'" for r in ADAPTED)
_SLOT_NAMES = "'occupation', 'notable_work', 'award', 'field'"


@query(f"""{_QA}, told AS (SELECT *, skip_reason IS NULL OR skip_reason IN ('multi_gold_object', 'duplicate_row') AS live, {split_sql(bucket_sql('subject_id'))} AS split FROM reasons)
SELECT 'input_row_count' AS counter, '' AS key, count(*) AS n FROM told
UNION ALL SELECT 'rows_after_whitelist_and_normalization', '', count(*) FILTER (live) FROM told
UNION ALL SELECT 'group_count', '', count(DISTINCT (subject_id, relation_id)) FILTER (live) FROM told
UNION ALL SELECT 'output_row_count', '', count(*) FILTER (skip_reason IS NULL) FROM told
UNION ALL SELECT 'duplicate_raw_row_count', '', count(*) FILTER (skip_reason = 'duplicate_row') FROM told
UNION ALL {_counted('skip_reasons', ", ".join(f"'{s}'" for s in quality.QA_SKIPS), "SELECT skip_reason AS k, count(*) AS n FROM told GROUP BY 1")}
UNION ALL {_counted('relation_input_counts', _RELATION_NAMES, "SELECT relation_id AS k, count(*) FILTER (coalesce(skip_reason, '') <> 'relation_not_whitelisted') AS n FROM told GROUP BY 1")}
UNION ALL {_counted('relation_output_counts', _RELATION_NAMES, "SELECT relation_id AS k, count(*) FILTER (skip_reason IS NULL) AS n FROM told GROUP BY 1")}
UNION ALL {_counted('coarse_type_output_counts', _TYPE_NAMES, "SELECT coarse_type AS k, count(*) FILTER (skip_reason IS NULL) AS n FROM told GROUP BY 1")}
UNION ALL {_counted('split_counts', _SPLIT_NAMES, "SELECT split AS k, count(DISTINCT subject_id) FILTER (skip_reason IS NULL) AS n FROM told GROUP BY 1")}""")
def canonical_qa_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every counter of the build from one scan of its source, zeros told."""
    reasons = canonical.qa_reasons(qa_facts(spark, sf_dir), relations(spark))
    return quality.qa_report(reasons, [r[0] for r in ADAPTED], [r[2] for r in ADAPTED])


@query(f"""{_FACTS}, told AS (SELECT *, {split_sql(bucket_sql('entity_id'))} AS split FROM freasons)
SELECT 'input_row_count' AS counter, '' AS key, count(*) AS n FROM told
UNION ALL SELECT 'output_row_count', '', count(*) FILTER (skip_reason IS NULL) FROM told
UNION ALL SELECT 'duplicate_raw_row_count', '', count(*) FILTER (skip_reason = 'duplicate_row') FROM told
UNION ALL {_counted('skip_reasons', ", ".join(f"'{s}'" for s in quality.FACT_SKIPS), "SELECT skip_reason AS k, count(*) AS n FROM told GROUP BY 1")}
UNION ALL {_counted('slot_row_counts', _SLOT_NAMES, "SELECT slot AS k, count(*) FILTER (skip_reason IS NULL) AS n FROM told GROUP BY 1")}
UNION ALL {_counted('slot_entity_counts', _SLOT_NAMES, "SELECT slot AS k, count(DISTINCT entity_id) FILTER (skip_reason IS NULL) AS n FROM told GROUP BY 1")}
UNION ALL {_counted('split_counts', _SPLIT_NAMES, "SELECT split AS k, count(DISTINCT entity_id) FILTER (skip_reason IS NULL) AS n FROM told GROUP BY 1")}""")
def fact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fact_report(canonical.fact_reasons(raw_facts(spark, sf_dir)))

"""Queries of the dataset build (L2 and L3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.fixed import SLOTS
from palimpsest.functions import text as X
from palimpsest.operators import canonical, pairing, rendering
from palimpsest.plans.registry import query
from palimpsest.sources.tables import qa_facts, raw_facts, read, relations, with_split


def norm_sql(c: str) -> str:
    return f"""trim(trim(trim(regexp_replace(lower({c}), '[\\s\\x1c-\\x1f\\x0b\\x85\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'), ' '), '.,;:!?'), '"''')"""


def tokens_sql(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN 0 ELSE length({c}) - length(replace({c}, ' ', '')) + 1 END"


def bucket_sql(c: str) -> str:
    part = lambda a, n: f"('0x' || substr(sha1({c}), {a}, {n}))::BIGINT"
    return f"CAST(({part(1, 15)} % 20 * 16 + {part(16, 15)} % 20 * 16 + {part(31, 10)}) % 20 AS INTEGER)"


def split_sql(b: str) -> str:
    return f"CASE WHEN {b} <= 13 THEN 'train' WHEN {b} <= 16 THEN 'dev' ELSE 'test' END"


_QA = f"""WITH raw AS (
  SELECT 'P' || p_partkey AS subject_id, p_name AS subject_text, 'p_brand' AS relation_id, p_brand AS object_id, p_brand AS object_text FROM part
  UNION ALL SELECT 'P' || p_partkey, p_name, 'p_brand', p_brand || ' II', p_brand || ' II' FROM part WHERE p_partkey % 31 = 0
  UNION ALL SELECT 'P' || p_partkey, p_name, 'p_type', p_type, p_type FROM part
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'n_region', 'R' || r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
), rel(relation_id, relation_name, coarse_type, question_template) AS (
  VALUES ('p_brand', 'brand', 'brand', 'Which brand is {{SUBJECT}}?'), ('n_region', 'region', 'location', 'Where is {{SUBJECT}}?')
), normed AS (SELECT raw.*, relation_name, coarse_type, question_template, {norm_sql('object_text')} AS answer_norm, subject_id || ':' || relation_id AS source_ref FROM raw LEFT JOIN rel USING (relation_id)
), multi AS (SELECT subject_id, relation_id, count(DISTINCT (object_id, answer_norm)) AS golds FROM normed WHERE relation_name IS NOT NULL AND answer_norm <> '' GROUP BY ALL
), reasons AS (SELECT normed.*, CASE WHEN relation_name IS NULL THEN 'relation_not_whitelisted' WHEN answer_norm = '' THEN 'empty_answer_after_normalization' WHEN golds > 1 THEN 'multi_gold_object'
    WHEN row_number() OVER (PARTITION BY subject_id, relation_id ORDER BY object_id, object_text) > 1 THEN 'duplicate_row' END AS skip_reason FROM normed LEFT JOIN multi USING (subject_id, relation_id)
), items AS (SELECT source_ref AS qa_id, replace(question_template, '{{SUBJECT}}', subject_text) AS question, subject_id, subject_text, relation_id, relation_name, object_id AS answer_id, object_text AS answer_text,
    answer_norm, coarse_type, source_ref, {bucket_sql('source_ref')} AS bucket FROM reasons WHERE skip_reason IS NULL
), split_items AS (SELECT *, {split_sql('bucket')} AS split FROM items)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.qa_items(canonical.qa_reasons(qa_facts(spark, sf_dir), relations(spark)))


_ITEM_COLUMNS = "qa_id, question, subject_id, subject_text, relation_id, relation_name, answer_id, answer_text, answer_norm, coarse_type, source_ref"


@query(f"{_QA} SELECT {_ITEM_COLUMNS} FROM items")
def canonical_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir)


@query(f"{_QA} SELECT skip_reason, count(*) AS n FROM reasons WHERE skip_reason IS NOT NULL GROUP BY 1")
def canonical_qa_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.skip_counts(canonical.qa_reasons(qa_facts(spark, sf_dir), relations(spark)))


@query(f"{_QA} SELECT subject_id, relation_id, object_id, answer_norm FROM reasons WHERE skip_reason = 'multi_gold_object'")
def multi_gold_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = canonical.qa_reasons(qa_facts(spark, sf_dir), relations(spark))
    return r.where("skip_reason = 'multi_gold_object'").select("subject_id", "relation_id", "object_id", "answer_norm")


@query(f"{_QA} SELECT qa_id, relation_id, bucket, split FROM split_items")
def canonical_with_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item meets its manifest row; one without is an error."""
    items = _items(spark, sf_dir)
    manifest = with_split(items.select("qa_id"), "qa_id")
    met = items.join(manifest, "qa_id", "left")
    split = F.when(F.col("split").isNull(), F.raise_error(F.lit("an item has no split"))).otherwise(F.col("split"))
    return met.select("qa_id", "relation_id", "bucket", split.alias("split"))


@query(f"SELECT c_name AS anchor_id, {bucket_sql('c_name')} AS bucket, {split_sql(bucket_sql('c_name'))} AS split FROM customer")
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_split(read(spark, sf_dir, "customer").select(F.col("c_name").alias("anchor_id")), "anchor_id")


@query(f"SELECT {split_sql(bucket_sql('p_name || p_partkey'))} AS split, count(*) AS n FROM part GROUP BY 1")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.concat("p_name", "p_partkey").alias("anchor_id"))
    return with_split(p, "anchor_id").groupBy("split").agg(F.count("*").alias("n"))


@query(f"{_QA} SELECT split, count(*) AS n, min(qa_id) AS first_id FROM split_items GROUP BY split")
def split_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits one after the other, then counted."""
    items = with_split(_items(spark, sf_dir), "qa_id")
    parts = [items.where(F.col("split") == s) for s in ("train", "dev", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split").agg(F.count("*").alias("n"), F.min("qa_id").alias("first_id"))


_PAIRS = f"""{_QA}, a AS (SELECT relation_id, coarse_type, split, answer_id, answer_norm, answer_text, min(qa_id) AS qa_id, arg_min(subject_id, qa_id) AS subject_id, count(*) AS n_rows, {tokens_sql('answer_norm')} AS tokens, length(answer_norm) AS chars
  FROM split_items GROUP BY ALL
), pairs AS (SELECT a.*, d.qa_id AS d_qa_id, d.answer_id AS d_answer_id, d.answer_norm AS d_answer_norm, d.answer_text AS d_answer_text, d.n_rows AS d_n_rows, d.tokens AS d_tokens, d.chars AS d_chars,
    a.subject_id <> d.subject_id AS different_subject_id, a.answer_id <> d.answer_id AS different_answer_id, a.answer_norm <> d.answer_norm AS different_answer_norm, a.answer_norm <> d.answer_norm AS different_from_gold_aliases,
    NOT regexp_matches(d.answer_norm, '[,;/|()]') AS forbidden_char_absent, NOT contains(d.answer_norm, ' and ') AS forbidden_and_absent, d.tokens BETWEEN 1 AND 6 AS token_count_in_range,
    d.chars BETWEEN 2 AND 40 AS char_length_in_range, d.chars / a.chars BETWEEN 0.67::DOUBLE AND 1.5::DOUBLE AS char_length_ratio_in_range
  FROM a JOIN a d USING (relation_id, coarse_type, split)
), judged AS (SELECT *, {' AND '.join(pairing.CHECKS)} AS is_admissible FROM pairs)"""
_KEYS = ("relation_id", "split", "answer_norm", "d_answer_norm")


@query(f"{_PAIRS} SELECT {', '.join(_KEYS)}, {', '.join(pairing.CHECKS)}, is_admissible FROM judged")
def donor_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairing.pairs(with_split(_items(spark, sf_dir), "qa_id"))
    return p.select(*_KEYS, *pairing.CHECKS, pairing.admissible().alias("is_admissible"))


#: Rows of a pool that fail a check against an anchor row without a donor, pair by pair.
_INVALID = f"""{_PAIRS}, lone AS (SELECT relation_id, split, answer_norm FROM judged GROUP BY ALL HAVING NOT bool_or(is_admissible)
), invalid AS (SELECT s.qa_id, s.relation_id, s.coarse_type, s.split, sum(d_n_rows) AS donor_pool_size, {', '.join(f"coalesce(sum(d_n_rows) FILTER (NOT {c}), 0) AS {c}" for c in pairing.CHECKS if c != 'different_subject_id')},
    (SELECT count(*) FROM split_items o WHERE o.relation_id = s.relation_id AND o.split = s.split AND o.subject_id = s.subject_id) AS different_subject_id
  FROM split_items s JOIN lone USING (relation_id, split, answer_norm) JOIN judged j ON j.relation_id = s.relation_id AND j.split = s.split AND j.answer_norm = s.answer_norm AND j.answer_id = s.answer_id AND j.answer_text = s.answer_text
  GROUP BY s.qa_id, s.relation_id, s.coarse_type, s.split, s.subject_id)"""


@query(f"""{_INVALID} SELECT 'qakey_' || replace(qa_id, ':', '_') AS family_id, qa_id, relation_id, coarse_type, split, 'no_admissible_donor' AS skip_reason, CAST(donor_pool_size AS BIGINT) AS donor_pool_size,
  {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in pairing.CHECKS)} FROM invalid""")
def invalid_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.invalid_anchors(with_split(_items(spark, sf_dir), "qa_id"))


@query(f"""{_INVALID} SELECT * FROM ({' UNION ALL '.join(f"SELECT '{c}' AS check_name, CAST(sum({c}) AS BIGINT) AS n FROM invalid" for c in pairing.CHECKS)}) WHERE n > 0""")
def donor_failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.failure_counts(with_split(_items(spark, sf_dir), "qa_id"))


_DONORS = f"""{_PAIRS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY relation_id, split, answer_id, answer_norm, answer_text ORDER BY abs(tokens - d_tokens), abs(chars - d_chars), d_answer_norm, d_answer_id, d_qa_id) AS place
  FROM judged WHERE is_admissible), donors AS (SELECT s.qa_id, s.relation_id, s.coarse_type, s.split, s.answer_text, d_qa_id AS donor_qa_id, d_answer_text AS donor_answer_text FROM split_items s
  JOIN ranked r ON place = 1 AND s.relation_id = r.relation_id AND s.split = r.split AND s.answer_id = r.answer_id AND s.answer_norm = r.answer_norm AND s.answer_text = r.answer_text)"""


@query(f"{_DONORS} SELECT * FROM donors")
def donor_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.chosen_donors(with_split(_items(spark, sf_dir), "qa_id"))


@query(f"""{_DONORS} SELECT 'qakey_' || replace(qa_id, ':', '_') AS family_id, variant_id, gold_winner_cid, replace(wording, '{{A}}', CASE WHEN gold_winner_cid = 'c2' THEN donor_answer_text ELSE answer_text END) AS criterion_text
  FROM donors, (VALUES ('base', 'c1', 'Official answer key: {{A}}.'), ('para_1', 'c1', 'Grade using this reference answer: {{A}}.'), ('para_2', 'c1', 'Use the following answer key when judging: {{A}}.'),
  ('counterfactual', 'c2', 'Official answer key: {{A}}.')) v(variant_id, gold_winner_cid, wording)""")
def variant_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pairing.chosen_donors(with_split(_items(spark, sf_dir), "qa_id"))
    v = d.withColumn("v", F.explode(rendering.key_variants(F.col("answer_text"), F.col("donor_answer_text"))))
    return v.select(F.concat(F.lit("qakey_"), F.replace("qa_id", F.lit(":"), F.lit("_"))).alias("family_id"), "v.variant_id", "v.gold_winner_cid", "v.criterion_text")


_TARGETS = {"train": 700, "dev": 100, "test": 150}
_FROZEN = f"""{_QA}, placed AS (SELECT qa_id AS family_id, split, row_number() OVER (PARTITION BY split ORDER BY qa_id) AS place FROM split_items
), frozen AS (SELECT *, place <= CASE split WHEN 'train' THEN 700 WHEN 'dev' THEN 100 ELSE 150 END AS selected FROM placed)"""


def _frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = with_split(_items(spark, sf_dir), "qa_id").select(F.col("qa_id").alias("family_id"), "split")
    return pairing.freeze(items, _TARGETS)


@query(f"{_FROZEN} SELECT family_id, split, place, selected FROM frozen")
def freeze_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frozen(spark, sf_dir).select("family_id", "split", "place", "selected")


@query(f"""{_FROZEN} SELECT split, count(*) AS available, count(*) FILTER (selected) AS selected, count(*) FILTER (NOT selected) AS discarded, 2 * count(*) FILTER (selected) AS n_candidates,
  4 * count(*) FILTER (selected) AS n_variants FROM frozen GROUP BY split""")
def freeze_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.freeze_stats(_frozen(spark, sf_dir))


_FACTS = f"""WITH lines AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey WHERE l_linenumber <= 4
), rawf AS (SELECT 'C' || c_custkey AS entity_id, c_name AS entity_name, c_custkey % 17 <> 0 AS is_human, 'occupation' AS slot, lower(c_mktsegment) AS value_text, 'customer' AS source_ref FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT 'C' || c_custkey, c_name, c_custkey % 17 <> 0, slot, value, 'lineitem' FROM (SELECT *, CASE WHEN l_linenumber = 1 AND l_returnflag = 'R' AND o_orderstatus = 'F' THEN 'notable_work'
    WHEN l_linenumber = 2 AND o_orderstatus = 'P' THEN 'award' WHEN l_linenumber = 3 THEN 'field' WHEN l_linenumber = 4 THEN 'spouse' END AS slot,
    CASE l_linenumber WHEN 1 THEN p_name WHEN 2 THEN o_orderpriority WHEN 3 THEN lower(p_type) || CASE WHEN p_size > 40 THEN ' extra large industrial grade' ELSE '' END ELSE p_brand END AS value FROM lines) WHERE slot IS NOT NULL
), freasons AS (SELECT *, {norm_sql('value_text')} AS value_norm, CASE WHEN NOT is_human THEN 'non_human_entity' WHEN slot NOT IN ('occupation', 'notable_work', 'award', 'field') THEN 'disallowed_slot'
    WHEN {norm_sql('value_text')} = '' THEN 'empty_value_after_normalization' WHEN row_number() OVER (PARTITION BY entity_id, slot, value_text, is_human ORDER BY source_ref) > 1 THEN 'duplicate_row' END AS skip_reason FROM rawf
), facts AS (SELECT entity_id, entity_name, slot, value_text AS value_id, value_text, value_norm, source_ref FROM freasons WHERE skip_reason IS NULL)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.facts(canonical.fact_reasons(raw_facts(spark, sf_dir)))


@query(f"{_FACTS} SELECT * FROM facts")
def canonical_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir)


@query(f"{_FACTS} SELECT skip_reason, count(*) AS n FROM freasons WHERE skip_reason IS NOT NULL GROUP BY 1")
def fact_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.skip_counts(canonical.fact_reasons(raw_facts(spark, sf_dir)))


@query(f"{_FACTS} SELECT slot, count(DISTINCT entity_id) AS n_entities, count(entity_id) AS n_rows FROM (VALUES ('occupation'), ('notable_work'), ('award'), ('field')) s(slot) LEFT JOIN facts USING (slot) GROUP BY slot")
def slot_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero for slots without entities."""
    slots = spark.createDataFrame([(s,) for s in SLOTS], "slot string")
    n = _facts(spark, sf_dir).groupBy("slot").agg(F.count_distinct("entity_id").alias("e"), F.count("*").alias("r"))
    return slots.join(n, "slot", "left").select("slot", F.coalesce("e", F.lit(0)).alias("n_entities"), F.coalesce("r", F.lit(0)).alias("n_rows"))


_RUBRICS = f"""{_FACTS}, fine AS (SELECT entity_id, entity_name, slot, value_norm, min(value_text) AS value_text FROM facts WHERE value_norm <> '' AND {tokens_sql('value_norm')} BETWEEN 1 AND 8 AND length(value_norm) BETWEEN 2 AND 60
    AND NOT regexp_matches(value_norm, '[,;/|()]') AND NOT contains(value_norm, ' and ') GROUP BY ALL
), valued AS (SELECT *, row_number() OVER (PARTITION BY entity_id, slot ORDER BY value_norm) AS place, count(*) OVER (PARTITION BY entity_id, slot) AS n_values FROM fine
), entities AS (SELECT DISTINCT entity_id, entity_name FROM facts
), shared AS (SELECT entity_id, value_text AS shared_text FROM valued WHERE slot = 'occupation' AND place = 1
), two AS (SELECT entity_id, slot, list_position(['notable_work', 'award', 'field'], slot) AS priority, max(value_text) FILTER (place = 1) AS f1_text, max(value_text) FILTER (place = 2) AS f2_text
    FROM valued WHERE slot <> 'occupation' AND n_values >= 2 AND place <= 2 GROUP BY ALL
), slot1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY priority) AS rn FROM two) WHERE rn = 1
), worded AS (SELECT *, entity_name || ' was a ' || shared_text || '.' AS s0, CASE slot WHEN 'notable_work' THEN ' is known for ' WHEN 'award' THEN ' received ' ELSE ' worked in ' END AS verb FROM entities LEFT JOIN shared USING (entity_id) LEFT JOIN slot1 USING (entity_id)
), texts AS (SELECT *, s0 || ' ' || entity_name || verb || f1_text || '.' AS c1_text, s0 || ' ' || entity_name || verb || f2_text || '.' AS c2_text FROM worded
), measured AS (SELECT *, {tokens_sql(norm_sql('c1_text'))} AS t1, {tokens_sql(norm_sql('c2_text'))} AS t2 FROM texts
), outcomes AS (SELECT *, greatest(t1, t2)::DOUBLE / least(t1, t2) AS length_ratio, CASE WHEN shared_text IS NULL THEN 'no_shared_occupation' WHEN slot IS NULL THEN 'no_distinguishing_slot'
    WHEN greatest(t1, t2)::DOUBLE / least(t1, t2) > 1.25 THEN 'candidate_length_ratio_exceeded' END AS skip_reason FROM measured)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.rubric_outcomes(_facts(spark, sf_dir))


@query(f"{_RUBRICS} SELECT entity_id, slot, f1_text, f2_text FROM slot1")
def slot_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).where("slot IS NOT NULL").select("entity_id", "slot", "f1_text", "f2_text")


@query(f"{_RUBRICS} SELECT 'biorubric_' || entity_id AS family_id, slot, shared_text, f1_text, f2_text, length_ratio FROM outcomes WHERE skip_reason IS NULL")
def rubric_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _outcomes(spark, sf_dir).where("skip_reason IS NULL")
    return o.select(F.concat(F.lit("biorubric_"), "entity_id").alias("family_id"), "slot", "shared_text", "f1_text", "f2_text", "length_ratio")


@query(f"{_RUBRICS} SELECT skip_reason, count(*) AS n FROM outcomes WHERE skip_reason IS NOT NULL GROUP BY 1")
def rubric_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.skip_counts(_outcomes(spark, sf_dir))


@query(f"""{_RUBRICS}, per AS (SELECT entity_id, slot, count(*) AS n FROM facts GROUP BY ALL), able AS (SELECT entity_id, slot, count(DISTINCT value_norm) AS fine FROM fine GROUP BY ALL
), counts AS (SELECT entity_id, CAST(sum(n) AS BIGINT) AS source_row_count, string_agg(slot || ':' || n, ',' ORDER BY slot) AS slot_row_counts, string_agg(slot || ':' || coalesce(fine, 0), ',' ORDER BY slot) AS admissible_slot_counts
    FROM per LEFT JOIN able USING (entity_id, slot) GROUP BY entity_id)
  SELECT 'biorubric_' || entity_id AS family_id, entity_id, entity_name, skip_reason, source_row_count, slot_row_counts, admissible_slot_counts FROM outcomes JOIN counts USING (entity_id) WHERE skip_reason IS NOT NULL""")
def invalid_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.invalid_entities(_facts(spark, sf_dir))


@query(f"{_RUBRICS} SELECT entity_id, c1_text, c2_text, t1 = t2 AS same_tokens, c1_text = s0 || ' ' || entity_name || verb || f1_text || '.' AS two_sentences FROM outcomes WHERE skip_reason IS NULL")
def candidate_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text is exactly the two sentences."""
    o, name = _outcomes(spark, sf_dir).where("skip_reason IS NULL"), F.col("entity_name")
    both = F.concat_ws(" ", rendering.sentence(F.lit("occupation"), name, F.col("shared_text")), rendering.sentence(F.col("slot"), name, F.col("f1_text")))
    t = lambda c: X.token_count(X.normalize(F.col(c)))
    return o.select("entity_id", "c1_text", "c2_text", (t("c1_text") == t("c2_text")).alias("same_tokens"), (F.col("c1_text") == both).alias("two_sentences"))


def _rubric_sql(variant: str, wording: int, order: tuple, weights: dict) -> str:
    first = ("'Award ' || {w} || ' point(s) if the biography states that ' || entity_name || ' was a ' || shared_text || '.'", "'Award ' || {w} || ' point(s) if the biography mentions ' || {v} || '.'")
    second = ("'Give ' || {w} || ' point(s) for stating that ' || entity_name || ' was a ' || shared_text || '.'", "'Give ' || {w} || ' point(s) for referencing ' || {v} || '.'")
    lines = [(first, second)[wording][k != "shared"].format(w=weights[k], v=f"{k}_text") for k in order]
    return f"SELECT entity_id, '{variant}' AS variant_id, " + " || chr(10) || ".join(lines) + " AS rubric_text FROM outcomes WHERE skip_reason IS NULL"


_RUBRIC_TEXTS = " UNION ALL ".join(_rubric_sql(v, w, o, dict(zip(("shared", "f1", "f2"), k, strict=True))) for v, (w, o, k) in {
    "base": (0, ("shared", "f1", "f2"), (1, 2, 1)), "para_lex": (1, ("shared", "f1", "f2"), (1, 2, 1)), "para_struct": (0, ("f1", "shared", "f2"), (1, 2, 1)), "counterfactual": (0, ("shared", "f1", "f2"), (1, 1, 2))}.items())


@query(f"{_RUBRICS} {_RUBRIC_TEXTS}")
def rubric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _outcomes(spark, sf_dir).where("skip_reason IS NULL")
    each = F.array(*[F.struct(F.lit(v).alias("variant_id"), rendering.rubric(v, F.col("entity_name"), F.col("shared_text"), F.col("f1_text"), F.col("f2_text")).alias("rubric_text")) for v in ("base", "para_lex", "para_struct", "counterfactual")])
    return o.select("entity_id", F.explode(each).alias("x")).select("entity_id", "x.*")


_VALID = f"""{_RUBRICS}, checked AS (SELECT entity_id, slot, 1 AS factuality_pass, CAST(c1_text = s0 || ' ' || entity_name || verb || f1_text || '.' AND c2_text = s0 || ' ' || entity_name || verb || f2_text || '.' AND length_ratio <= 1.25 AS INTEGER) AS symmetry_pass,
  CAST(NOT (contains(f1_text, f2_text) OR contains(f2_text, f1_text)) AS INTEGER) AS no_extra_facts_pass FROM outcomes WHERE skip_reason IS NULL)"""


@query(f"""{_VALID} SELECT slot, count(*) AS n_families, avg(1 - factuality_pass * symmetry_pass * no_extra_facts_pass) AS data_bug_rate, avg(factuality_pass * symmetry_pass * no_extra_facts_pass) AS pass_rate,
  avg(factuality_pass * symmetry_pass * no_extra_facts_pass) >= 0.8 AS passes FROM checked GROUP BY slot""")
def build_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P29, V10, A22."""
    o, name = _outcomes(spark, sf_dir).where("skip_reason IS NULL"), F.col("entity_name")
    text = lambda c: F.concat_ws(" ", rendering.sentence(F.lit("occupation"), name, F.col("shared_text")), rendering.sentence(F.col("slot"), name, F.col(c)))
    symmetry = (F.col("c1_text") == text("f1_text")) & (F.col("c2_text") == text("f2_text")) & (F.col("length_ratio") <= 1.25)
    extra = F.contains("f1_text", "f2_text") | F.contains("f2_text", "f1_text")
    passed = (symmetry & ~extra).cast("int")
    out = o.groupBy("slot").agg(F.count("*").alias("n_families"), F.avg(1 - passed).alias("data_bug_rate"), F.avg(passed).alias("pass_rate"))
    return out.withColumn("passes", F.col("pass_rate") >= 0.8)


@query(f"""{_RUBRICS}, built AS (SELECT slot, row_number() OVER (ORDER BY entity_id) AS place FROM outcomes WHERE skip_reason IS NULL)
  SELECT slot, count(*) AS n_built, count(*) FILTER (place <= 120) AS n_selected FROM built GROUP BY slot""")
def selected_vs_built_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 120 by id are the selected ones; both counts stand side by side."""
    built = _outcomes(spark, sf_dir).where("skip_reason IS NULL").select("entity_id", "slot")
    first = built.orderBy("entity_id").limit(120).select("entity_id", F.lit(1).alias("s"))
    return built.join(first, "entity_id", "left").groupBy("slot").agg(F.count("*").alias("n_built"), F.count("s").alias("n_selected"))

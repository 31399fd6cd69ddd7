"""Queries over judged families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.fixed import BOOTSTRAP_REPLICATES, BOOTSTRAP_SEED, METRICS, SYSTEM_PROMPTS
from palimpsest.operators import judging, metrics, resample
from palimpsest.plans.registry import query
from palimpsest.sources.tables import orders_of, read, scores


def _cte(prompt: str = "standard", tag: str = "") -> str:
    """SQL of the judged families: v{tag} variants, f{tag} families."""
    q, k = (7, "l_suppkey") if prompt != "standard" else (10, "l_partkey")
    return f"""
d{tag} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS rn
    FROM lineitem WHERE l_linenumber <= 4) WHERE rn = 1
), w{tag} AS (
  SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS held FROM d{tag}
), s{tag} AS (
  SELECT l_orderkey AS family_id, l_linenumber AS k, l_partkey, l_suppkey, (['base', 'para_1', 'para_2', 'counterfactual'])[l_linenumber] AS variant_id,
    CASE WHEN l_linenumber = 4 THEN 'c2' ELSE 'c1' END AS gold_winner_cid, -l_discount AS scores_ab_c1, -l_tax AS scores_ab_c2,
    -(CAST(trunc(l_quantity) AS INTEGER) % {q}) / 100.0::DOUBLE AS scores_ba_c1, -({k} % 10) / 100.0::DOUBLE AS scores_ba_c2
  FROM w{tag} WHERE held = 4
), a{tag} AS (
  SELECT *, 0.5::DOUBLE * (scores_ab_c1 + scores_ba_c1) AS scores_agg_c1, 0.5::DOUBLE * (scores_ab_c2 + scores_ba_c2) AS scores_agg_c2 FROM s{tag}
), p{tag} AS (
  SELECT *, CASE WHEN abs(scores_agg_c1 - scores_agg_c2) <= 1e-6 THEN 'tie' WHEN scores_agg_c1 > scores_agg_c2 THEN 'c1' ELSE 'c2' END AS pred_winner_cid,
    CASE WHEN abs(scores_ab_c1 - scores_ab_c2) <= 1e-6 THEN 'tie' WHEN scores_ab_c1 > scores_ab_c2 THEN 'c1' ELSE 'c2' END AS order_pred_ab,
    CASE WHEN abs(scores_ba_c1 - scores_ba_c2) <= 1e-6 THEN 'tie' WHEN scores_ba_c1 > scores_ba_c2 THEN 'c1' ELSE 'c2' END AS order_pred_ba FROM a{tag}
), v{tag} AS (
  SELECT *, CAST(pred_winner_cid = 'tie' AS INTEGER) AS pred_tie, CAST(order_pred_ab = 'tie' AS INTEGER) AS order_tie_ab, CAST(order_pred_ba = 'tie' AS INTEGER) AS order_tie_ba,
    CAST(order_pred_ab <> order_pred_ba AS INTEGER) AS order_disagree, CAST(pred_winner_cid = gold_winner_cid AS INTEGER) AS ok FROM p{tag}
), f{tag} AS (
  SELECT family_id, max(ok) FILTER (k = 1) AS base_correct, min(ok) FILTER (k IN (2, 3)) AS paraphrase_all_correct, max(ok) FILTER (k = 4) AS counterfactual_correct,
    CAST(sum(pred_tie) AS BIGINT) AS tie_count, count(*) AS variant_count, CAST(sum(order_disagree) AS BIGINT) AS order_disagreement_count,
    max(ok) FILTER (k = 1) * min(ok) FILTER (k IN (2, 3)) * max(ok) FILTER (k = 4) AS gcf_success
  FROM v{tag} GROUP BY family_id
)"""


CTE = "WITH " + _cte()
BOTH = CTE + ", " + _cte("strict", "2")
#: The prompts of both orders.
_ORDERS = """, prompts AS (
  SELECT family_id, k, variant_id, 'AB' AS order_id, 'c1' AS displayed_cid_a, 'c2' AS displayed_cid_b, scores_ab_c1 AS score_a, scores_ab_c2 AS score_b FROM v
  UNION ALL SELECT family_id, k, variant_id, 'BA', 'c2', 'c1', scores_ba_c2, scores_ba_c1 FROM v
), labelled AS (
  SELECT *, CASE WHEN abs(score_a - score_b) <= 1e-6 THEN 'TIE' WHEN score_a > score_b THEN 'A' ELSE 'B' END AS pred_display_label FROM prompts
)"""


def _metrics_sql(source: str, by: str = "", weight: str = "1", extra: str = "") -> str:
    s = lambda x: f"sum(({x}) * {weight})::DOUBLE"
    n, b = s("1"), s("base_correct")
    sens, inv = f"{s('base_correct * counterfactual_correct')} / nullif({b}, 0)", f"{s('base_correct * paraphrase_all_correct')} / nullif({b}, 0)"
    return f"""SELECT {by + ', ' if by else ''}CAST({n} AS BIGINT) AS n_families, CAST({b} AS BIGINT) AS n_base_correct, CAST({s('variant_count')} AS BIGINT) AS n_logical_variants,
  {b} / {n} AS base_acc, {s('gcf_success')} / {n} AS gcf, {sens} AS sensitivity_at_base_correct, {inv} AS invariance_at_base_correct,
  {s('tie_count')} / {s('variant_count')} AS tie_rate, {s('order_disagreement_count')} / {s('variant_count')} AS order_disagreement,
  1.0 - {sens} AS underreaction_at_base_correct, 1.0 - {inv} AS overreaction_at_base_correct, {b} / {n} - {s('gcf_success')} / {n} AS gap{extra}
FROM {source}{' GROUP BY ' + by if by else ''}"""


def variants_of(spark: SparkSession, sf_dir: str, prompt: str = "standard") -> DataFrame:
    return judging.variant_results(scores(spark, sf_dir, prompt))


def families_of(spark: SparkSession, sf_dir: str, prompt: str = "standard") -> DataFrame:
    return judging.family_results(variants_of(spark, sf_dir, prompt))


def prompts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.prompt_results(scores(spark, sf_dir))


@query(f"{CTE} {_metrics_sql('f')}")
def summary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(families_of(spark, sf_dir))


_SLICES = "f JOIN (SELECT DISTINCT o_orderkey AS family_id, o_orderstatus AS task_family, o_orderpriority AS model_id FROM orders) o USING (family_id)"


@query(f"{CTE} {_metrics_sql(_SLICES, 'task_family, model_id')}")
def summary_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(families_of(spark, sf_dir).join(orders_of(spark, sf_dir).distinct(), "family_id"), ["task_family", "model_id"])


_VARIANT_COLUMNS = (
    "family_id, variant_id, gold_winner_cid, scores_ab_c1, scores_ab_c2, scores_ba_c1, scores_ba_c2, scores_agg_c1, scores_agg_c2, pred_winner_cid, "
    "order_pred_ab, order_pred_ba, pred_tie, order_tie_ab, order_tie_ba, order_disagree"
)


@query(f"{CTE} SELECT {_VARIANT_COLUMNS} FROM v")
def variant_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants_of(spark, sf_dir).select(*_VARIANT_COLUMNS.split(", "))


_FAMILY_COLUMNS = "family_id, base_correct, paraphrase_all_correct, counterfactual_correct, tie_count, variant_count, order_disagreement_count, gcf_success"


@query(f"{CTE} SELECT {_FAMILY_COLUMNS} FROM f")
def family_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families_of(spark, sf_dir).select(*_FAMILY_COLUMNS.split(", "))


_SUBSETS = """, subsets AS (
  SELECT 'all_families' AS subset, * FROM f UNION ALL SELECT 'order_stable', * FROM f WHERE order_disagreement_count = 0
  UNION ALL SELECT 'order_unstable', * FROM f WHERE order_disagreement_count > 0 UNION ALL SELECT 'order_stable_no_ties', * FROM f WHERE order_disagreement_count = 0 AND tie_count = 0
)"""


@query(f"{CTE}{_SUBSETS} {_metrics_sql('subsets', 'subset', extra=', count(*)::DOUBLE / (SELECT count(*) FROM f) AS share_of_total_families')}")
def order_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_stability(families_of(spark, sf_dir))


_RATES = """SELECT variant_id, count(*) AS n_variants, avg(order_disagree) AS order_disagreement_rate, avg(pred_tie) AS pred_tie_rate,
  avg(greatest(order_tie_ab, order_tie_ba)) AS order_tie_any_rate, avg(1 - ok) AS variant_error_rate FROM v GROUP BY variant_id"""


@query(f"{CTE} {_RATES}")
def variant_order_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.variant_rates(variants_of(spark, sf_dir))


@query(f"""{CTE} SELECT o_orderstatus AS task_family, avg(order_disagree) FILTER (variant_id = 'base') AS base, avg(order_disagree) FILTER (variant_id = 'para_1') AS para_1,
  avg(order_disagree) FILTER (variant_id = 'para_2') AS para_2, avg(order_disagree) FILTER (variant_id = 'counterfactual') AS counterfactual
  FROM v JOIN orders ON o_orderkey = family_id GROUP BY 1""")
def variant_rate_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = variants_of(spark, sf_dir).join(orders_of(spark, sf_dir), "family_id")
    return met.groupBy("task_family").pivot("variant_id", ["base", "para_1", "para_2", "counterfactual"]).agg(F.avg("order_disagree"))


@query(f"""{CTE}{_ORDERS} SELECT count(*) AS n_prompt_instances, avg((pred_display_label = 'A')::INT) AS first_position_rate, avg((pred_display_label = 'B')::INT) AS second_position_rate,
  (count(*) FILTER (pred_display_label = 'B') - count(*) FILTER (pred_display_label = 'A'))::DOUBLE / count(*) AS position_bias_second_minus_first,
  avg((pred_display_label = 'TIE')::INT) AS tie_rate, count(*) FILTER (cid = 'c1')::DOUBLE / count(*) AS choose_c1_rate, count(*) FILTER (cid = 'c2')::DOUBLE / count(*) AS choose_c2_rate,
  (count(*) FILTER (cid = 'c2') - count(*) FILTER (cid = 'c1'))::DOUBLE / count(*) AS underlying_bias_c2_minus_c1
  FROM (SELECT *, CASE pred_display_label WHEN 'A' THEN displayed_cid_a WHEN 'B' THEN displayed_cid_b END AS cid FROM labelled)""")
def position_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prompts_of(spark, sf_dir)
    return metrics.position_preference(p, judging.chosen(p))


REPS = BOOTSTRAP_REPLICATES


def _boot_sql(reps: int, by: str, families: str) -> str:
    """CTEs after the families: bounds per metric by the md5 draws. families: name of a table with the slice's columns."""
    on, part = (f"USING ({by}, ordinal)", f"PARTITION BY {by} ") if by else ("USING (ordinal)", "")
    lead = by + ", " if by else ""
    long = " UNION ALL ".join(f"SELECT {lead}'{m}' AS metric, {m} AS value FROM repmetrics" for m in resample.NAMES)
    points = " UNION ALL ".join(f"SELECT {lead}'{m}' AS metric, {m} AS point_estimate FROM pointmetrics" for m in resample.NAMES)
    return f""", numbered AS (SELECT *, row_number() OVER ({part}ORDER BY family_id) - 1 AS ordinal, count(*) OVER ({part.strip()}) AS total FROM {families}
), slices AS (SELECT DISTINCT {lead}total FROM numbered
), pairs AS (SELECT rep, pair, md5(rep || ':' || pair) AS digits FROM range({reps}) r(rep), range((SELECT (max(total) + 1) // 2 FROM slices)) q(pair)
), draws AS (SELECT {lead}rep, ('0x' || substr(digits, 1 + 16 * side, 15))::BIGINT % total AS ordinal FROM slices, pairs, range(2) s(side) WHERE 2 * pair + side < total
), drawn AS (SELECT * FROM draws JOIN numbered {on}
), repmetrics AS ({_metrics_sql('drawn', lead + 'rep')}
), pointmetrics AS ({_metrics_sql(families, by)}
), longs AS ({long}), points AS ({points}
), ranked AS (SELECT {lead}metric, list(value ORDER BY value) FILTER (value IS NOT NULL) AS v FROM longs GROUP BY {lead}metric
), bounds AS (SELECT {lead}metric, point_estimate, v[greatest(0, floor(len(v) * 0.025::DOUBLE)::INT - 1) + 1] AS ci_lower, v[least(len(v) - 1, floor(len(v) * 0.975::DOUBLE)::INT) + 1] AS ci_upper
  FROM points LEFT JOIN ranked USING ({lead}metric))"""


@query(f"{CTE}{_boot_sql(REPS, '', 'f')} SELECT metric, point_estimate, ci_lower, ci_upper FROM bounds")
def bootstrap_ci_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = families_of(spark, sf_dir)
    return resample.hash_bootstrap(f, [], REPS)


@query()
def bootstrap_ci_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = families_of(spark, sf_dir)
    return resample.exact_bootstrap(f, REPS, BOOTSTRAP_SEED)


_BY = ["task_family"]
_SLICED = ", fs AS (SELECT f.*, task_family FROM f JOIN (SELECT DISTINCT o_orderkey AS family_id, o_orderstatus AS task_family FROM orders) USING (family_id))"
_SLICED2 = ", fs2 AS (SELECT f2.*, task_family FROM f2 JOIN (SELECT DISTINCT o_orderkey AS family_id, o_orderstatus AS task_family FROM orders) USING (family_id))"


def _sliced(spark: SparkSession, sf_dir: str, prompt: str = "standard") -> DataFrame:
    return families_of(spark, sf_dir, prompt).join(orders_of(spark, sf_dir).select("family_id", "task_family").distinct(), "family_id")


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict = _sliced(spark, sf_dir, "strict")
    ci = resample.hash_bootstrap(strict, _BY, REPS)
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    ci = ci.groupBy(*_BY).agg(pick("gap", "ci_lower").alias("gap_ci_lower"), pick("gap", "ci_upper").alias("gap_ci_upper"), pick("sensitivity_at_base_correct", "ci_lower").alias("sens_ci_lower"), pick("sensitivity_at_base_correct", "ci_upper").alias("sens_ci_upper"))
    return metrics.strict_delta(metrics.summary(_sliced(spark, sf_dir), _BY), metrics.summary(strict, _BY), ci, _BY, METRICS, F.col("task_family") == "P")


_DELTA = f"""{BOTH}{_SLICED}{_SLICED2}{_boot_sql(REPS, 'task_family', 'fs2')}, m1 AS ({_metrics_sql('fs', 'task_family')}), m2 AS ({_metrics_sql('fs2', 'task_family')}
), ci AS (SELECT task_family, max(ci_lower) FILTER (metric = 'gap') AS gap_ci_lower, max(ci_upper) FILTER (metric = 'gap') AS gap_ci_upper,
  max(ci_lower) FILTER (metric = 'sensitivity_at_base_correct') AS sens_ci_lower, max(ci_upper) FILTER (metric = 'sensitivity_at_base_correct') AS sens_ci_upper FROM bounds GROUP BY task_family
), delta AS (SELECT task_family, {', '.join(f'm1.{m} AS {m}_standard, m2.{m} AS {m}_strict, m2.{m} - m1.{m} AS {m}_delta' for m in METRICS)},
  gap_ci_lower, gap_ci_upper, sens_ci_lower, sens_ci_upper, coalesce(m2.gap >= 0.05 AND gap_ci_lower > 0, false) AS strict_gap_gate,
  coalesce(task_family = 'P' AND m2.sensitivity_at_base_correct <= 0.9 AND sens_ci_upper < 0.95, false) AS strict_rubric_gate
  FROM m1 JOIN m2 USING (task_family) JOIN ci USING (task_family)), gated AS (SELECT *, strict_gap_gate OR strict_rubric_gate AS gate_passed FROM delta)"""


@query(f"{_DELTA} SELECT * FROM gated")
def strict_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta(spark, sf_dir)


@query(f"""{_DELTA} SELECT *, CASE WHEN supported_slice_count > 0 THEN 'supported' WHEN helped_slice_count > 0 AND residual_slice_count > 0 THEN 'partially supported' ELSE 'unsupported' END AS status
  FROM (SELECT count(*) FILTER (gate_passed) AS supported_slice_count, count(*) FILTER (gap_delta <= -0.01) AS helped_slice_count, count(*) FILTER (gap_strict > 0) AS residual_slice_count FROM gated)""")
def strict_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.decision(_delta(spark, sf_dir))


@query(f"""{CTE}{_SLICED}{_boot_sql(REPS, 'task_family', 'fs')} SELECT task_family, CASE WHEN task_family = 'P' THEN 'rubric / standard' ELSE 'keyed / standard' END AS slice_label,
  metric, point_estimate, ci_lower, ci_upper FROM bounds""")
def results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _sliced(spark, sf_dir)
    label = F.concat(F.when(F.col("task_family") == "P", "rubric").otherwise("keyed"), F.lit(" / standard"))
    return resample.hash_bootstrap(f, _BY, REPS).withColumn("slice_label", label)


_AUDIT = """, failed AS (SELECT family_id FROM f WHERE gcf_success = 0
), primary_ AS (SELECT v.*, row_number() OVER (PARTITION BY family_id ORDER BY k) AS place FROM v JOIN failed USING (family_id) WHERE ok = 0
), audit AS (SELECT family_id, variant_id AS primary_variant_id, CASE WHEN family_id % 97 = 0 THEN 'data_bug' WHEN pred_tie = 1 THEN 'model_tie' WHEN order_disagree = 1 THEN 'order_effect'
  ELSE 'genuine_criterion_failure' END AS primary_label FROM primary_ WHERE place = 1)"""


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing families, their first failing variant in canonical order and the label."""
    v = variants_of(spark, sf_dir).join(families_of(spark, sf_dir).where("gcf_success = 0").select("family_id"), "family_id", "left_semi")
    place = F.array_position(F.array(*[F.lit(x) for x in ("base", "para_1", "para_2", "counterfactual")]), F.col("variant_id"))
    first = v.where("pred_winner_cid <> gold_winner_cid").groupBy("family_id").agg(F.min_by(F.struct("variant_id", "pred_tie", "order_disagree"), place).alias("p"))
    # A family whose metadata fails its checks is a data bug; here every 97th stands for one.
    label = F.when(F.col("family_id") % 97 == 0, "data_bug").when(F.col("p.pred_tie") == 1, "model_tie").when(F.col("p.order_disagree") == 1, "order_effect").otherwise("genuine_criterion_failure")
    return first.select("family_id", F.col("p.variant_id").alias("primary_variant_id"), label.alias("primary_label"))


@query(f"{CTE}{_AUDIT} SELECT * FROM audit")
def failure_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir)


@query(f"{CTE}{_AUDIT} SELECT primary_label, count(*) AS n FROM audit GROUP BY 1")
def failure_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).groupBy("primary_label").agg(F.count("*").alias("n"))


@query(f"{CTE}{_AUDIT} SELECT family_id, primary_variant_id, primary_label, o_orderpriority AS model_id, scores_agg_c1, scores_agg_c2 FROM audit JOIN orders ON o_orderkey = family_id JOIN v USING (family_id) WHERE variant_id = primary_variant_id")
def audit_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = variants_of(spark, sf_dir).select("family_id", F.col("variant_id").alias("primary_variant_id"), "scores_agg_c1", "scores_agg_c2")
    return audited(spark, sf_dir).join(orders_of(spark, sf_dir).select("family_id", "model_id"), "family_id").join(v, ["family_id", "primary_variant_id"])


@query(f"{CTE}{_AUDIT} SELECT * FROM audit ORDER BY md5('7:' || family_id), family_id LIMIT 50")
def audit_sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.hash_sample(audited(spark, sf_dir), 50, 7, "family_id")


@query()
def audit_sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.exact_sample(audited(spark, sf_dir), 50, 2026, "family_id")


@query(f"""{CTE}{_ORDERS}, shown AS (SELECT family_id, k, variant_id || '(' || string_agg(order_id || '=' || pred_display_label, ' ' ORDER BY order_id) || ')' AS t FROM labelled GROUP BY family_id, k, variant_id)
  SELECT family_id, string_agg(t, ';' ORDER BY k) AS nested, gcf_success FROM shown JOIN f USING (family_id) GROUP BY family_id, gcf_success""")
def nested_family_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts fold into variants, variants in canonical order into families."""
    p = prompts_of(spark, sf_dir)
    v = p.groupBy("family_id", "variant_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order_id", "pred_display_label"))), lambda x: F.concat_ws("=", x["order_id"], x["pred_display_label"])), " ").alias("t"))
    place = F.array_position(F.array(*[F.lit(x) for x in ("base", "para_1", "para_2", "counterfactual")]), F.col("variant_id"))
    n = v.groupBy("family_id").agg(F.sort_array(F.collect_list(F.struct(place.alias("k"), F.concat("variant_id", F.lit("("), "t", F.lit(")")).alias("t")))).alias("x"))
    return n.join(families_of(spark, sf_dir).select("family_id", "gcf_success"), "family_id").select("family_id", F.array_join(F.transform("x", lambda x: x["t"]), ";").alias("nested"), "gcf_success")


@query(f"{CTE} {_RATES} ORDER BY order_disagreement_rate DESC, variant_id LIMIT 3")
def top_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.variant_rates(variants_of(spark, sf_dir)).orderBy(F.desc("order_disagreement_rate"), "variant_id").limit(3)


#: In the rendering, the task is the order, the criterion the variant, the candidates two keys of the line.
_PREFIX = f"""{CTE}, rendered AS (SELECT family_id, k, variant_id, o AS order_id, 'SYSTEM:' || chr(10) || '{SYSTEM_PROMPTS['standard']}' || chr(10) || chr(10) || 'USER:' || chr(10)
  || 'Task:' || chr(10) || 'Order ' || family_id || chr(10) || chr(10) || 'Criterion:' || chr(10) || variant_id || chr(10) || chr(10) || 'Candidate A:' || chr(10)
  || CASE WHEN o = 'AB' THEN 'part ' || l_partkey ELSE 'supplier ' || l_suppkey END || chr(10) || chr(10) || 'Candidate B:' || chr(10)
  || CASE WHEN o = 'AB' THEN 'supplier ' || l_suppkey ELSE 'part ' || l_partkey END || chr(10) || chr(10)
  || 'Which candidate better satisfies the criterion?' || chr(10) || 'Final label:' || chr(10) || chr(10) || 'ASSISTANT:' || chr(10) AS prefix
  FROM v, (VALUES ('AB'), ('BA')) x(o))"""


def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered prefix of every prompt."""
    from palimpsest.operators.rendering import prefix

    li = read(spark, sf_dir, "lineitem").where("l_linenumber <= 4")
    keys = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")).alias("r"))
    names = F.array(*[F.lit(x) for x in ("base", "para_1", "para_2", "counterfactual")])
    whole = Window.partitionBy("l_orderkey")
    v = keys.withColumn("n", F.count("*").over(whole)).where("n = 4").select(F.col("l_orderkey").alias("family_id"), F.col("l_linenumber").alias("k"), names[F.col("l_linenumber") - 1].alias("variant_id"), "r.l_partkey", "r.l_suppkey")
    p = v.withColumn("order_id", F.explode(F.array(F.lit("AB"), F.lit("BA"))))
    one, two = F.concat(F.lit("part "), F.col("l_partkey")), F.concat(F.lit("supplier "), F.col("l_suppkey"))
    ab = F.col("order_id") == "AB"
    text = prefix("standard", F.concat(F.lit("Order "), F.col("family_id")), F.col("variant_id"), F.when(ab, one).otherwise(two), F.when(ab, two).otherwise(one))
    return p.select("family_id", "k", "variant_id", "order_id", text.alias("prefix"))


@query(f"{_PREFIX} SELECT family_id, variant_id, order_id, sha256(prefix) AS prefix_sha256, length(prefix) AS prefix_length FROM rendered")
def prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prefixes(spark, sf_dir)
    return p.select("family_id", "variant_id", "order_id", F.sha2("prefix", 256).alias("prefix_sha256"), F.length("prefix").cast("long").alias("prefix_length"))


@query(f"{_PREFIX} SELECT family_id, variant_id, order_id, prefix FROM rendered ORDER BY family_id, k, order_id LIMIT 5")
def first_n_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes(spark, sf_dir).orderBy("family_id", "k", "order_id").limit(5).select("family_id", "variant_id", "order_id", "prefix")


@query(f"""{CTE} SELECT family_id, variant_id, 0.5::DOUBLE * (scores_ab_c1 + scores_ba_c1) AS mean_c1, scores_ab_c1 - scores_ab_c2 AS gap_ab,
  CASE WHEN abs(scores_ab_c1 - scores_ab_c2) <= 1e-6 THEN 'TIE' WHEN scores_ab_c1 > scores_ab_c2 THEN 'A' ELSE 'B' END AS label_ab FROM v""")
def score_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = variants_of(spark, sf_dir)
    return v.select("family_id", "variant_id", F.col("scores_agg_c1").alias("mean_c1"), (F.col("scores_ab_c1") - F.col("scores_ab_c2")).alias("gap_ab"), judging.display_label(F.col("scores_ab_c1"), F.col("scores_ab_c2")).alias("label_ab"))


@query(f"""{CTE} SELECT sum(ok)::DOUBLE / nullif(count(*), 0) AS rate, sum(ok)::DOUBLE / nullif(sum(ok * 0), 0) AS empty_rate, avg(length(variant_id)) AS mean_length,
  CASE WHEN sum(ok * 0) > 0 THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END AS guarded FROM v""")
def guarded_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.functions.text import char_length, ratio_or_inf

    ok = (F.col("pred_winner_cid") == F.col("gold_winner_cid")).cast("int")
    s = variants_of(spark, sf_dir).agg(F.sum(ok).alias("s"), F.count("*").alias("n"), F.sum(ok * 0).alias("z"), F.avg(char_length(F.col("variant_id"))).alias("mean_length"))
    return s.select(F.try_divide("s", "n").alias("rate"), F.try_divide("s", "z").alias("empty_rate"), "mean_length", ratio_or_inf(F.col("s").cast("double"), F.col("z")).alias("guarded"))

"""Queries over texts, claims, queues and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.fixed import SLOTS
from palimpsest.functions import text as X
from palimpsest.operators import canonical, ledger, rendering, validate
from palimpsest.plans.building import _FACTS, _QA, _facts, _items, bucket_sql, norm_sql, split_sql, tokens_sql
from palimpsest.plans.registry import query
from palimpsest.sources.shared import workspace
from palimpsest.sources.tables import read, with_split
from palimpsest.streaming import runner, states
from palimpsest.streaming.store import Store


@query(f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.normalize_exact(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "norm").select("doc_id", "norm")


@query(f"SELECT conv_id, turn, CAST({tokens_sql('n')} AS BIGINT) AS tokens, length(n) AS chars FROM (SELECT *, {norm_sql('text')} AS n FROM conversations)")
def token_char_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.normalize_exact(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", "n")
    return c.select("conv_id", "turn", X.token_count(F.col("n")).alias("tokens"), X.char_length(F.col("n")).alias("chars"))


@query("SELECT p_partkey, trim(regexp_replace(lower(trim(p_name || ' / ' || p_type)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", X.slugify(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


@query("SELECT p_partkey, 'qa-key__' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') || '__standard__test' AS run_stem FROM part")
def run_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("__", X.slugify(F.lit("qa_key")), X.slugify(F.col("p_brand")), F.lit("standard"), F.lit("test")).alias("run_stem"))


@query("SELECT p_partkey, sha256(p_partkey || '|' || p_name || '|' || p_brand) AS digest FROM part")
def row_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.sha2(F.concat_ws("|", "p_partkey", "p_name", "p_brand"), 256).alias("digest"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    rank = F.when(F.col("event_type") == "purchase", "preferred").when(F.col("event_type") == "error", "deprecated").otherwise("normal")
    return e.select("event_id", F.col("user_id").alias("subject_id"), F.get_json_object("props", "$.k").cast("long").alias("property"), rank.alias("rank"))


_CLAIMS = """WITH claims AS (SELECT event_id, user_id AS subject_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS property,
  CASE event_type WHEN 'purchase' THEN 'preferred' WHEN 'error' THEN 'deprecated' ELSE 'normal' END AS rank FROM events)"""


@query(f"""{_CLAIMS} SELECT event_id, subject_id, property, rank FROM claims c WHERE rank = 'preferred' OR rank = 'normal' AND NOT EXISTS
  (SELECT 1 FROM claims p WHERE p.subject_id = c.subject_id AND p.property IS NOT DISTINCT FROM c.property AND p.rank = 'preferred')""")
def best_rank_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.best_rank(_claims(spark, sf_dir), ["subject_id", "property"])


@query(f"{_CLAIMS} SELECT event_id, 'Q' || property AS target, list_position(['deprecated', 'normal', 'preferred'], rank) AS rank_order FROM claims WHERE property IS NOT NULL")
def claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON to an array of structs, one row per claim, the target as Q + number."""
    e = read(spark, sf_dir, "events")
    parsed = F.from_json(F.concat(F.lit("["), "props", F.lit("]")), "array<struct<k:bigint>>")
    rank = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "error", 1).otherwise(2)
    c = e.select("event_id", rank.alias("rank_order"), F.explode(parsed).alias("c")).where("c.k IS NOT NULL")
    return c.select("event_id", F.concat(F.lit("Q"), F.col("c.k")).alias("target"), "rank_order")


@query("""SELECT 'C' || c_custkey AS entity_id, o_orderpriority AS slot, count(*) AS n_rows FROM customer JOIN orders ON o_custkey = c_custkey
  WHERE c_acctbal >= 0 AND c_custkey % 17 <> 0 GROUP BY ALL HAVING count(*) >= 2""")
def eligible_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human (semi-join) with an occupation (semi-join), slots of two rows at least."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("slot"))
    human, employed = c.where("c_custkey % 17 <> 0").select("c_custkey"), c.where("c_acctbal >= 0").select("c_custkey")
    rows = o.join(human, "c_custkey", "left_semi").join(employed, "c_custkey", "left_semi")
    return rows.groupBy(F.concat(F.lit("C"), F.col("c_custkey")).alias("entity_id"), "slot").agg(F.count("*").alias("n_rows")).where("n_rows >= 2")


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moves_of(read(spark, sf_dir, "events"))


def _moves_of(e: DataFrame) -> DataFrame:
    state = F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "view", "INFLIGHT").when(F.col("event_type") == "purchase", "COMPLETE").when(F.col("event_type") == "error", "FAILED")
    return e.select("event_id", "ts", F.col("user_id").alias("family_id"), state.alias("state"))


_EVENTS = """WITH trans AS (SELECT event_id, ts, user_id AS family_id, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'INFLIGHT' WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'FAILED' END AS state FROM events
), moves AS (SELECT * FROM trans WHERE state IS NOT NULL
), last AS (SELECT family_id, arg_max(state, (ts, event_id)) AS state, count(*) FILTER (state = 'INFLIGHT') AS retries FROM moves GROUP BY family_id)"""


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transitions(spark, sf_dir).where("state IS NOT NULL")


@query(f"{_EVENTS} SELECT family_id, state FROM last")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest_state(_moves(spark, sf_dir))


@query(f"{_EVENTS} SELECT count(*) FILTER (state = 'PENDING') AS pending, count(*) FILTER (state = 'INFLIGHT') AS inflight, count(*) FILTER (state = 'COMPLETE') AS complete, count(*) FILTER (state = 'FAILED') AS failed FROM last")
def queue_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.progress(ledger.latest_state(_moves(spark, sf_dir)))


@query(f"{_EVENTS} SELECT DISTINCT family_id FROM trans WHERE family_id NOT IN (SELECT family_id FROM last WHERE state = 'COMPLETE')")
def pending_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.pending(_transitions(spark, sf_dir).select("family_id").distinct(), ledger.latest_state(_moves(spark, sf_dir)))


@query(f"{_EVENTS} SELECT family_id, CASE WHEN state = 'INFLIGHT' THEN 'PENDING' ELSE state END AS state, retries, CAST(state = 'INFLIGHT' AS INTEGER) AS stale_recovered FROM last")
def stale_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.recovery(_moves(spark, sf_dir))


_NUMBERED = """numbered AS (SELECT *, CAST(sum(CAST(state = 'PENDING' AS INTEGER)) OVER (PARTITION BY family_id ORDER BY ts, event_id) AS BIGINT) AS attempt FROM moves)
  SELECT family_id, attempt, count(*) AS n_events, CASE arg_max(state, (ts, event_id)) WHEN 'COMPLETE' THEN 'COMPLETED' WHEN 'FAILED' THEN 'FAILED' WHEN 'PENDING' THEN 'PAUSED' ELSE 'RUNNING' END AS status FROM numbered GROUP BY ALL"""


@query(f"{_EVENTS}, {_NUMBERED}")
def attempt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.attempts(_moves(spark, sf_dir))


@query(f"{_EVENTS} SELECT family_id, state FROM last")
def compacted_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of a ledger, each with the last transitions of a third of the time; two are compacted, one is its tail."""
    moves, at = _moves(spark, sf_dir), workspace(spark, "ledger")
    first, last = (r or 0 for r in moves.agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp"))), F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first())
    third = F.least(F.lit(2), F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - first) * 3 / F.lit(max(1, last - first))))
    held = Store(spark, at, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    for k in range(3):
        own = moves.where(third == k).groupBy("family_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"))
        runner.append(spark, at, k, lambda own=own: own)
        if k == 1:
            held.compact()
    return held.latest().select("family_id", "state")


#: Stands for no family.
CLOCK = -1


def _followed(spark: SparkSession, sf_dir: str) -> str:
    """The events taken in as a stream, with the clock moved on at the end by what comes after all of them; the table's folder."""
    events = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    table = workspace(spark, "states")
    # A transition of a family that is none, long after all others: it only moves the watermark, so that all timers fire.
    end = events.agg((F.max("event_id") + 1).alias("event_id"), (F.max("ts") + F.expr("INTERVAL 90 DAYS")).alias("ts")).where("ts IS NOT NULL")
    events.unionByName(end.withColumn("user_id", F.lit(CLOCK).cast("long")).withColumn("event_type", F.lit("purchase"))).write.parquet(f"{table}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{table}/in")
    states.follow(spark, _moves_of(stream), table, delay="60 days", stale_after_s=86400.0)
    return table


@query(f"{_EVENTS} SELECT family_id, CASE WHEN state = 'INFLIGHT' THEN 'PENDING' ELSE state END AS state, retries, CAST(state = 'INFLIGHT' AS INTEGER) AS stale_recovered FROM last")
def followed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T01, T02 as keyed state of a stream."""
    return states.family_states(spark, _followed(spark, sf_dir)).where(F.col("family_id") != CLOCK)


@query(f"{_EVENTS}, {_NUMBERED}")
def followed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T03 as keyed state of a stream."""
    return states.attempt_history(spark, _followed(spark, sf_dir)).where(F.col("family_id") != CLOCK)


@query("""WITH RECURSIVE e AS (SELECT user_id AS family_id, row_number() OVER w AS i, greatest(epoch_us(ts) - lag(epoch_us(ts)) OVER w, 1)::DOUBLE / 1e6 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), fold AS (SELECT family_id, i, 1.0::DOUBLE / gap AS r, gap FROM e WHERE i = 2
  UNION ALL SELECT e.family_id, e.i, 0.8::DOUBLE * f.r + 0.2::DOUBLE * (1.0::DOUBLE / e.gap), e.gap FROM fold f JOIN e ON e.family_id = f.family_id AND e.i = f.i + 1)
  SELECT family_id, max(i) - 1 AS n_steps, arg_max(r, i) AS rate_ewma, arg_max(gap, i) > greatest(120.0::DOUBLE, 5.0::DOUBLE / arg_max(r, i)) AS stalled FROM fold GROUP BY family_id""")
def heartbeat_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.heartbeat(_transitions(spark, sf_dir))


@query("""SELECT l_orderkey, l_linenumber, arg_max(l_quantity, (l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS l_quantity, arg_max(l_extendedprice, (l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS l_extendedprice
  FROM lineitem GROUP BY ALL""")
def keep_last_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of both halves of lineitem, then the last of each key."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    both = li.where("l_linenumber <= 3").unionByName(li.where("l_linenumber > 3"))
    return canonical.keep_last(both, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query(f"""WITH names AS (SELECT DISTINCT p_brand, {norm_sql('p_name')} AS n FROM part WHERE {norm_sql('p_name')} <> ''), lists AS (SELECT p_brand, string_agg(n, '|' ORDER BY n) AS aliases, list(n) AS l FROM names GROUP BY p_brand)
  SELECT p_partkey, aliases, NOT list_contains(l, 'antique') AS not_in_aliases FROM part JOIN lists USING (p_brand)""")
def alias_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other names of a brand as its aliases."""
    p = read(spark, sf_dir, "part")
    names = p.groupBy("p_brand").agg(canonical.aliases(F.collect_set("p_name")).alias("a"))
    return p.join(names, "p_brand").select("p_partkey", F.array_join("a", "|").alias("aliases"), (~F.array_contains("a", "antique")).alias("not_in_aliases"))


@query("""SELECT n_nationkey, n_name, r_name AS label, replace('In which region is {SUBJECT}?', '{SUBJECT}', n_name) AS question FROM nation JOIN region ON n_regionkey = r_regionkey WHERE trim(r_name) <> ''""")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to labels; ids without a label drop out."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region").where(F.trim("r_name") != "")
    met = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    return met.select("n_nationkey", "n_name", F.col("r_name").alias("label"), rendering.question(F.lit("In which region is {SUBJECT}?"), F.col("n_name")).alias("question"))


@query("""SELECT page_id, nullif(regexp_extract('http://www.wikidata.org/entity/Q' || page_id, '^https?://www\\.wikidata\\.org/entity/(.*)$', 1), '') AS entity_id, nullif(regexp_extract(url, '^https?://www\\.wikidata\\.org/entity/(.*)$', 1), '') AS from_url FROM pages""")
def url_host_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", X.entity_id(F.concat(F.lit("http://www.wikidata.org/entity/Q"), F.col("page_id"))).alias("entity_id"), X.entity_id(F.col("url")).alias("from_url"))


@query("""SELECT o_orderkey, substr(strftime(o_orderdate, '%Y-%m-%dT00:00:00Z'), 1, CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END) AS value FROM orders""")
def variable_precision_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    time = F.date_format("o_orderdate", "'+'yyyy-MM-dd'T00:00:00Z'")
    return o.select("o_orderkey", X.variable_date(time, 9 + F.col("o_orderkey") % 3).alias("value"))


@query("""SELECT task_family, model_id, prompt_id, task_family || '/' || model_id || '/' || prompt_id AS slice_id FROM (SELECT DISTINCT l_linestatus AS task_family FROM lineitem), (SELECT DISTINCT l_returnflag AS model_id FROM lineitem),
  (VALUES ('standard'), ('strict')) p(prompt_id) WHERE NOT (task_family = 'O' AND model_id = 'A')""")
def slice_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: tasks x models x prompts with a filter; each side is a handful of distinct values."""
    li = read(spark, sf_dir, "lineitem")
    prompts = spark.createDataFrame([("standard",), ("strict",)], "prompt_id string")
    grid = li.select(F.col("l_linestatus").alias("task_family")).distinct().crossJoin(li.select(F.col("l_returnflag").alias("model_id")).distinct()).crossJoin(prompts)
    return grid.where("NOT (task_family = 'O' AND model_id = 'A')").withColumn("slice_id", F.concat_ws("/", "task_family", "model_id", "prompt_id"))


@query("""SELECT t AS task_family, s AS model_id, count(l_orderkey) AS n_rows, 2 * count(l_orderkey) AS n_candidates, 4 * count(l_orderkey) AS n_variants FROM (SELECT DISTINCT l_linestatus AS t FROM lineitem) CROSS JOIN (SELECT DISTINCT l_returnflag AS s FROM lineitem)
  LEFT JOIN lineitem ON l_linestatus = t AND l_returnflag = s GROUP BY ALL""")
def slice_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero for combinations without rows."""
    li = read(spark, sf_dir, "lineitem")
    n = li.groupBy(F.col("l_linestatus").alias("task_family"), F.col("l_returnflag").alias("model_id")).agg(F.count("*").alias("n"))
    grid = n.select("task_family").distinct().crossJoin(n.select("model_id").distinct())
    rows = F.coalesce("n", F.lit(0))
    return grid.join(n, ["task_family", "model_id"], "left").select("task_family", "model_id", rows.alias("n_rows"), (2 * rows).alias("n_candidates"), (4 * rows).alias("n_variants"))


#: Rows of both key sets that one task groups, on average.
ROWS_A_TASK = 2_000_000


@query("""SELECT 'missing' AS side, l_orderkey AS key FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders) UNION ALL
  SELECT 'extra', o_orderkey FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)""")
def key_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both set differences of the keys."""
    a, b = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    # One grouping by key, dealt first: so its tables stay small however long a file's split is. A null key is one key, as in EXCEPT.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(a.count() + b.count()) // ROWS_A_TASK))
    both = a.withColumn("sides", F.lit(1)).unionByName(b.withColumn("sides", F.lit(2))).repartition(parts, "key")
    seen = both.groupBy("key").agg(F.bit_or("sides").alias("sides")).where("sides <> 3")
    return seen.select(F.when(F.col("sides") == 1, "missing").otherwise("extra").alias("side"), "key")


@query(f"""{_FACTS}, have AS (SELECT entity_id, list(DISTINCT slot) AS s FROM facts GROUP BY entity_id)
  SELECT entity_id, array_to_string(list_filter(['occupation', 'notable_work', 'award', 'field'], lambda x: NOT list_contains(s, x)), ',') AS missing_slots FROM have""")
def slot_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots that an entity lacks."""
    have = _facts(spark, sf_dir).groupBy("entity_id").agg(F.collect_set("slot").alias("s"))
    return have.select("entity_id", F.array_join(F.array_except(F.array(*[F.lit(x) for x in SLOTS]), "s"), ",").alias("missing_slots"))


_TYPES = {"p_brand": "brand", "n_region": "location"}


@query(f"""{_QA}, faulty AS (SELECT * REPLACE (CASE WHEN bucket % 5 = 0 THEN '  ' ELSE answer_text END AS answer_text, CASE WHEN bucket % 7 = 0 THEN 'colour' ELSE coarse_type END AS coarse_type,
    CASE WHEN bucket = 3 THEN 'p_none' ELSE relation_id END AS relation_id) FROM items), bad AS (SELECT qa_id, array_to_string(list_filter([CASE WHEN trim(answer_text) = '' THEN 'blank_answer_text' END,
    CASE WHEN relation_id NOT IN ('p_brand', 'n_region') THEN 'unknown_relation' END, CASE WHEN coalesce(CASE relation_id WHEN 'p_brand' THEN 'brand' WHEN 'n_region' THEN 'location' END, '') <> coarse_type THEN 'wrong_coarse_type' END], lambda x: x IS NOT NULL), ',') AS violations FROM faulty)
  SELECT * FROM bad WHERE violations <> ''""")
def qa_item_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V02, V07 on rows with injected faults."""
    i = with_split(_items(spark, sf_dir), "qa_id")
    b = F.col("bucket")
    i = i.withColumns({
        "answer_text": F.when(b % 5 == 0, "  ").otherwise(F.col("answer_text")), "coarse_type": F.when(b % 7 == 0, "colour").otherwise(F.col("coarse_type")),
        "relation_id": F.when(b == 3, "p_none").otherwise(F.col("relation_id")),
    })
    return i.select("qa_id", F.array_join(validate.qa_item(_TYPES), ",").alias("violations")).where("violations <> ''")


@query(f"""{_FACTS}, faulty AS (SELECT entity_id, value_id, slot AS was, CASE WHEN length(value_text) % 4 = 0 THEN 'spouse' ELSE slot END AS slot, CASE WHEN length(value_text) % 6 = 0 THEN '' ELSE value_norm END AS value_norm FROM facts
), bad AS (SELECT entity_id, was, value_id, array_to_string(list_filter([CASE WHEN value_norm = '' THEN 'blank_value_norm' END, CASE WHEN slot = 'spouse' THEN 'disallowed_slot' END], lambda x: x IS NOT NULL), ',') AS violations FROM faulty)
  SELECT * FROM bad WHERE violations <> ''""")
def fact_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V03 on rows with injected faults."""
    n = F.length("value_text")
    f = _facts(spark, sf_dir).withColumn("was", F.col("slot")).withColumns({"slot": F.when(n % 4 == 0, "spouse").otherwise(F.col("slot")), "value_norm": F.when(n % 6 == 0, "").otherwise(F.col("value_norm"))})
    return f.select("entity_id", "was", "value_id", F.array_join(validate.entity_fact(), ",").alias("violations")).where("violations <> ''")


@query(f"""WITH m AS (SELECT p_name AS anchor_id, {bucket_sql('p_name')} + CASE WHEN p_size > 48 THEN 20 ELSE 0 END AS bucket, CASE WHEN p_size = 7 THEN 'holdout' ELSE {split_sql(bucket_sql('p_name'))} END AS split FROM part WHERE p_partkey <= 150
), n AS (SELECT *, count(*) OVER (PARTITION BY anchor_id) AS c FROM m), bad AS (SELECT anchor_id, bucket, split, array_to_string(list_filter([CASE WHEN trim(anchor_id) = '' THEN 'blank_anchor_id' END, CASE WHEN split = 'holdout' THEN 'unknown_split' END,
    CASE WHEN bucket > 19 THEN 'bucket_out_of_range' END, CASE WHEN c > 1 THEN 'duplicate_id' END], lambda x: x IS NOT NULL), ',') AS violations FROM n)
  SELECT violations, count(*) AS n FROM bad GROUP BY violations""")
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V06 on a manifest that repeats ids and breaks its ranges."""
    p = with_split(read(spark, sf_dir, "part").where("p_partkey <= 150").select(F.col("p_name").alias("anchor_id"), "p_size"), "anchor_id")
    p = p.withColumns({"bucket": F.col("bucket") + F.when(F.col("p_size") > 48, 20).otherwise(0), "split": F.when(F.col("p_size") == 7, "holdout").otherwise(F.col("split"))})
    return validate.manifest(p).groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 4), f AS (SELECT l_orderkey AS family_id, count(*) AS n FROM k GROUP BY 1)
  SELECT family_id, array_to_string(list_filter([CASE WHEN n <> 4 THEN 'wrong_variants' END, CASE WHEN family_id % 5 = 0 AND EXISTS (SELECT 1 FROM k WHERE l_orderkey = family_id AND l_linenumber = 4) AND EXISTS (SELECT 1 FROM k WHERE l_orderkey = family_id AND l_linenumber = 1) THEN 'counterfactual_not_flipped' END], lambda x: x IS NOT NULL), ',') AS violations
  FROM f WHERE EXISTS (SELECT 1 FROM k WHERE l_orderkey = family_id AND l_linenumber = 1)""")
def family_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V01 on families nested from lineitem: some lack variants, every fifth keeps its gold in the counterfactual."""
    k = read(spark, sf_dir, "lineitem").where("l_linenumber <= 4").select(F.col("l_orderkey").alias("family_id"), F.col("l_linenumber").alias("k")).distinct()
    pick = lambda *names: F.array(*[F.lit(x) for x in names])[F.col("k") - 1]
    flipped, same = F.col("k") == 4, F.col("family_id") % 5 == 0
    v = F.struct(
        pick("base", "para_1", "para_2", "counterfactual").alias("variant_id"), pick("base", "paraphrase", "paraphrase", "counterfactual").alias("kind"),
        F.when(flipped, "s_counterfactual").otherwise("s_base").alias("semantics_id"), F.when(flipped & ~same, "c2").otherwise("c1").alias("gold_winner_cid"),
    )
    f = k.groupBy("family_id").agg(F.collect_list(v).alias("variants"), F.max((F.col("k") == 1).cast("int")).alias("has_base")).where("has_base = 1")
    f = f.withColumn("split", F.lit("test")).withColumn("candidates", F.array(F.struct(F.lit("c1").alias("cid")), F.struct(F.lit("c2").alias("cid"))))
    return f.select("family_id", F.array_join(validate.family(), ",").alias("violations"))

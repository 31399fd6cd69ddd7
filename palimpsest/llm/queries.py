"""The queries of this subpackage: each operator over its whole table, reduced to its contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import chat, fingerprints, hard_negatives, html_text, importance, jaccard, language, licenses, mixing, near_vectors, packing, toxicity, url_filter
from palimpsest.llm.common import table

RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep_ids=False)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op3_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with its neighbour's last reply."""
    pairs = chat.format_preferences(chat.reply_swaps(chat.conversations(table(spark, sf_dir, "conversations"))))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("+", x["start"], x["length"])), ",")
    return pairs.select("conv_id", "n_prompt_turns", "prompt", "chosen", "rejected", spans("chosen_loss").alias("chosen_loss"), spans("rejected_loss").alias("rejected_loss"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = toxicity.remainder("doc_id", 3)
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), learn=part != 1)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (part == 1).alias("held_out"), "score", "predicted")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = toxicity.remainder("doc_id", 4)
    model = language.fit_languages(docs, learn=part != 2)
    named = language.identify(docs.select("doc_id", "text"), model, with_spans=False)
    return named.select("doc_id", (part == 2).alias("held_out"), "lang_pred", "score")


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = importance.weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), widest=1, n_buckets=10_000, percent=10, least_words=20, seed=2024)
    return weighed.select("doc_id", "n_features", "weight", "score", "rank")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), anchor=F.col("_id") % 100 == 0)


#: Null and no `://`: empty host and path. All hosts and paths as the contract of the operator defines them.
_JUDGED = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM parts
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM cut JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM cut LEFT JOIN fits USING (page_id)
"""

_PREFERENCES = r"""
WITH said AS (
  SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS k FROM conversations
), last AS (
  SELECT conv_id, count(*) AS n, coalesce(max(k) FILTER (role = 'assistant'), 0) AS reply FROM said GROUP BY conv_id
), sides AS (
  SELECT 'chosen' AS side, conv_id, k, role, text FROM said
  UNION ALL
  SELECT 'rejected', conv_id, k, role, text FROM said JOIN last USING (conv_id) WHERE reply = 0 OR k < reply
  UNION ALL
  SELECT 'rejected', own.conv_id, CASE WHEN own.reply > 0 THEN own.reply ELSE own.n + 1 END, s.role, s.text
  FROM last own JOIN last other ON other.conv_id = xor(own.conv_id, 1) AND other.reply > 0
  JOIN said s ON s.conv_id = other.conv_id AND s.k = other.reply
), matched AS (
  SELECT conv_id, k, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same FROM sides GROUP BY conv_id, k
), prompt AS (
  SELECT conv_id, CAST(coalesce(min(k) FILTER (NOT same) - 1, max(k)) AS INTEGER) AS n_prompt_turns FROM matched GROUP BY conv_id
), drawn AS (
  SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS turn FROM sides JOIN prompt USING (conv_id)
), placed AS (
  SELECT *, coalesce(sum(length(turn)) OVER (PARTITION BY side, conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM drawn WHERE k > n_prompt_turns
), completions AS (
  SELECT conv_id, coalesce(string_agg(turn, '' ORDER BY k) FILTER (side = 'chosen'), '') AS chosen,
    coalesce(string_agg(turn, '' ORDER BY k) FILTER (side = 'rejected'), '') AS rejected,
    coalesce(string_agg(CAST(before + 13 + length(role) AS BIGINT) || '+' || (length(text) + 10), ',' ORDER BY k) FILTER (side = 'chosen' AND role = 'assistant'), '') AS chosen_loss,
    coalesce(string_agg(CAST(before + 13 + length(role) AS BIGINT) || '+' || (length(text) + 10), ',' ORDER BY k) FILTER (side = 'rejected' AND role = 'assistant'), '') AS rejected_loss
  FROM placed GROUP BY conv_id
), prompts AS (
  SELECT conv_id, string_agg(turn, '' ORDER BY k) AS prompt FROM drawn WHERE side = 'chosen' AND k <= n_prompt_turns GROUP BY conv_id
)
SELECT conv_id, n_prompt_turns, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected,
       coalesce(chosen_loss, '') AS chosen_loss, coalesce(rejected_loss, '') AS rejected_loss
FROM prompt LEFT JOIN prompts USING (conv_id) LEFT JOIN completions USING (conv_id)
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ALNUM}')"

#: The checksum's table of 256 entries follows from its polynomial.
_RESAMPLED = f"""
WITH lookup AS (
  SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)
), docs AS (
  SELECT doc_id, {_WORDS} AS words FROM documents
), own AS (
  SELECT doc_id, unnest(words) AS word FROM docs
), seen AS (
  SELECT word, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM (SELECT 0 AS side, word FROM own UNION ALL SELECT 1, unnest({_WORDS}) FROM benchmark) GROUP BY word
), bytes AS (
  SELECT word, s, t, hex(encode(word)) AS h FROM seen
), hashed AS (
  SELECT word, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM bytes, lookup
), sums AS (
  SELECT bucket, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM hashed GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM sums
), weights AS (
  SELECT doc_id, sum(gain)::BIGINT AS weight FROM own JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (doc_id)
), placed AS (
  SELECT *, n_features >= 20 AS fit, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= n * 10 // 100 THEN place END AS rank FROM placed
"""


def _scanned() -> str:
    """Blocks and containment as the operator's docstring defines them, by plain counting."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(label)}, {licenses.step_of(len(licenses.words_of(t)))}, {quoted(t)})" for i, (label, t) in enumerate(licenses.TEMPLATES))
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, place, {quoted(label)} AS label FROM near WHERE " + " AND ".join(f"w{k} = {quoted(w)}" for k, w in enumerate(p.split())) for p, label in licenses.PHRASES
    )
    return f"""
WITH templates(template, label, step, text) AS (VALUES {rows}
), tokens AS (
  SELECT template, label, step, token, count(*) OVER (PARTITION BY template) AS size FROM (SELECT DISTINCT template, label, step, unnest({_WORDS}) AS token FROM templates)
), docs AS (
  SELECT doc_id, {_WORDS} AS words FROM documents
), stands AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM docs
), near AS (
  SELECT doc_id, place, word AS w0, lead(word, 1) OVER later AS w1, lead(word, 2) OVER later AS w2 FROM stands WINDOW later AS (PARTITION BY doc_id ORDER BY place)
), base AS (
  {phrases}
), told AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM base GROUP BY doc_id
), held AS (
  SELECT doc_id, place, word FROM stands WHERE word IN (SELECT token FROM tokens)
), blocks AS (
  SELECT DISTINCT doc_id, step, place // step - back AS block, word FROM held, (SELECT DISTINCT step FROM tokens), (VALUES (0), (1)) b(back) WHERE place // step >= back
), shared AS (
  SELECT doc_id, block, template, any_value(label) AS label, count(*) AS n_shared, any_value(size) AS size FROM blocks b JOIN tokens t ON t.step = b.step AND t.token = b.word
  GROUP BY doc_id, block, template HAVING 100 * count(*) >= {licenses.LEAST} * any_value(size)
), best AS (
  SELECT doc_id, max(n_shared / size) AS containment FROM shared GROUP BY doc_id
), named AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (own) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label, true AS own FROM base UNION ALL SELECT doc_id, label, false FROM shared) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0)::DOUBLE END AS score
FROM docs LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN named USING (doc_id)
"""


_HARD = """
WITH held AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score FROM held a JOIN held r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER best::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 10
"""

_OPERATORS = (
    op1_packing, op2_jaccard_join, op3_chat_preferences, op4_url_filter, op5_mixing, op6_toxicity, op7_language, op8_near_vectors, op9_fingerprints, op10_html_text,
    op11_importance, op12_licenses, op13_hard_negatives,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLES = {"op3_chat_preferences": _PREFERENCES, "op4_url_filter": _JUDGED, "op11_importance": _RESAMPLED, "op12_licenses": _scanned(), "op13_hard_negatives": _HARD}

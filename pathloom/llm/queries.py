"""The queries of this subpackage: one per operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.session import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.chat_format import conversation_digest

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    return conversation_digest(rows.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.decontaminate import contamination

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("rk")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.neardup import near_components

    return near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.lm_scoring import language_model_scores

    return language_model_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.substring_dedup import passage_report

    return passage_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_substring_dedup, op3_suffix_dedup, op4_lm_scoring, op5_quality_classifier, op6_decontaminate, op7_toxicity, op8_near_dedup, op9_nearest, op10_best_fit_packing)}

_SAID = "'</s>[INST] ok [/INST]'"
ORACLES = {}

# the template's escaping and markers, spelled out again: only lengths can be compared this way, texts by digest
_ESC = r"regexp_replace(regexp_replace({0}, '\\', '\\\\', 'g'), '(<|\[)(/?s>|/?INST\]|/?ROLE\])', '\1\\\2', 'g')"
ORACLES["op1_chat_format"] = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_SAID} UNION ALL SELECT -1, 1, 'assistant', {_SAID}),
e AS (SELECT *, length({_ESC.format('text')}) + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 7 ELSE 20 + length({_ESC.format('role')}) END AS m FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(m) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLES["op6_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') AS x
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, ls WHERE len(w) >= l)),
h AS (SELECT doc_id, s, dw.l AS l, item_id FROM dw JOIN bw ON dw.x = bw.x AND dw.l = bw.l),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)"""

_SPACED = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ORACLES["op8_near_dedup"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS t FROM d),
c AS (SELECT t, min(doc_id) AS rep, len(t) AS n FROM s WHERE len(t) > 0 GROUP BY t),
x AS (SELECT rep, n, unnest(t) AS v FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM x a JOIN x b ON a.v = b.v AND a.rep < b.rep GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT rep AS node, rep AS seen FROM c UNION SELECT r.node, g.b FROM r JOIN g ON g.a = r.seen),
l AS (SELECT node, min(seen) AS label FROM r GROUP BY 1)
SELECT s.doc_id, len(s.t) AS n_shingles, coalesce(l.label, s.doc_id) AS component_id, coalesce(l.label, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.t = c.t LEFT JOIN l ON l.node = c.rep"""

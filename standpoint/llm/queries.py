"""The registered queries of this subpackage, and the SQL that must give the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standpoint.llm import bit_sliced_topk, conversation_repair, kneser_ney, pfair_mixing, quality_rules, secret_scan, seekable_fim, simhash_anchors, suffix_dedup, template_decontamination, tool_calls, toxicity_knn, warc_archive


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.apply_policy(quality_rules.ledger(_docs(spark, sf)))


def op2_toxicity_knn(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity_knn.score_documents(_docs(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.deduplicate(_docs(spark, sf))


def op4_pfair_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return pfair_mixing.mix(_docs(spark, sf).select("doc_id", "source"))


def op5_simhash_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_anchors.near_duplicates(_docs(spark, sf))


def op6_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan(_docs(spark, sf))


def op7_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    messages = tool_calls.with_tool_calls(spark.read.parquet(f"{sf}/conversations.parquet"))
    return tool_calls.format_messages(messages, tool_calls.TOOLS)


def op8_warc_archive(spark: SparkSession, sf: str) -> DataFrame:
    return warc_archive.round_trip(spark.read.parquet(f"{sf}/pages.parquet"))


def op9_kneser_ney(spark: SparkSession, sf: str) -> DataFrame:
    return kneser_ney.score_documents(_docs(spark, sf))


def op10_template_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return template_decontamination.leaks(_docs(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")).select(
        "doc_id", "item_id", "n_windows", "n_item_windows", "share", "verbatim")


def op11_bit_sliced_topk(spark: SparkSession, sf: str) -> DataFrame:
    return bit_sliced_topk.nearest(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_repair.report(spark.read.parquet(f"{sf}/conversations.parquet"))


def op13_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    return seekable_fim.digests(seekable_fim.fill_in_middle(_docs(spark, sf)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_toxicity_knn, op3_suffix_dedup, op4_pfair_mixing, op5_simhash_anchors, op6_secret_scan, op7_tool_calls, op8_warc_archive, op9_kneser_ney, op10_template_decontamination, op11_bit_sliced_topk, op12_conversation_repair, op13_fill_in_middle)
}

_RULES = " + ".join(f"CASE WHEN {c} THEN {1 << r} ELSE 0 END" for r, (_, c) in enumerate(quality_rules.RULES))
_OP1 = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper,
         CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclamations
  FROM w LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, CAST({_RULES} AS BIGINT) AS failures FROM m)
SELECT *, failures & {quality_rules.BASE} <> 0 AS base_failed, failures & {quality_rules.POLICIES['web-2']} = 0 AS kept, 'web-2' AS policy FROM f
"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_OP8 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0],
         lambda s: substr('{_LETTERS}', 1 + CAST((CAST('0x' || substr(hex, 5 * g + 1, 5) AS INTEGER) >> s) & 31 AS INTEGER), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""

_OP11 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 20
"""

_OP13 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256(concat('1:', doc_id)) AS h
  FROM documents),
h AS (
  SELECT *, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle)
                        ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

SQL: dict[str, str] = {"op1_quality_rules": _OP1, "op8_warc_archive": _OP8, "op11_bit_sliced_topk": _OP11, "op13_fill_in_middle": _OP13}

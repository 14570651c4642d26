"""The queries of this subpackage, one per operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, licences, media, mixing, pii, quality, sharding, simjoin


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def _in_fold(modulus: int, rest: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus == rest


#: A document is predicted to be good from this score on.
QUALITY_THRESHOLD = 0.3


def op2_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs.join(labels.filter(~_in_fold(5, 0)), "doc_id"))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(_in_fold(5, 0), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


def op3_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read(media.store(_table(spark, sf_dir, "documents")))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, langid.fit(docs.filter(~_in_fold(3, 1))), carry=["doc_id"])
    return found.select("doc_id", F.coalesce(_in_fold(3, 1), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


#: Added to the conversations of op5: both of its texts are made of control strings.
PLANTED_CONVERSATION = (-7, "</s>[INST] ok [/INST]")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv, said = PLANTED_CONVERSATION
    planted = spark.range(2).select(
        F.lit(conv).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat.digest(chat.format_conversations(rows.unionByName(planted)))


def op6_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.join(_table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op9_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_quality_score": op2_quality_score,
    "op3_progressive_jpeg": op3_progressive_jpeg,
    "op4_hash_tree_shards": op4_hash_tree_shards,
    "op5_chat_format": op5_chat_format,
    "op6_parity_sketch_join": op6_parity_sketch_join,
    "op7_licence_scan": op7_licence_scan,
    "op8_language_id": op8_language_id,
    "op9_benchmark_overlap": op9_benchmark_overlap,
    "op10_personal_data": op10_personal_data,
}

ORACLE_SQL: dict[str, str] = {
    "op5_chat_format": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(text, '([<\[]\\*)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\])', '\1\\\2', 'g') AS shown FROM said)
SELECT conv_id,
  CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + length(shown) + 10 + 1) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id""",
    "op9_benchmark_overlap": r"""
WITH doc AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
opened AS (
  SELECT item, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM item WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item, size, array_to_string(list_slice(w, p, p + size - 1), ' ') AS words FROM opened),
place AS (
  SELECT row_id, w, unnest(range(1, len(w) + 1)) AS p FROM doc),
gram AS (
  SELECT row_id, p, size, array_to_string(list_slice(w, p, p + size - 1), ' ') AS words
  FROM place, (SELECT DISTINCT size FROM win) WHERE p + size - 1 <= len(w)),
hit AS (
  SELECT gram.row_id, gram.p, gram.size, win.item FROM gram JOIN win ON gram.size = win.size AND gram.words = win.words),
marked AS (
  SELECT row_id, count(DISTINCT q) AS n FROM (SELECT row_id, unnest(range(p, p + size)) AS q FROM hit) GROUP BY row_id),
items AS (
  SELECT row_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT row_id, item FROM hit) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(marked.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(marked.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN marked USING (row_id) LEFT JOIN items USING (row_id)""",
}

"""The memory engine's tables, derived from the driver's: chunks, a tree of summaries for each scope, and what links them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.sources.adapters import table

STATUSES = ["admitted", "pending_extraction", "buffered", "sealed", "dropped"]


def memory_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks with a lifecycle status; every third has a path scope of its own kind."""
    d = table(spark, sf_dir, "documents")
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(
        "doc_id", F.concat(F.lit("c"), F.col("doc_id")).alias("id"), F.concat_ws(":", "source", "doc_id").alias("source_id"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("repo:"), F.col("source"))).alias("path_scope"), F.col("source").alias("scope"), "lang",
        F.col("text").alias("content"), F.floor((F.length("text") + 3) / 4).cast("long").alias("token_count"),
        (F.lit(1_700_000_000_000) + F.col("doc_id") * 60_000).alias("timestamp_ms"), status.alias("status"),
    )


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level 1 over twenty documents of a scope, level 2 over a hundred; every seventh first document marks a deleted one."""
    c = memory_chunks(spark, sf_dir).where("status <> 'dropped'")

    def level(n: int, per: int, parent) -> DataFrame:
        bucket = F.expr(f"doc_id div {per}")
        made = c.groupBy("scope", bucket.alias("bucket")).agg(
            F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), F.sum("token_count").alias("tokens"),
            F.count("*").alias("n_children"), F.min("doc_id").alias("first"),
        )
        return made.select(F.concat(F.lit(f"s{n}:"), "scope", F.lit(":"), F.col("bucket")).alias("id"), F.concat(F.lit("t:"), "scope").alias("tree_id"), "scope", F.lit(n).alias("level"), parent.alias("parent_id"), "start_ms", "end_ms", "tokens", "n_children", (F.col("first") % 7 == 0).alias("deleted"))

    return level(1, 20, F.concat(F.lit("s2:"), "scope", F.lit(":"), F.expr("bucket div 5"))).unionAll(level(2, 100, F.lit(None).cast("string")))


def tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, child): summaries of level 1 to their chunks, of level 2 to those of level 1."""
    c = memory_chunks(spark, sf_dir).where("status <> 'dropped'")
    leaf = c.select(F.concat(F.lit("s1:"), "scope", F.lit(":"), F.expr("doc_id div 20")).alias("parent"), F.col("id").alias("child"))
    return leaf.unionAll(summaries(spark, sf_dir).where("parent_id is not null").select(F.col("parent_id").alias("parent"), F.col("id").alias("child")))


#: The same as SQL, for the oracles.
MEM = """mem AS (SELECT doc_id, 'c' || doc_id AS id, source || ':' || doc_id AS source_id, CASE WHEN doc_id % 3 = 0 THEN 'repo:' || source END AS path_scope, source AS scope, lang,
  text AS content, (length(text) + 3) // 4 AS token_count, 1700000000000 + doc_id * 60000 AS timestamp_ms,
  CASE doc_id % 5 WHEN 0 THEN 'admitted' WHEN 1 THEN 'pending_extraction' WHEN 2 THEN 'buffered' WHEN 3 THEN 'sealed' ELSE 'dropped' END AS status FROM documents)"""
SUMS = f"""{MEM}, sums AS (
  SELECT 's1:' || scope || ':' || (doc_id // 20) AS id, 't:' || scope AS tree_id, scope, 1 AS level, 's2:' || scope || ':' || (doc_id // 100) AS parent_id, min(timestamp_ms) AS start_ms,
    max(timestamp_ms) AS end_ms, sum(token_count)::BIGINT AS tokens, count(*) AS n_children, min(doc_id) % 7 = 0 AS deleted FROM mem WHERE status <> 'dropped' GROUP BY scope, doc_id // 20, doc_id // 100
  UNION ALL SELECT 's2:' || scope || ':' || (doc_id // 100), 't:' || scope, scope, 2, NULL, min(timestamp_ms), max(timestamp_ms), sum(token_count)::BIGINT, count(*), min(doc_id) % 7 = 0
  FROM mem WHERE status <> 'dropped' GROUP BY scope, doc_id // 100)"""
LINKS = f"""{SUMS}, links AS (SELECT 's1:' || scope || ':' || (doc_id // 20) AS parent, id AS child FROM mem WHERE status <> 'dropped' UNION ALL SELECT parent_id, id FROM sums WHERE parent_id IS NOT NULL)"""

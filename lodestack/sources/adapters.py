"""The driver's tables as the engine's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as single chunks: scope is the source, time one minute a document from a fixed start."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.col("source"), F.lit(":"), F.col("doc_id")).alias("source_id"), F.col("source").alias("scope"), "lang", F.col("text").alias("content"), (F.lit(1_700_000_000_000) + F.col("doc_id") * 60_000).alias("timestamp_ms"))


def occurrences(spark: SparkSession, sf_dir: str, kind: str = "organization") -> DataFrame:
    """(entity, node, ts_ms): suppliers or parts of orders, newest time of each."""
    key = {"organization": "l_suppkey", "product": "l_partkey"}[kind]
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat(F.lit(f"{kind}:"), F.col(key)).alias("entity"), F.col("l_orderkey").alias("node")).agg(F.max(F.unix_millis(F.col("l_shipdate").cast("timestamp"))).alias("ts_ms"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))

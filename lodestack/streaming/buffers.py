"""Streams: event files as a stream, and buffers counted by hour."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.sources.staging import shared_dir


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hour, event_type, n): each micro-batch adds its partial counts; what was written is summed when it is read."""
    place = f"{shared_dir(spark)}/buffers-{uuid.uuid4().hex}"

    def add(batch: DataFrame, epoch: int) -> None:
        # named by batch, so that a batch that is run again replaces what it wrote
        batch.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{place}/batch={epoch}")

    run = event_stream(spark, sf_dir).writeStream.foreachBatch(add).option("checkpointLocation", f"{place}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(place).groupBy(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type").agg(F.sum("n").alias("n"))

"""Structured Streaming: windowed counts of events, and documents that keep a cache table up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text as tx
from sieveline.operators.incremental import CacheTable, stage_key
from sieveline.store import read_table, shared_dir


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    schema = read_table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parq[u]et")


def daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, window_start, n_events, total: all windows after the last batch (complete mode; the state has a row a window)."""
    events = stream_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = events.withWatermark("ts", "1 hour").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    out = f"{shared_dir(spark)}/sieveline-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/result/batch={number}")

    run = counted.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    batches = spark.read.parquet(f"{out}/result")
    last = batches.agg(F.max("batch").alias("last_batch"))
    rows = batches.join(F.broadcast(last), F.col("batch") == F.col("last_batch"), "left_semi")
    return rows.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n_events", F.round("total", 4).alias("total"))


def keep_token_counts(documents: DataFrame, cache: CacheTable, checkpoint: str):
    """A streaming query that adds the token count of each new document content to the cache; known contents are left out."""

    def write(batch: DataFrame, number: int) -> None:
        entries = batch.select(F.lit("token_count").alias("stage"), stage_key("token_count", tx.content_hash(F.col("text"))).alias("key_identity"), tx.token_count(F.col("text")).cast("string").alias("payload"))
        cache.add(entries)

    return documents.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()

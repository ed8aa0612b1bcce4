"""Structured Streaming: running counts, and matching of arriving reads against a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxonflow.operators import seeds


def source(spark: SparkSession, path: str, schema: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    """Rows of each key so far (update or complete mode)."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows of each key by event-time window; rows later than ``late`` are left out once their window is closed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def matched(stream: DataFrame, read_id: str, seq: str, index: DataFrame, k: int = seeds.SEED) -> DataFrame:
    """Seed matches of arriving reads with a static index (append mode; the join keeps no state)."""
    return seeds.seed_matches(seeds.read_kmers(stream, read_id, seq, k), index)


def run_once(result: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Everything that is there now through the stream, into a memory table."""
    q = result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return result.sparkSession.table(name)


def for_each_batch(stream: DataFrame, work, checkpoint: str):
    """Runs ``work(batch, number)`` on every batch, e.g. to recompute abundances from the classes so far."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

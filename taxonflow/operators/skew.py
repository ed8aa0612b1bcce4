"""Per-key results when a few keys hold most rows: value-frequency compression.

Rows are first grouped by (key, value), so a hot key is split over as many reducers as it has values and every
copy of a value is one weighted row. All later steps work on weighted values. Nothing is sampled or capped.

Defined results: a null key is a group of its own; null values count as rows but take no part in sums, distinct
counts, modes and percentiles (these are null, or 0 for counts, where a key has no value); an empty table gives an
empty result; repeated rows count as often as they stand there. Values are numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ratio of the value range that one percentile bucket spans. About 1,100 buckets cover all 64-bit integers.
BUCKET_BASE = 1.08


def compress(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, weight): one row for each distinct value of each key."""
    return df.select(F.col(key).alias("key"), F.col(value).alias("value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("weight"))


def totals(weighted: DataFrame) -> DataFrame:
    """Rows, sum of values, exact distinct values and mode of each key. Ties of the mode go to the smallest value."""
    value, weight = F.col("value"), F.col("weight")
    known = value.isNotNull()
    return weighted.groupBy("key").agg(
        F.sum(weight).alias("n_rows"),
        F.sum(value * weight).alias("value_sum"),
        F.count(value).alias("n_distinct"),
        F.max_by(value, F.when(known, F.struct(weight, -value))).alias("mode"),
    )


def bucket_of(value: Column) -> Column:
    """A bucket number that never falls as the value grows; bounded in number whatever the data."""
    size = F.floor(F.log(F.abs(value.cast("double")) + 1) / F.log(F.lit(BUCKET_BASE)))
    return F.when(value < 0, -size - 1).otherwise(size).cast("int")


def percentiles(weighted: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Exact discrete percentiles: the smallest value at which the cumulated weight reaches share * rows.

    Weights are summed by (key, bucket) first. Only the bucket that holds the wanted rank is ordered value by value,
    so the longest window is the number of buckets or of one bucket's distinct values, never a key's rows.
    """
    known = weighted.where(F.col("value").isNotNull()).withColumn("bucket", bucket_of(F.col("value")))
    buckets = known.groupBy("key", "bucket").agg(F.sum("weight").alias("bucket_weight"))
    ordered = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("key")
    buckets = buckets.withColumn("upto", F.sum("bucket_weight").over(ordered)).withColumn("total", F.sum("bucket_weight").over(whole))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(s)).alias("share")) for n, s in shares.items()]))
    buckets = buckets.withColumn("want", wanted).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("want.share") * F.col("total"))))
    before = F.col("upto") - F.col("bucket_weight")
    holding = buckets.where((before < F.col("rank")) & (F.col("upto") >= F.col("rank"))).select(
        F.col("key").alias("k"), F.col("bucket").alias("b"), F.col("want.name").alias("name"), (F.col("rank") - before).alias("rest")
    )
    inside = Window.partitionBy("key", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    inner = known.withColumn("reached", F.sum("weight").over(inside))
    hit = inner.join(holding, F.col("key").eqNullSafe(F.col("k")) & (F.col("bucket") == F.col("b"))).where(F.col("reached") >= F.col("rest"))
    chosen = hit.groupBy("key", "name").agg(F.min("value").alias("value"))
    return chosen.groupBy("key").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in shares])


def profile(df: DataFrame, key: str, value: str, shares: dict[str, float] | None = None) -> DataFrame:
    """Totals and percentiles of each key."""
    weighted = compress(df, key, value)
    out = totals(weighted)
    if shares:
        p = percentiles(weighted, shares).withColumnRenamed("key", "pk")
        out = out.join(p, F.col("key").eqNullSafe(F.col("pk")), "left").drop("pk")
    return out


def hot_keys(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """(key, n_rows) of the non-null keys that hold at least ``share`` of all rows, the rows of null keys included."""
    per_key = totals(compress(df, key, value)).select("key", "n_rows")
    whole = df.agg(F.count(F.lit(1)).alias("all_rows"))  # one row, read from the files' footers
    return per_key.join(F.broadcast(whole)).where(F.col("key").isNotNull() & (F.col("n_rows") >= F.lit(share) * F.col("all_rows"))).select("key", "n_rows")

"""References to records that do not exist, by table and period, with a skew-aware split.

References are pre-aggregated per key and period. Keys that hold more than a quarter of a task's even share of the rows
are heavy; there can be no more than four times as many as tasks, so they are broadcast, and checked apart from the others:
rows of heavy keys never leave their place. All other keys go through a shuffle. Both parts are united. Rows are never
dropped or capped. Where targets have lifetimes, a heavy key's references and targets are ordered hour by hour.

Defined results: a null key is no reference; a null reference time gives a null month and, where targets have a
lifetime, an orphan (nothing is known to exist then); targets without a start never exist; repeated references each
count; empty tables make every reference an orphan, or give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxonflow.session import cut_lineage, month_of, n_tasks

BLANKS = " \t\r\n\f\v"


def normalised(column: Column) -> Column:
    """Accessions agree apart from case and surrounding blanks."""
    return F.upper(F.btrim(column, F.lit(BLANKS)))


def references(df: DataFrame, key: Column, row_id: str, at: str) -> DataFrame:
    """(key, row_id, at) of the rows that refer to something."""
    return df.select(key.alias("key"), F.col(row_id).alias("row_id"), F.col(at).alias("at")).where(F.col("key").isNotNull())


def per_period(refs: DataFrame) -> DataFrame:
    """References pre-aggregated per key and month."""
    return refs.groupBy("key", month_of("at").alias("ref_month")).agg(F.count(F.lit(1)).alias("n_refs"))


def heavy_keys(refs: DataFrame, tasks: int | None = None) -> DataFrame:
    """(heavy): keys with more than a quarter of a task's even share of the rows, so at most 4 * tasks; written once."""
    tasks = tasks or n_tasks(refs.sparkSession)
    per_key = per_period(refs).groupBy("key").agg(F.sum("n_refs").alias("n"))
    whole = per_key.agg(F.sum("n").alias("all_refs"))
    return cut_lineage(per_key.join(F.broadcast(whole)).where(F.col("n") * (4 * tasks) > F.col("all_refs")).select(F.col("key").alias("heavy")))


def _missing(rows: DataFrame, target_keys: DataFrame, heavy: DataFrame) -> DataFrame:
    """The rows whose key no target has: heavy keys looked up by broadcast, the others by a shuffled anti-join."""
    heavy_ = F.broadcast(heavy)
    is_heavy = F.col("key") == F.col("heavy")
    targets = target_keys.select("key").where(F.col("key").isNotNull())
    present = targets.join(heavy_, is_heavy, "left_semi").distinct().withColumnRenamed("key", "present")
    lost = heavy.join(F.broadcast(present), F.col("heavy") == F.col("present"), "left_anti")
    rest = rows.join(heavy_, is_heavy, "left_anti").join(targets.join(heavy_, is_heavy, "left_anti").distinct(), "key", "left_anti")
    return rest.unionByName(rows.join(F.broadcast(lost), is_heavy, "left_semi"))


def without_target(refs: DataFrame, target_keys: DataFrame, tasks: int | None = None) -> DataFrame:
    """References whose key no target has. ``target_keys`` has one column, key. Columns of ``refs`` are kept."""
    return _missing(refs, target_keys, heavy_keys(refs, tasks))


def orphan_counts(refs: DataFrame, target_keys: DataFrame, tasks: int | None = None) -> DataFrame:
    """(key, ref_month, n_refs) of the orphans, from the pre-aggregated references alone."""
    return _missing(per_period(refs), target_keys, heavy_keys(refs, tasks))


def lifetimes(df: DataFrame, key: Column, start: str, end: str) -> DataFrame:
    """(key, at, delta): +1 where a target begins to exist, -1 where it ends, summed by key and moment."""
    live = df.select(key.alias("key"), F.col(start).alias("s"), F.col(end).alias("e")).where("key is not null and s is not null and (e is null or e > s)")
    moves = live.select("key", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("delta")))).alias("m"))
    return moves.select("key", "m.at", "m.delta").where("at is not null").groupBy("key", "at").agg(F.sum("delta").alias("delta"))


def not_alive(refs: DataFrame, moves: DataFrame, tasks: int | None = None) -> DataFrame:
    """References at a moment at which no target of their key exists. Columns: key, row_id, at.

    References and lifetimes are merged in order of time and the number of living targets is a running sum, so a key's
    references and targets never multiply. A heavy key is cut into hours; what lives when an hour begins comes from the
    sums of the hours before it and stands first in the hour as one more row.
    """
    none = F.lit(None).cast("bigint")
    events = refs.select("key", "at", "row_id", F.lit(0).cast("bigint").alias("delta"), F.lit(1).alias("is_ref")).unionByName(
        moves.select("key", "at", none.alias("row_id"), F.col("delta").cast("bigint").alias("delta"), F.lit(0).alias("is_ref"))
    )
    heavy = F.broadcast(heavy_keys(events.select("key", "at"), tasks))
    sliced = events.join(heavy, F.col("key") == F.col("heavy"), "left").withColumn("hour", F.when(F.col("heavy").isNotNull(), F.date_trunc("hour", "at"))).drop("heavy")
    sums = sliced.where("hour is not null").groupBy("key", "hour").agg(F.sum("delta").alias("delta"))
    before = F.sum("delta").over(Window.partitionBy("key").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("key", F.lit(None).cast("timestamp").alias("at"), none.alias("row_id"), F.coalesce(before, F.lit(0)).alias("delta"), F.lit(0).alias("is_ref"), "hour")
    order = Window.partitionBy("key", "hour").orderBy(F.col("at").asc_nulls_first(), "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    alive = sliced.unionByName(starts.withColumn("at", F.col("at").cast(dict(refs.dtypes)["at"]))).withColumn("alive", F.sum("delta").over(order))
    return alive.where("is_ref = 1 and alive <= 0").select("key", "row_id", "at")


def named(orphans: DataFrame, name: str) -> DataFrame:
    return orphans.select(F.lit(name).alias("ref_name"), month_of("at").alias("ref_month"), F.col("row_id"))

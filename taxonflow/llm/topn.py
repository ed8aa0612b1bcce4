"""Top N items within every group, by two-stage salted ranking.

Each group is split into subgroups by a hash of the item. Within a subgroup every item is reduced to its best score and
the best N are kept; the survivors (at most N * salts for each group) are ranked once more by score and identifier. A
group of any size is thus worked on by ``salts`` tasks: as many as the session has shuffle partitions, ``SALTS`` at least,
so that even a group with a third of all rows gives no task more than about its share. Copies of an item meet in one
subgroup.

Defined results: null scores and null items are ignored; null group keys form groups like any other value; ties go to
the smaller item; repeated rows and an item's lower scores change nothing; extra columns are not carried along; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxonflow.session import n_tasks

SALTS = 16


def top_n(df: DataFrame, group: list[str], item: str, score: str, n: int, salts: int | None = None) -> DataFrame:
    """group columns, item, score, rank (1 = best)."""
    salts = salts or max(SALTS, n_tasks(df.sparkSession))
    keys = [f"_g{i}" for i in range(len(group))]
    rows = df.where(F.col(item).isNotNull() & F.col(score).isNotNull()).select(*[F.col(g).alias(k) for g, k in zip(group, keys)], F.col(item).alias("_item"), F.col(score).alias("_score"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_item"), F.lit(salts)).cast("int"))
    # one exchange on group and salt serves both the reduction to best scores and the first ranking
    spread = salted.repartition(*keys, "_salt")
    best = spread.groupBy(*keys, "_salt", "_item").agg(F.max("_score").alias("_score"))
    order = [F.col("_score").desc(), F.col("_item").asc()]
    first = best.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_r") <= n)
    last = first.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n)
    return last.select(*[F.col(k).alias(g) for g, k in zip(group, keys)], F.col("_item").alias(item), F.col("_score").alias(score), F.col("_rank").alias("rank"))

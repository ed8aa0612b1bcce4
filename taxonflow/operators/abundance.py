"""Abundance by expectation maximisation over read-set equivalence classes, with squared extrapolation.

Reads are first reduced to classes (an aggregate whose size follows the number of distinct taxon sets, not of reads).
Up to ``MOST_ROWS`` class rows the iteration runs on the driver in NumPy; beyond that each step is a DataFrame
aggregate that is written out. Both take the same extrapolated steps to the same tolerance; a result that ends before it
is reached comes with a warning.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxonflow.session import cut_lineage

MOST_ROWS = 1_000_000
#: Stop criterion, most steps, and the length of a taxon without one.
TOLERANCE, STEPS, NO_LENGTH = 1e-10, 10_000, float(2**64 - 1)


def class_rows(classes: DataFrame, resolved: DataFrame, leaves: DataFrame) -> DataFrame:
    """(class, n, leaf): each class's leaves; an ancestor stands for all leaves below it."""
    c = classes.withColumn("class", F.xxhash64("ids")).select("class", "n", F.explode("ids").alias("id"))
    leaf_paths = resolved.join(leaves.select("tid").distinct(), "tid", "left_semi").where("path is not null").select(F.col("tid").alias("leaf"), F.explode("path").alias("id"))
    return c.join(leaf_paths, "id").select("class", "n", "leaf").distinct()


def em_step(rows: DataFrame, p: DataFrame, lengths: DataFrame) -> DataFrame:
    """One step: counts are shared out in proportion to p, divided by genome length and normalised. (leaf, p)"""
    j = rows.join(p, "leaf")
    total = j.groupBy("class").agg(F.sum("p").alias("class_p"))
    share = j.join(total, "class").where("class_p > 0").select("leaf", (F.col("n") * F.col("p") / F.col("class_p")).alias("reads"))
    per = share.groupBy("leaf").agg(F.sum("reads").alias("reads")).join(lengths, "leaf", "left").select("leaf", (F.col("reads") / F.coalesce(F.col("size").cast("double"), F.lit(NO_LENGTH))).alias("d"))
    whole = per.agg(F.sum("d").alias("w"))
    return per.join(F.broadcast(whole)).select("leaf", (F.col("d") / F.col("w")).alias("p"))


def start(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Counts shared out evenly over a class's leaves, by length, normalised."""
    m = rows.groupBy("class").agg(F.count(F.lit(1)).alias("m"))
    per = rows.join(m, "class").groupBy("leaf").agg(F.sum(F.col("n") / F.col("m")).alias("reads"))
    per = per.join(lengths, "leaf", "left").select("leaf", (F.col("reads") / F.coalesce(F.col("size").cast("double"), F.lit(NO_LENGTH))).alias("d"))
    whole = per.agg(F.sum("d").alias("w"))
    return per.join(F.broadcast(whole)).select("leaf", (F.col("d") / F.col("w")).alias("p"))


def solve(cls: np.ndarray, n: np.ndarray, leaf: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, int]:
    """Abundances of leaves 0..len(size)-1 from rows (class number, class count, leaf number)."""
    counts = np.zeros(int(cls.max()) + 1)
    counts[cls] = n
    m = np.bincount(cls)

    def normal(x: np.ndarray) -> np.ndarray:
        x = x / size
        return x / x.sum()

    def step(p: np.ndarray) -> np.ndarray:
        of = np.bincount(cls, weights=p[leaf], minlength=len(counts))
        share = np.divide(counts, of, out=np.zeros_like(of), where=of > 0)
        return normal(np.bincount(leaf, weights=share[cls] * p[leaf], minlength=len(size)))

    p = normal(np.bincount(leaf, weights=(counts / np.maximum(m, 1))[cls], minlength=len(size)))
    for i in range(1, STEPS + 1):
        p1 = step(p)
        p2 = step(p1)
        r, v = p1 - p, (p2 - p1) - (p1 - p)
        norm = float((v * v).sum())
        if norm > 0:
            g = -np.sqrt(float((r * r).sum()) / norm)
            ahead = np.maximum(0.0, p - 2 * g * r + g * g * v)
            new = step(ahead) if ahead.sum() > 0 else p2
        else:
            new = p2
        if np.abs(new - p).sum() < TOLERANCE:
            return new, i
        p = new
    _open_end(STEPS)
    return p, STEPS


def _open_end(steps: int) -> None:
    warnings.warn(f"abundances did not converge to {TOLERANCE} in {steps} steps", RuntimeWarning, stacklevel=3)


def extrapolated(p: DataFrame, p1: DataFrame, p2: DataFrame) -> DataFrame:
    """The start of the third step of a round, as ``solve`` takes it: p, p1 and p2 carried on along their curve. (leaf, p)"""
    named = lambda x, c: x.select("leaf", F.col("p").alias(c))
    j = named(p, "a").join(named(p1, "b"), "leaf", "left").join(named(p2, "c"), "leaf", "left").na.fill(0.0, ["b", "c"])
    r, v = F.col("b") - F.col("a"), F.col("c") - 2 * F.col("b") + F.col("a")
    rr, vv = j.agg(F.sum(r * r), F.sum(v * v)).first()
    if not vv:
        return p2
    g = -float(np.sqrt(rr / vv))
    ahead = j.select("leaf", F.greatest(F.lit(0.0), F.col("a") - 2 * g * r + g * g * v).alias("p"))
    return ahead if ahead.agg(F.sum("p")).first()[0] > 0 else p2


def abundances(rows: DataFrame, lengths: DataFrame, steps_beyond: int = STEPS) -> DataFrame:
    """(tid, abundance, read_share): normalised by genome length, and not."""
    rows = cut_lineage(rows)
    n = rows.count()
    spark = rows.sparkSession
    if n == 0:
        return spark.createDataFrame([], "tid long, abundance double, read_share double")
    if n <= MOST_ROWS:
        got = rows.join(lengths, "leaf", "left").toPandas()
        cls = np.unique(got["class"].to_numpy(), return_inverse=True)[1]
        leaves, leaf = np.unique(got["leaf"].to_numpy(), return_inverse=True)
        size = np.full(len(leaves), NO_LENGTH)
        known = got["size"].notna().to_numpy()
        size[leaf[known]] = got["size"].to_numpy(dtype=float)[known]
        p, _ = solve(cls, got["n"].to_numpy(dtype=float), leaf, size)
        reads = p * size / (p * size).sum()
        return spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(leaves, p, reads)], "tid long, abundance double, read_share double")
    p = cut_lineage(start(rows, lengths))
    for _ in range(steps_beyond):
        p1 = cut_lineage(em_step(rows, p, lengths))  # each step reads the last one several times
        p2 = cut_lineage(em_step(rows, p1, lengths))
        ahead = extrapolated(p, p1, p2)
        new = p2 if ahead is p2 else cut_lineage(em_step(rows, ahead, lengths))
        gap = new.join(p.withColumnRenamed("p", "q"), "leaf", "full").agg(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))))).first()[0]
        p = new
        if gap < TOLERANCE:
            break
    else:
        _open_end(steps_beyond)
    w = p.join(lengths, "leaf", "left").withColumn("r", F.col("p") * F.coalesce(F.col("size").cast("double"), F.lit(NO_LENGTH)))
    whole = w.agg(F.sum("r").alias("w"))
    return w.join(F.broadcast(whole)).select(F.col("leaf").alias("tid"), F.col("p").alias("abundance"), (F.col("r") / F.col("w")).alias("read_share"))

"""Per-taxon report, clade report, score report and accuracy figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxonflow.functions import dna


def taxon_report(counts: DataFrame, lines: DataFrame, sizes: DataFrame, abundance: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """name, taxID, taxRank, genomeSize, numReads, numUniqueReads, abundance; taxon 0 left out.

    A missing name is the id, a missing abundance or size 0; a leaf of unknown rank has rank 'leaf'.
    """
    out = counts.where("tid <> 0").join(lines.select("tid", "tax_rank", "leaf"), "tid", "left").join(sizes, "tid", "left")
    out = out.join(abundance.select("tid", "abundance"), "tid", "left") if abundance is not None else out.withColumn("abundance", F.lit(0.0))
    out = out.join(names, "tid", "left") if names is not None else out.withColumn("name", F.lit(None).cast("string"))
    rank = F.when((F.coalesce("tax_rank", F.lit("no rank")) == "no rank") & F.col("leaf"), "leaf").otherwise(F.coalesce("tax_rank", F.lit("no rank")))
    return out.select(
        F.coalesce("name", dna.taxid_text(F.col("tid"))).alias("name"), F.col("tid").alias("taxID"), rank.alias("taxRank"), F.coalesce("size", F.lit(0)).alias("genomeSize"),
        F.col("n_reads").alias("numReads"), F.col("n_unique_reads").alias("numUniqueReads"), F.coalesce("abundance", F.lit(0.0)).alias("abundance"),
    )


def with_sequence_id(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows`` (tid, uid) with seqID: the sequence's name for leaves and taxa outside the tree, the rank for others and
    for a leaf without sequence, 'unclassified' for taxon 0."""
    known = lines.select(F.col("tid").alias("_t"), F.col("tax_rank").alias("_rank"), F.col("leaf").alias("_leaf"))
    j = rows.join(known, F.col("tid") == F.col("_t"), "left")
    rank = F.coalesce("_rank", F.lit("no rank"))
    shown = F.when(F.col("tid") == 0, "unclassified").when(F.coalesce("_leaf", F.lit(True)), F.coalesce("uid", rank)).otherwise(rank)
    return j.withColumn("seqID", shown).drop("_t", "_rank", "_leaf")


def clade_report(clades: DataFrame, lines: DataFrame, resolved: DataFrame, show_zeros: bool = False) -> DataFrame:
    """pct, clade, own, rank_code, tid, label, sort_key: the tree report in rows; order by sort_key prints it depth first,
    larger clades first and smaller ids first among equal ones."""
    total = clades.where("n_total is not null").select("n_total").limit(1) if "n_total" in clades.columns else None
    base = resolved.where("path is not null").select("tid", "depth", "path").join(clades, "tid", "left" if show_zeros else "inner").join(lines.select("tid", "tax_rank"), "tid", "left")
    base = base.na.fill(0, ["clade", "own"])
    up = base.select(F.col("tid").alias("a"), F.format_string("%019d:%020d", F.lit(2**62) - F.col("clade"), F.col("tid")).alias("k"))
    steps = base.select("tid", F.posexplode("path").alias("i", "a")).join(up, "a").groupBy("tid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "k"))), lambda s: s["k"]), "/").alias("sort_key"))
    out = base.join(steps, "tid")
    whole = clades.agg(F.sum("own").alias("whole")) if total is None else total.withColumnRenamed("n_total", "whole")
    return out.join(F.broadcast(whole)).select(
        F.round(100 * F.col("clade") / F.col("whole"), 2).alias("pct"), "clade", "own", dna.rank_code(F.col("tax_rank")).alias("rank_code"), "tid",
        F.concat(F.expr("repeat('  ', cast(depth as int))"), dna.taxid_text(F.col("tid"))).alias("label"), "sort_key",
    )


def from_count_table(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((tid, n), (n_total)) of a count table (tid, count, place): the last line of a taxon counts, the total is that of
    all lines."""
    last = counts.where("tid is not null").groupBy("tid").agg(F.max_by("count", "place").alias("n"))
    return last, counts.where("tid is not null").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_total"))


def filtered(rows: DataFrame, min_score: int = 0, min_length: float = 0) -> DataFrame:
    """Assignment rows that reach a score and a hit length."""
    return rows.where((F.col("score") >= min_score) & (F.col("hit_len") >= min_length))


def score_report(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(tid, score, per_base): summed score, and divided by the genome's length."""
    s = rows.groupBy("tid").agg(F.sum("score").alias("score"))
    return s.join(sizes, "tid", "left").select("tid", "score", (F.col("score") / F.col("size")).alias("per_base"))


def accuracy(assigned: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """n_reads, n_classified, n_right, n_unique_right, sensitivity, precision; both sides have tid (0: none)."""
    a = assigned.where("tid <> 0").join(truth.select(*by, F.col("tid").alias("true_tid")), by)
    per = a.groupBy(*by).agg(F.max(F.col("tid") == F.col("true_tid")).alias("hit"), F.count(F.lit(1)).alias("n"))
    got = per.agg(F.count(F.lit(1)).alias("n_classified"), F.sum(F.col("hit").cast("long")).alias("n_right"), F.sum((F.col("hit") & (F.col("n") == 1)).cast("long")).alias("n_unique_right"))
    whole = truth.select(*by).distinct().agg(F.count(F.lit(1)).alias("n_reads"))
    return whole.join(F.broadcast(got)).select("*", (F.col("n_right") / F.col("n_reads")).alias("sensitivity"), (F.col("n_right") / F.col("n_classified")).alias("precision"))


def squared_residuals(calc: DataFrame, truth: DataFrame) -> DataFrame:
    """ssr of two (tid, x) tables; a taxon missing on the calculated side is 0."""
    j = truth.select("tid", F.col("x").alias("t")).join(calc.select("tid", F.col("x").alias("c")), "tid", "left")
    return j.agg(F.sum(F.pow(F.col("t") - F.coalesce("c", F.lit(0.0)), F.lit(2.0))).alias("ssr"), F.count(F.lit(1)).alias("n_taxa"))


def correlations(pairs: DataFrame, by: str) -> DataFrame:
    """(by, pearson, spearman, n) of columns a and b. Ranks are averages over ties, built from counts of equal values."""

    def ranks(col: str) -> DataFrame:
        counts = pairs.groupBy(by, col).agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy(by).orderBy(col).rowsBetween(Window.unboundedPreceding, 0))
        return counts.select(F.col(by).alias("g"), F.col(col).alias("v"), (upto - (F.col("c") - 1) / 2).alias(f"r_{col}"))

    x = pairs
    for col in ("a", "b"):
        r = ranks(col)
        x = x.join(r, (F.col(by) == F.col("g")) & (F.col(col) == F.col("v"))).drop("g", "v")
    return x.groupBy(by).agg(F.corr("a", "b").alias("pearson"), F.corr("r_a", "r_b").alias("spearman"), F.count(F.lit(1)).alias("n"))


def kendall(pairs: DataFrame, by: str) -> DataFrame:
    """(by, tau_b) of columns a and b; null where either has no two different values or a group is a single pair.

    Discordant pairs are the inversions of b in the order of a, counted by merging in n log n steps; a group (the taxa of
    one rank) is worked on by one task.
    """
    import numpy as np
    import pandas as pd

    def tied(*columns: np.ndarray) -> int:
        return sum(int(c) * (int(c) - 1) // 2 for c in np.unique(np.stack(columns, 1), axis=0, return_counts=True)[1])

    def inversions(x: np.ndarray) -> int:
        """Pairs i < j with x[i] > x[j]."""
        rank = np.unique(x, return_inverse=True)[1]
        n, out, width = len(rank), 0, 1
        while width < n:
            for lo in range(0, n, 2 * width):
                left, right = rank[lo : lo + width], rank[lo + width : lo + 2 * width]
                if len(right):
                    out += int((len(left) - np.searchsorted(left, right, side="right")).sum())
                    rank[lo : lo + 2 * width] = np.sort(rank[lo : lo + 2 * width], kind="stable")
            width *= 2
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf.a.to_numpy(float), pdf.b.to_numpy(float)
        n, order = len(a), np.lexsort((b, a))
        whole, ta, tb = n * (n - 1) // 2, tied(a), tied(b)
        s = whole - ta - tb + tied(a, b) - 2 * inversions(b[order])
        root = float(whole - ta) * float(whole - tb)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "tau_b": [s / np.sqrt(root) if root else None]})

    kind = dict(pairs.dtypes)[by]
    return pairs.groupBy(by).applyInPandas(run, f"{by} {kind}, tau_b double")

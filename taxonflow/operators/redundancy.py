"""Redundancy between the genomes of a species: similar pairs from sampled k-mers, and what a genome adds to another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxonflow.functions import dna


def similar_pairs(refs: DataFrame, k: int = 31, one_in: int = 1, by: str | None = None) -> DataFrame:
    """(a, b, n): genomes a < b with n shared distinct (sampled) k-mers, within the groups of ``by`` if it is given.

    The sample takes k-mers whose hash is divisible by ``one_in``.
    """
    cols = ["ref_id", *([by] if by else [])]
    k_ = dna.kmers(refs, "ref_id", "bases", k).select("kmer", F.col("ident").alias("ref_id")).where(F.pmod(F.xxhash64("kmer"), F.lit(one_in)) == 0).distinct()
    if by:
        k_ = k_.join(refs.select(*cols), "ref_id").where(F.col(by).isNotNull())
    # k-mers of one region stand in the same genomes: they are counted by their genome set first, so a pair is made once for
    # each set (every such pair is a row of the result) and not once for each k-mer
    sets = k_.groupBy("kmer", *([by] if by else [])).agg(F.sort_array(F.collect_list("ref_id")).alias("s")).where(F.size("s") > 1).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    first = sets.select("s", "n", F.posexplode("s").alias("i", "a"))
    pairs = first.where(F.col("i") + 1 < F.size("s")).select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"), "n")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def merge_order(pairs: DataFrame, lengths: DataFrame, least_share: float = 0.01) -> list[tuple[int, int, int]]:
    """Greedy agglomeration of one species' genomes on its pair table: the most similar pair first, until nothing is shared
    or less than ``least_share`` of the first maximum, or a genome is shorter than that share of the longest.

    The pair table of one species is the driver's input here, not the k-mers.
    """
    size = {r[0]: r[1] for r in lengths.select("ref_id", "length").collect()}
    table = {(r[0], r[1]): r[2] for r in pairs.select("a", "b", "n").collect()}
    out, first = [], None
    longest = max(size.values(), default=0)
    while table:
        (a, b), n = max(table.items(), key=lambda x: (x[1], -x[0][0], -x[0][1]))
        first = first or n
        if n == 0 or n < least_share * first or min(size.get(a, 0), size.get(b, 0)) < least_share * longest:
            break
        out.append((a, b, n))
        size[a] = size.get(a, 0) + size.pop(b, 0)
        merged = {}
        for (x, y), c in table.items():
            x, y = (a if x == b else x), (a if y == b else y)
            if x != y:
                key = (min(x, y), max(x, y))
                merged[key] = merged.get(key, 0) + c
        table = merged
    return out


def covered(refs: DataFrame, k: int = 31) -> DataFrame:
    """(ref_id, start, stop): runs of letters covered by k-mers that stand in another genome too."""
    k_ = dna.kmers(refs, "ref_id", "bases", k).select("kmer", F.col("ident").alias("ref_id"), "pos")
    shared = k_.groupBy("kmer").agg(F.min("ref_id").alias("a"), F.max("ref_id").alias("b")).where("a <> b").select("kmer")
    at = k_.join(shared, "kmer", "left_semi").select("ref_id", "pos").distinct()
    w = Window.partitionBy("ref_id").orderBy("pos")
    fresh = F.when(F.col("pos") - F.lag("pos").over(w) <= k, 0).otherwise(1)
    run = at.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("ref_id", "run").agg(F.min("pos").alias("start"), (F.max("pos") + k).alias("stop")).select("ref_id", "start", "stop")


def nonshared(refs: DataFrame, k: int = 31, least: int = 1) -> DataFrame:
    """(ref_id, start, length): the parts of each genome that no other genome has, of at least ``least`` letters."""
    c = covered(refs, k)
    ends = refs.select("ref_id", F.length("bases").cast("bigint").alias("start"), F.length("bases").cast("bigint").alias("stop"))
    w = Window.partitionBy("ref_id").orderBy("start", "stop")
    gaps = c.unionByName(ends).withColumn("from", F.coalesce(F.lag("stop").over(w), F.lit(0)))
    return gaps.select("ref_id", F.col("from").alias("start"), (F.col("start") - F.col("from")).alias("length")).where(F.col("length") >= least)


def species_groups(refs: DataFrame, species: DataFrame, most: int = 50_000_000) -> DataFrame:
    """(species, header, n_genomes, mean_size, longest, is_large): the genomes of each species; ``species`` is (tid, promoted).

    ``is_large`` marks species whose mean genome exceeds ``most`` letters; they are left out of compression.
    """
    g = refs.where("tid is not null").join(species, "tid", "left").select(F.coalesce("promoted", "tid").alias("species"), F.length("bases").cast("bigint").alias("n"))
    per = g.groupBy("species").agg(F.count(F.lit(1)).alias("n_genomes"), F.expr("sum(n) div count(*)").alias("mean_size"), F.max("n").alias("longest"))
    return per.select("species", F.concat(F.lit("cid|"), dna.taxid_text(F.col("species"))).alias("header"), "n_genomes", "mean_size", "longest", (F.col("mean_size") > most).alias("is_large"))


def complexity(seq, window: int = 3):
    """Share of distinct triplets among a sequence's triplets: low for simple repeats."""
    n = F.length(seq) - window + 1
    triplets = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(seq, i, F.lit(window)))
    return F.when(n > 0, F.size(F.array_distinct(triplets)) / F.least(n, F.lit(4**window))).otherwise(0.0)

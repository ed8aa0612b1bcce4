"""Taxonomy tables on top of resolved hierarchies: closure, canonical paths, common ancestors, promotion, sizes.

``resolved`` is the output of ``hierarchy.resolve``: tid, root, depth, path (root to node), cycle_tid. Nodes on or
leading into a cycle have no path and are treated as unknown. A tid that is not in the tree stands for the root ROOT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxonflow.functions import dna
from taxonflow.operators import hierarchy
from taxonflow.session import cut_lineage

ROOT = 1


def lines(nodes: DataFrame) -> DataFrame:
    """The valid line of each taxon, with normalised rank."""
    return hierarchy.valid_lines(nodes).withColumn("tax_rank", dna.rank_name(F.col("tax_rank")))


def tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with normalised rank, resolved hierarchy) of a nodes table; both written once."""
    known = cut_lineage(lines(nodes))
    return known, cut_lineage(hierarchy.resolve(hierarchy.links(known)))


def closure(resolved: DataFrame) -> DataFrame:
    """(tid, anc_tid, distance), each node being its own ancestor at distance 0."""
    return hierarchy.descendants(resolved).select("tid", "anc_tid", "distance")


def descendants_of(resolved: DataFrame, tids: list[int]) -> DataFrame:
    """(tid): the given nodes and everything below them; given ids outside the tree are kept."""
    below = resolved.where(F.arrays_overlap("path", F.array(*[F.lit(int(t)) for t in tids]))).select("tid")
    given = resolved.sparkSession.createDataFrame([(int(t),) for t in tids], "tid long")
    return below.unionByName(given).distinct()


def canonical_paths(lines: DataFrame, resolved: DataFrame) -> DataFrame:
    """(tid, slots): ten slots, 0 where missing. The lowest node of a rank wins; a node of unknown rank is its own slot 0."""
    ranked = lines.select(F.col("tid").alias("anc_tid"), dna.slot(F.col("tax_rank")).alias("slot"))
    up = closure(resolved).join(ranked, "anc_tid")
    first = F.when((F.col("distance") == 0) & F.col("slot").isNull(), 0).otherwise(F.col("slot"))
    per = up.withColumn("slot", first).where("slot is not null").groupBy("tid", "slot").agg(F.min_by("anc_tid", "distance").alias("anc"))
    slots = F.array(*[F.coalesce(F.max(F.when(F.col("slot") == s, F.col("anc"))), F.lit(0)) for s in range(dna.SLOT_COUNT)])
    found = per.groupBy("tid").agg(slots.alias("slots"))
    none = F.array(*[F.lit(0).cast("long")] * dna.SLOT_COUNT)
    return resolved.where("path is not null").select("tid").join(found, "tid", "left").select("tid", F.coalesce("slots", none).alias("slots"))


def ancestor_at(paths: DataFrame, slot: int) -> DataFrame:
    """(tid, anc_tid): the ancestor in a canonical slot, 0 if there is none."""
    return paths.select("tid", F.element_at("slots", slot + 1).alias("anc_tid"))


def key_at_rank(paths: DataFrame, rank: str) -> DataFrame:
    """(tid, key): the accumulation key of a classification rank, the first filled slot from the rank's own upward."""
    if rank not in dna.SLOTS:
        raise ValueError(f"unknown classification rank {rank}; known: {', '.join(dna.SLOTS)}")
    up = F.filter(F.slice("slots", dna.SLOTS[rank] + 1, dna.SLOT_COUNT), lambda x: x != 0)
    return paths.select("tid", F.coalesce(F.get(up, F.lit(0)), F.col("tid")).alias("key"))


def pruned(lines: DataFrame, resolved: DataFrame, referenced: DataFrame) -> DataFrame:
    """The lines of all referenced tids and of their ancestors."""
    kept = resolved.join(referenced.select("tid").distinct(), "tid", "left_semi").select(F.explode("path").alias("tid")).distinct()
    return lines.join(kept, "tid", "left_semi")


def with_leaf(lines: DataFrame, referenced: DataFrame) -> DataFrame:
    """A node is a leaf exactly if a sequence maps to it."""
    r = referenced.select(F.col("tid").alias("r")).where("r is not null").distinct()
    return lines.drop("leaf").join(r, F.col("tid") == F.col("r"), "left").withColumn("leaf", F.col("r").isNotNull()).drop("r")


def with_path(rows: DataFrame, tid: str, resolved: DataFrame) -> DataFrame:
    """Adds ``path``; tids outside the tree get the root alone."""
    p = resolved.where("path is not null").select(F.col("tid").alias("_t"), F.col("path"))
    return rows.join(p, F.col(tid) == F.col("_t"), "left").drop("_t").withColumn("path", F.coalesce("path", F.array(F.lit(ROOT).cast("long"))))


def common_ancestors(rows: DataFrame, by: list[str], tid: str, resolved: DataFrame) -> DataFrame:
    """(by, lca) of each group's taxa; 0 and null are neutral. The common prefix of a set of paths is that of the smallest and
    the largest path in array order, so groups of any size need only partial minima and maxima."""
    paths = with_path(rows.where(F.col(tid).isNotNull() & (F.col(tid) != 0)), tid, resolved)
    ends = paths.groupBy(*by).agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    n = F.least(F.size("lo"), F.size("hi"))
    same = F.filter(F.sequence(F.lit(1), n), lambda i: F.slice(F.col("lo"), 1, i) == F.slice(F.col("hi"), 1, i))
    deepest = F.coalesce(F.array_max(same), F.lit(0))
    return ends.select(*by, F.when(deepest > 0, F.element_at("lo", F.greatest(deepest, F.lit(1)))).otherwise(F.lit(ROOT).cast("long")).alias("lca"))


def promotion(lines: DataFrame, resolved: DataFrame, rank: str) -> DataFrame:
    """(tid, promoted): the first ancestor of the rank, the node itself if there is none."""
    of_rank = lines.where(F.col("tax_rank") == rank).select(F.col("tid").alias("anc_tid"))
    hit = closure(resolved).join(of_rank, "anc_tid").groupBy("tid").agg(F.min_by("anc_tid", "distance").alias("up"))
    return lines.select("tid").join(hit, "tid", "left").select("tid", F.coalesce("up", "tid").alias("promoted"))


def mean_sizes(lines: DataFrame, resolved: DataFrame, sizes: DataFrame) -> DataFrame:
    """(tid, size): own size for taxa below species; for species to phylum the integer mean over the sized taxa below
    species rank (or unranked ones) under them, which overwrites an own size."""
    s = dna.slot(F.col("tax_rank"))
    ranked = lines.select("tid", s.alias("slot"))
    low = sizes.join(ranked, "tid", "left").where("slot is null or slot = 0").select("tid", "size")
    up = closure(resolved).join(low, "tid").join(ranked.select(F.col("tid").alias("anc_tid"), F.col("slot").alias("anc_slot")), "anc_tid")
    mean = up.where("anc_slot between 1 and 6").groupBy(F.col("anc_tid").alias("tid")).agg(F.expr("sum(size) div count(*)").alias("mean_size"))
    own = sizes.select("tid", F.col("size").alias("own"))
    return own.join(mean, "tid", "full").select("tid", F.coalesce("mean_size", "own").alias("size"))


def clade_counts(own: DataFrame, resolved: DataFrame) -> DataFrame:
    """(tid, clade, own): counts of each node and everything below it; ``own`` has tid and n. Unknown taxa count at ROOT."""
    at = with_path(own.groupBy("tid").agg(F.sum("n").alias("n")), "tid", resolved)
    flat = at.select(F.explode("path").alias("anc"), "n", (F.element_at("path", -1)).alias("node"))
    return flat.groupBy(F.col("anc").alias("tid")).agg(F.sum("n").alias("clade"), F.sum(F.when(F.col("node") == F.col("anc"), F.col("n")).otherwise(0)).alias("own"))

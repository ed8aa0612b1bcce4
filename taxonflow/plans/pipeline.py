"""From read files and reference files to the assignment table and the reports.

    index = pipeline.build(sequences, nodes, names)
    rows = pipeline.assignments(readers.read(spark, path, "fasta"), index)
    pipeline.taxon_report(rows, index)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxonflow.functions import dna
from taxonflow.operators import assign, exact, filters, report, taxonomy
from taxonflow.operators import index as index_
from taxonflow.session import cut_lineage


@dataclass
class Index:
    """Reference tables: refs (ref_id, uid, tid, bases), lines and resolved hierarchy, paths, sizes, names or None."""

    refs: DataFrame
    lines: DataFrame
    resolved: DataFrame
    paths: DataFrame
    sizes: DataFrame
    names: DataFrame | None = None


def sequences(fasta: DataFrame, conversion: DataFrame) -> DataFrame:
    """(ref_id, uid, tid, bases) of FASTA records (rdid, name, seq) and the taxa of their names; unknown ones have tid 0."""
    named = fasta.select(F.col("rdid").alias("ref_id"), dna.header_uid(F.col("name")).alias("uid"), F.upper("seq").alias("bases")).where("bases <> ''")
    first_word = F.regexp_extract("uid", r"^([^|]*)", 1)
    own = named.join(conversion, "uid", "left").withColumn("_word", first_word)
    short = conversion.select(F.col("uid").alias("_word"), F.col("tid").alias("_tid"))
    return own.join(short, "_word", "left").select("ref_id", "uid", F.coalesce("tid", "_tid", F.lit(0)).alias("tid"), "bases")


def build(refs: DataFrame, nodes: DataFrame, names: DataFrame | None = None, size_table: DataFrame | None = None) -> Index:
    """The index of (ref_id, uid, tid, bases) and a nodes table (line_no, tid, parent_tid, tax_rank, leaf); taxa of sequences
    are the leaves, other branches are left out; sizes of the size table take the place of computed ones."""
    refs = cut_lineage(refs)
    lines, resolved = taxonomy.tree(nodes)
    kept = cut_lineage(taxonomy.with_leaf(taxonomy.pruned(lines, resolved, refs), refs))
    resolved = cut_lineage(resolved.join(kept.select("tid"), "tid", "left_semi"))
    sizes = taxonomy.mean_sizes(kept, resolved, index_.sizes(refs))
    if size_table is not None:
        sizes = index_.sizes_with(sizes, size_table)
    return Index(refs, kept, resolved, cut_lineage(taxonomy.canonical_paths(kept, resolved)), cut_lineage(sizes), names)


def assignments(reads: DataFrame, index: Index, k: int = 5, least: int = 22, host: list[int] | None = None, exclude: list[int] | None = None, traverse: bool = True, seed: int = 0, **filter_options) -> DataFrame:
    """(sample_id, read_no, readID, seqID, taxID, score, 2ndBestScore, hitLength, queryLength, numMatches, max_score).

    ``reads`` has rdid, name, seq and what else the readers give (seq2, filter, file_idx). Every read has a row.
    """
    reads = reads.withColumn("sample_id", F.col("file_idx").cast("long") if "file_idx" in reads.columns else F.lit(0).cast("long")).withColumnRenamed("rdid", "read_no")
    kept = cut_lineage(filters.usable(reads, **filter_options))
    bits = 40  # read numbers of one file
    out_of = [r[0] for r in taxonomy.descendants_of(index.resolved, exclude).collect()] if exclude else None  # the taxa of the call
    got = exact.classify(kept.withColumn("read_id", F.shiftleft("sample_id", bits) + F.col("read_no")), index.refs, least, k, out_of)
    entries = cut_lineage(got.select(F.shiftright("read_id", bits).alias("sample_id"), F.col("read_id").bitwiseAND((1 << bits) - 1).alias("read_no"), F.col("ref_id").alias("unique_id"), F.coalesce("tid", F.lit(0)).alias("tid"), "score", F.col("hit_len").cast("double").alias("hit_len"), F.col("max_score")))
    most = entries.groupBy(*assign.READ).agg(F.max("max_score").alias("max_score"))
    hosts = taxonomy.descendants_of(index.resolved, host) if host else None
    a = assign.selected(entries.drop("max_score"), k, index.paths, hosts, traverse, seed)
    names = index.refs.select(F.col("ref_id").alias("unique_id"), "uid")
    named = report.with_sequence_id(a.join(names, "unique_id", "left"), index.lines)
    mates = ["seq", *(["seq2"] if "seq2" in reads.columns else [])]
    length = sum((F.coalesce(F.length(c), F.lit(0)) for c in mates), F.lit(0))
    base = reads.select(*assign.READ, dna.read_name(F.col("name")).alias("readID"), length.alias("queryLength"))
    zero = F.lit(0).cast("long")
    j = base.join(named, assign.READ, "left").join(most, assign.READ, "left")
    return j.select(
        *assign.READ, "readID", F.coalesce("seqID", F.lit("unclassified")).alias("seqID"), F.coalesce("tid", zero).alias("taxID"), F.coalesce("score", zero).alias("score"),
        F.coalesce("second", zero).alias("2ndBestScore"), F.coalesce("hit_len", F.lit(0.0)).cast("long").alias("hitLength"), "queryLength", F.coalesce("n_matches", F.lit(1)).alias("numMatches"), F.coalesce("max_score", zero).alias("max_score"),
    )


def classes(rows: DataFrame) -> DataFrame:
    """(ids, n) of the reads that match from end to end."""
    full = rows.where("score >= max_score and taxID <> 0").withColumnRenamed("taxID", "tid")
    return assign.equivalence_classes(full)


def taxon_report(rows: DataFrame, index: Index) -> DataFrame:
    """The per-taxon report with abundances."""
    from taxonflow.operators import abundance

    a = rows.select(F.col("taxID").alias("tid"), F.col("numMatches").alias("n_matches"), F.col("hitLength").alias("hit_len"))
    leaves = index.lines.where("leaf").select("tid")
    shares = abundance.abundances(abundance.class_rows(classes(rows), index.resolved, leaves), index.sizes.withColumnRenamed("tid", "leaf"))
    return report.taxon_report(assign.taxon_counts(a), index.lines, index.sizes, shares, index.names)


def tree_report(rows: DataFrame, index: Index) -> DataFrame:
    """The tree report of the reads' lowest common ancestors."""
    lca = taxonomy.common_ancestors(rows, assign.READ, "taxID", index.resolved)
    counts = lca.groupBy(F.col("lca").alias("tid")).agg(F.count(F.lit(1)).alias("n"))
    return report.clade_report(cut_lineage(taxonomy.clade_counts(counts, index.resolved)), index.lines, index.resolved)

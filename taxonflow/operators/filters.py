"""Read filters before classification: ambiguous letters, length and the sequencer's own flag, for reads and pairs.

Defined results: a missing mate passes nothing and is not looked at; a pair of which one mate fails is classified by the
other alone; a read of which nothing passes keeps its row with null sequences, so that it comes out unclassified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxonflow.functions import dna

LEAST_LENGTH = 2  #: fixed value: shorter reads are not classified


def n_filter_pair(seq: Column, seq2: Column, together: bool = False, **bound) -> tuple[Column, Column]:
    """Whether each mate's ambiguous letters stay within the bound of its own length, or both within that of both lengths."""
    if not together:
        return dna.passes_n_filter(seq, **bound), dna.passes_n_filter(seq2, **bound)
    both = dna.passes_n_filter(F.concat(seq, seq2), **bound)
    return F.coalesce(both, dna.passes_n_filter(seq, **bound)), F.coalesce(both, dna.passes_n_filter(seq2, **bound))


def length_filter(seq: Column, seed_mismatches: int = 0) -> Column:
    return F.length(seq) >= max(LEAST_LENGTH, seed_mismatches + 1)


def qc_filter(flag: Column) -> Column:
    """A record without flag passes."""
    return F.coalesce(flag != "0", F.lit(True))


def marked(reads: DataFrame, qc: bool = False, together: bool = False) -> DataFrame:
    """``reads`` with passes and passes2; columns seq2, filter and filter2 are used where they are there."""
    none = F.lit(None).cast("string")
    of = lambda c: F.col(c) if c in reads.columns else none
    one, two = n_filter_pair(F.col("seq"), of("seq2"), together)
    good = lambda n, seq, flag: F.coalesce(n & length_filter(seq) & (qc_filter(flag) if qc else F.lit(True)), F.lit(False))
    return reads.withColumn("passes", good(one, F.col("seq"), of("filter"))).withColumn("passes2", good(two, of("seq2"), of("filter2")))


def usable(reads: DataFrame, **options) -> DataFrame:
    """``reads`` with the mates that do not pass taken out."""
    m = marked(reads, **options)
    kept = m.withColumn("seq", F.when(F.col("passes"), F.col("seq")))
    return (kept.withColumn("seq2", F.when(F.col("passes2"), F.col("seq2"))) if "seq2" in reads.columns else kept).drop("passes", "passes2")

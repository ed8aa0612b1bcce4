"""The seed similarity join: maximal exact matches between reads and reference sequences.

Reads and references are cut into k-mers (k = least hit length + 1, so the join key alone enforces the strict length
rule) and joined on the packed k-mer. ``runs`` carries the letters beside each k-mer through the join, so that only the
first and the last match of a maximal match leave it, and both strands meet in one row by the lesser of a k-mer and its
reverse complement. K-mers with more places than ``cap`` are dropped from the reference before the join: they would be
refused anyway, and no hot k-mer is ever multiplied.

Spark takes k-mers for as large as the compressed files they come from and would broadcast them through the driver, so
the joins here always shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxonflow.functions import dna

SEED = 23
SPAN = 2**16  # places of a reference that one group holds when k-mers are looked up beside their neighbours


def index(refs: DataFrame, ref_id: str, seq: str, k: int = SEED, cap: int | None = None) -> DataFrame:
    """(kmer, ref_id, ref_pos[, n_occ]) of the references. Group sizes come from partial aggregation."""
    all_ = dna.kmers(refs, ref_id, seq, k).select("kmer", F.col("ident").alias("ref_id"), F.col("pos").alias("ref_pos"))
    if cap is None:
        return all_
    seldom = all_.groupBy("kmer").agg(F.count(F.lit(1)).alias("n_occ")).where(F.col("n_occ") <= cap)
    return all_.join(seldom.hint("merge"), "kmer")


def read_kmers(reads: DataFrame, read_id: str, seq: str, k: int = SEED, strands: tuple[str, ...] = ("fw", "rc")) -> DataFrame:
    """(kmer, read_id, fw, off) of the chosen strands; off counts from the start of the strand read."""
    if not strands or set(strands) - {"fw", "rc"}:
        raise ValueError("strands are fw, rc or both")
    strand = lambda s, fw: dna.kmers(s, "r", "s", k).select("kmer", F.col("ident").alias("read_id"), F.lit(fw).alias("fw"), F.col("pos").alias("off"))
    fw = reads.select(F.col(read_id).alias("r"), F.col(seq).alias("s"))
    rc = reads.select(F.col(read_id).alias("r"), dna.reverse_complement(F.col(seq)).alias("s"))
    parts = [strand(fw, True)] * ("fw" in strands) + [strand(rc, False)] * ("rc" in strands)
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


def seed_matches(reads_k: DataFrame, index_k: DataFrame) -> DataFrame:
    """Every k-mer match: (read_id, fw, off, ref_id, ref_pos)."""
    return reads_k.join(index_k.hint("merge"), "kmer").select("read_id", "fw", "off", "ref_id", "ref_pos")


def maximal_matches(matches: DataFrame, k: int = SEED) -> DataFrame:
    """(read_id, fw, ref_id, off, ref_pos, length): runs of matches on one diagonal merged (gaps and islands)."""
    d = matches.withColumn("diagonal", F.col("ref_pos") - F.col("off"))
    w = Window.partitionBy("read_id", "fw", "ref_id", "diagonal").orderBy("off")
    island = d.withColumn("island", F.col("off") - F.dense_rank().over(w))  # repeated matches share their rank
    length = F.max("off") - F.min("off") + k
    runs = island.groupBy("read_id", "fw", "ref_id", "diagonal", "island").agg(F.min("off").alias("off"), F.min("ref_pos").alias("ref_pos"), length.alias("length"))
    return runs.select("read_id", "fw", "ref_id", "off", "ref_pos", "length")


def _seldom(places: DataFrame, cap: int) -> DataFrame:
    """Places of k-mers with at most ``cap`` places; a letter beside which the neighbouring k-mer is dropped counts as none."""
    pos, flip, _, _ = dna.place(F.col("at"))
    counted = places.withColumn("flip", flip).withColumn("n_occ", F.count(F.lit(1)).over(Window.partitionBy("kmer", "flip")))
    kept = counted.where(F.col("n_occ") <= cap).select("ident", "at", "kmer", pos.alias("pos"))
    # rows at the rim of a span stand in the next one, too, as neighbours only
    span, rim = F.floor(F.col("pos") / SPAN), F.col("pos") % SPAN
    spans = F.when(rim == 0, F.array(span - 1, span)).when(rim == SPAN - 1, F.array(span, span + 1)).otherwise(F.array(span))
    w = Window.partitionBy("ident", "span").orderBy("pos")
    beside = kept.withColumn("span", F.explode(spans)).withColumn("left", F.lag("pos").over(w) == F.col("pos") - 1).withColumn("right", F.lead("pos").over(w) == F.col("pos") + 1)
    before, after = (F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(0)).otherwise(F.lit(bits)) for c, bits in (("left", 7 << 3), ("right", 7)))
    return beside.where(F.col("span") == F.floor(F.col("pos") / SPAN)).select("ident", F.col("at").bitwiseOR(before).bitwiseOR(after).alias("at"), "kmer")


def runs(reads: DataFrame, read_id: str, seq: str, refs: DataFrame, ref_id: str, bases: str, k: int = SEED, cap: int | None = None, strands: tuple[str, ...] = ("fw", "rc")) -> DataFrame:
    """(read_id, fw, ref_id, off, ref_pos, length): the maximal matches of ``maximal_matches``; ids stand for one text each.

    A match is the first of its run where the letters before it differ, the last where those behind it do. Rows come
    out by (read_id, ref_id).
    """
    if not strands or set(strands) - {"fw", "rc"}:
        raise ValueError("strands are fw, rc or both")
    both = set(strands) == {"fw", "rc"}
    form = "canonical" if both else "reverse" if "rc" in strands else "forward"
    r = dna.placed_kmers(reads, read_id, seq, k, form, twice=True).select("kmer", F.col("ident").alias("read_id"), F.col("at").alias("a"), "rest")
    g = dna.placed_kmers(refs, ref_id, bases, k, "canonical" if both else "forward").select("ident", "at", "kmer")
    if cap is not None:
        g = _seldom(g, cap)
    (pos, flip, before, after), (ref_pos, ref_flip, ref_before, ref_after) = dna.place(F.col("a")), dna.place(F.col("at"))
    fw = flip == ref_flip
    # codes above 3 are no letters and equal nothing; 3 - x is the complement
    first = F.when(fw, before).otherwise(3 - after) != ref_before
    last = F.when(fw, after).otherwise(3 - before) != ref_after
    first, last = first | (ref_before > 3), last | (ref_after > 3)
    ends = r.join(g.hint("merge"), "kmer").where(first | last).select("read_id", fw.alias("fw"), F.col("ident").alias("ref_id"), F.when(fw, pos).otherwise(F.col("rest")).alias("off"), ref_pos.alias("ref_pos"), first.alias("first"), last.alias("last"))
    # firsts and lasts of a diagonal take turns
    w = Window.partitionBy("read_id", "ref_id", "fw", F.col("ref_pos") - F.col("off")).orderBy("off")
    end = F.when(F.col("last"), F.col("off")).otherwise(F.lead("off").over(w))
    out = ends.repartition("read_id", "ref_id").withColumn("end", end).where("first")
    return out.select("read_id", "fw", "ref_id", "off", "ref_pos", (F.col("end") - F.col("off") + k).alias("length"))


def seed_counts(runs: DataFrame, k: int = SEED) -> DataFrame:
    """(read_id, ref_id, fw, n_seeds): single k-mer matches, each of which is in one run."""
    return runs.groupBy("read_id", "ref_id", "fw").agg(F.sum(F.col("length") - (k - 1)).alias("n_seeds"))


def reference_scores(runs: DataFrame) -> DataFrame:
    """(read_id, ref_id, score, hit_len): squared hit lengths and lengths summed by strand, the better strand taken."""
    strand = runs.groupBy("read_id", "ref_id", "fw").agg(F.sum(dna.hit_score(F.col("length"))).alias("score"), F.sum("length").alias("hit_len"))
    return strand.groupBy("read_id", "ref_id").agg(F.max("score").alias("score"), F.max("hit_len").alias("hit_len"))

"""Reference index: fragments, k-mer tables, their statistics, and the views that read the tables back out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxonflow.functions import dna


def sequences(raw: DataFrame, ident: str, uid: str, tid: str, seq: str) -> DataFrame:
    """(ref_id, uid, tid, bases): one row for each id; rows delivered again are dropped."""
    rows = raw.where(F.col(ident).isNotNull() & F.col(seq).isNotNull())
    one = rows.groupBy(F.col(ident).alias("ref_id")).agg(F.max(F.struct(F.upper(seq).alias("bases"), F.col(uid).alias("uid"), F.col(tid).alias("tid"))).alias("v"))
    return one.select("ref_id", "v.uid", "v.tid", "v.bases")


def fragments(refs: DataFrame, n_to_a: bool = False) -> DataFrame:
    """(ref_id, frag_no, ref_off, bases): stretches of A, C, G, T with their offsets."""
    text = F.regexp_replace("bases", "[^ACGT]", "A") if n_to_a else F.col("bases")
    parts = refs.select("ref_id", F.posexplode(F.split(text, "[^ACGT]")).alias("i", "part"), text.alias("t"))
    # offset of a part: the letters of the parts before it and one separator each
    arr = F.split("t", "[^ACGT]")
    before = F.aggregate(F.slice(arr, 1, F.col("i")), F.lit(0), lambda a, x: a + F.length(x) + 1)
    cut = parts.select("ref_id", before.cast("bigint").alias("ref_off"), F.col("part").alias("bases")).where("length(bases) > 0")
    return cut.withColumn("frag_no", F.row_number().over(Window.partitionBy("ref_id").orderBy("ref_off")) - 1).select("ref_id", "frag_no", "ref_off", "bases")


def restored(frags: DataFrame, lengths: DataFrame, width: int = 60) -> DataFrame:
    """(ref_id, line_no, line): fragments laid out again, gaps as N, wrapped at ``width``."""
    joined = frags.groupBy("ref_id").agg(F.sort_array(F.collect_list(F.struct("ref_off", "bases"))).alias("f")).join(lengths.select("ref_id", "length"), "ref_id", "right")
    laid = F.aggregate(F.coalesce("f", F.array().cast("array<struct<ref_off:bigint,bases:string>>")), F.lit(""), lambda a, x: F.concat(F.rpad(a, x["ref_off"].cast("int"), "N"), x["bases"]))
    text = joined.select("ref_id", F.rpad(laid, F.col("length").cast("int"), "N").alias("text"))
    lines = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / width).cast("int") - 1)), lambda i: F.substring(F.col("text"), i * width + 1, F.lit(width)))
    return text.select("ref_id", F.posexplode(lines).alias("line_no", "line"))


def conversion_table(rows: DataFrame, uid: str, tid: str, order: str, known: DataFrame | None = None) -> DataFrame:
    """(uid, tid): the first mapping of each id wins; ids not in ``known`` (a column uid) are left out."""
    first = rows.where(F.col(uid).isNotNull() & F.col(tid).isNotNull()).groupBy(F.col(uid).alias("uid")).agg(F.min_by(F.col(tid), F.col(order)).alias("tid"))
    return first.join(known.select("uid").distinct(), "uid", "left_semi") if known is not None else first


def last_name_wins(rows: DataFrame, tid: str, name: str, order: str) -> DataFrame:
    return rows.where(F.col(tid).isNotNull()).groupBy(F.col(tid).alias("tid")).agg(F.max_by(F.col(name), F.col(order)).alias("name"))


def sizes(refs: DataFrame) -> DataFrame:
    """(tid, size): summed sequence lengths of each taxon."""
    return refs.where("tid is not null").groupBy("tid").agg(F.sum(F.length("bases").cast("bigint")).alias("size"))


def sizes_with(computed: DataFrame, given: DataFrame) -> DataFrame:
    """(tid, size): sizes of the given table in the place of computed ones; a taxon given twice has its largest size."""
    g = given.where("tid is not null and size is not null").groupBy("tid").agg(F.max("size").alias("_given"))
    return computed.join(g, "tid", "full").select("tid", F.coalesce("_given", "size").alias("size"))


def names_only(refs: DataFrame) -> DataFrame:
    """(name): the sequences' names."""
    return refs.select(F.coalesce("uid", F.col("ref_id").cast("string")).alias("name"))


def cleaned_records(refs: DataFrame, width: int = 80) -> DataFrame:
    """(ref_id, header, line_no, line): records prepared for indexing. The taxon stands first in the header, N letters are
    taken out, text is wrapped at ``width`` and records left without letters are dropped."""
    text = F.regexp_replace("bases", "[nN]", "")
    kept = refs.select("ref_id", F.concat_ws(" ", dna.taxid_text(F.coalesce("tid", F.lit(0))), "uid").alias("header"), text.alias("t")).where("t <> ''")
    lines = F.transform(F.sequence(F.lit(0), F.ceil(F.length("t") / width).cast("int") - 1), lambda i: F.substring(F.col("t"), i * width + 1, F.lit(width)))
    return kept.select("ref_id", "header", F.posexplode(lines).alias("line_no", "line"))


def spectrum(refs: DataFrame, most: int) -> DataFrame:
    """(k, n_distinct, n_total) of the k-mers of all sizes 1 to ``most``; distinct k-mers are grouped before they are counted."""
    out = None
    for k in range(1, most + 1):
        seen = dna.kmers(refs, "ref_id", "bases", k).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
        part = seen.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"))
        out = part if out is None else out.unionByName(part)
    return out


def distinct_kmers(refs: DataFrame, k: int = 31, exact: bool = True) -> DataFrame:
    """(n_kmers): exactly, or from a sketch with a mergeable state."""
    all_ = dna.kmers(refs, "ref_id", "bases", k)
    if exact:
        return all_.select("kmer").distinct().agg(F.count(F.lit(1)).alias("n_kmers"))
    return all_.agg(F.hll_sketch_estimate(F.hll_sketch_agg("kmer", F.lit(16))).alias("n_kmers"))


def taxon_kmers(refs: DataFrame, k: int = 31) -> DataFrame:
    """(tid, n_kmers): exact distinct k-mers of each taxon's sequences, k-mers grouped before they are counted."""
    of = refs.where("tid is not null").select(F.col("ref_id").alias("ident"), "tid")
    return dna.kmers(refs, "ref_id", "bases", k).join(of, "ident").select("tid", "kmer").distinct().groupBy("tid").agg(F.count(F.lit(1)).alias("n_kmers"))


def taxon_sketches(refs: DataFrame, k: int = 31) -> DataFrame:
    """(tid, sketch): a mergeable distinct-count state for each taxon."""
    of = refs.where("tid is not null").select(F.col("ref_id").alias("ident"), "tid")
    return dna.kmers(refs, "ref_id", "bases", k).join(of, "ident").groupBy("tid").agg(F.hll_sketch_agg("kmer", F.lit(12)).alias("sketch"))


def merged_estimate(sketches: DataFrame) -> DataFrame:
    """(n_kmers) over all taxa, from the union of their states."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_kmers"))


def summary(refs: DataFrame, k: int) -> DataFrame:
    """(key, value) rows: index parameters, then name and length of each sequence."""
    row = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    figures = refs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("bases")), F.lit(0)).alias("b"))
    head = figures.select(F.explode(F.array(row("seed_length", F.lit(k)), row("sequences", F.col("n")), row("bases", F.col("b")))).alias("x"))
    each = refs.select(F.concat(F.lit("sequence "), F.coalesce("uid", F.col("ref_id").cast("string"))).alias("key"), F.length("bases").cast("string").alias("value"))
    return head.select("x.key", "x.value").unionByName(each)


def tree_text(lines: DataFrame) -> DataFrame:
    """(line): tid, parent and rank separated by tab, pipe, tab."""
    return lines.select(F.concat_ws("\t|\t", dna.taxid_text(F.col("tid")), dna.taxid_text(F.coalesce("parent_tid", F.lit(0))), "tax_rank").alias("line"))

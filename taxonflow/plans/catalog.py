"""Queries of the classification operators over whole tables, and the SQL they are held against.

References are the records of genome_seq; reads are all 100-letter windows of those records, the rest of
a record being a shorter last one. Hits, per-read entries and
assignments come from hit_count, the tree from taxonomy_node, counters from read_counts, accessions from ac_to_pos and
ac_to_taxid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxonflow.functions import dna
from taxonflow.operators import abundance, assign, exact, filters, index, redundancy, report, seeds, taxonomy
from taxonflow.plans.core_problems import LINK, VALID, WALK
from taxonflow.session import cut_lineage, shared_folder, table
from taxonflow.sources import readers, sinks

READ_LENGTH = 100
WINDOWS = 2**25  # more than a text of 2^31 letters, the longest there is, has windows
EXCLUDED, HOST = 9656, 2778  # taxa the exclusion and host queries are run with


# --- inputs


def refs(spark: SparkSession, d: str) -> DataFrame:
    return index.sequences(table(spark, d, "genome_seq"), "seq_id", "uid", "tid", "bases")


def reads(spark: SparkSession, d: str) -> DataFrame:
    """(read_id, ref_id, seq): windows of READ_LENGTH letters, one after another; the last may be shorter."""
    r = refs(spark, d).where(F.length("bases") > 0)
    n = F.ceil(F.length("bases") / READ_LENGTH).cast("int")
    cut = r.withColumn("w", F.explode(F.sequence(F.lit(0), n - 1)))
    return cut.select((F.col("ref_id") * WINDOWS + F.col("w")).alias("read_id"), "ref_id", F.substring(F.col("bases"), F.col("w") * READ_LENGTH + 1, F.lit(READ_LENGTH)).alias("seq"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    return assign.finalised(assign.hits(table(spark, d, "hit_count")))


def best(spark: SparkSession, d: str) -> DataFrame:
    return assign.best_only(entries(spark, d))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.lines(table(spark, d, "taxonomy_node"))


def tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return taxonomy.tree(table(spark, d, "taxonomy_node"))


def chosen(spark: SparkSession, d: str, known: tuple[DataFrame, DataFrame] | None = None, k: int = 5) -> DataFrame:
    """Assignments: best entries, rolled up the taxonomy to at most k. ``known`` is the tree, if it is there already."""
    return assign.selected(entries(spark, d), k, taxonomy.canonical_paths(*(known or tree(spark, d))))


# --- sequences and functions


def seed_join(spark: SparkSession, d: str) -> DataFrame:
    return seeds.seed_counts(_runs(spark, d))


def _runs(spark: SparkSession, d: str, cap: int | None = None, strands: tuple[str, ...] = ("fw", "rc")) -> DataFrame:
    return seeds.runs(reads(spark, d), "read_id", "seq", refs(spark, d), "ref_id", "bases", cap=cap, strands=strands)


def seed_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d)


def hit_score(spark: SparkSession, d: str) -> DataFrame:
    return seeds.reference_scores(_runs(spark, d))


def occurrence_cap(spark: SparkSession, d: str) -> DataFrame:
    return seeds.reference_scores(_runs(spark, d, cap=2))


def exact_classification(spark: SparkSession, d: str) -> DataFrame:
    return exact.classify(reads(spark, d), refs(spark, d))


def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return refs(spark, d).select("ref_id", dna.reverse_complement(dna.cleaned(F.col("bases"))).alias("rc"))


def n_filter(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("read_id", dna.n_count(F.col("seq")).alias("n_ambiguous"), dna.passes_n_filter(F.col("seq")).alias("passes"))


def trim_reads(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("read_id", dna.trimmed(F.col("seq"), 7, 5).alias("seq"))


def kmer_encode(spark: SparkSession, d: str) -> DataFrame:
    """Whole k-mers in two packed words, of up to 31 letters and of the rest; both null if any letter is not A, C, G or T."""
    k = table(spark, d, "local_kmer").select("genome_id", "kmer").distinct()
    good = F.upper("kmer").rlike("^[ACGT]{1,62}$")
    word = lambda start: F.when(good, dna.kmer_code(F.substring("kmer", start, 31)))
    return k.select("genome_id", "kmer", word(1).alias("code_1"), F.when(F.length("kmer") > 31, word(32)).alias("code_2"))


def pair_filters(spark: SparkSession, d: str) -> DataFrame:
    """Each pair of neighbouring windows as a pair of mates: what passes by mate, and with both mates' letters together."""
    r = reads(spark, d).withColumn("w", F.col("read_id") % WINDOWS)
    mate = r.select("ref_id", (F.col("w") - 1).alias("w"), F.col("seq").alias("seq2"))
    pairs = r.where("w % 2 = 0").join(mate, ["ref_id", "w"], "left").withColumn("filter", (F.col("read_id") % 3).cast("string"))
    one = filters.marked(pairs, qc=True)
    both = filters.n_filter_pair(F.col("seq"), F.col("seq2"), together=True)[0]
    return one.select("read_id", "passes", "passes2", both.alias("passes_together"))


def read_id_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ac_to_pos").select("pos_id", dna.header_uid(F.col("header")).alias("uid"), dna.read_name(F.concat(F.regexp_replace("header", "^>", ""), F.lit("/1"))).alias("name"))


def phred(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "ac_to_pos").where("seq_len is not null").select("pos_id", F.chr(64 + F.col("seq_len") % 41).alias("q64"), (F.col("seq_len") % 41).cast("string").alias("qi"))
    return q.select("pos_id", dna.phred33(F.col("q64"), "phred64").alias("from64"), dna.phred33(F.col("qi"), "int").alias("fromint"))


def packed_taxids(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "taxonomy_node").select("tid").where("tid is not null").distinct()
    text = dna.taxid_text(F.col("tid"))
    return t.select("tid", text.alias("shown"), dna.packed_taxid(text).alias("back"))


def rank_names(spark: SparkSession, d: str) -> DataFrame:
    r = dna.rank_name(F.col("tax_rank"))
    return table(spark, d, "taxonomy_node").groupBy(r.alias("rank"), dna.rank_code(r).alias("code"), dna.slot(r).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def skip_upto(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hit_count").where("read_no >= 10 and read_no < 500").select("hit_id", "read_no")


def sample_reads(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of the reads by an arithmetic hash of the read."""
    return table(spark, d, "hit_count").select("sample_id", "read_no").distinct().where("(read_no * 7919 + sample_id * 104729) % 100 < 20")


def continuous_windows(spark: SparkSession, d: str) -> DataFrame:
    named = refs(spark, d).select(F.concat_ws(" ", F.coalesce("uid", F.concat(F.lit("r"), F.col("ref_id").cast("string"))), F.lit("x")).alias("name"), F.col("bases").alias("seq"))
    return readers.windows(named, 60, 45).select("name", "seq")


# --- index


def fasta_fragments(spark: SparkSession, d: str) -> DataFrame:
    return index.fragments(refs(spark, d)).select("ref_id", F.col("frag_no").cast("bigint").alias("frag_no"), "ref_off", "bases")


def inspect_fasta(spark: SparkSession, d: str) -> DataFrame:
    r = refs(spark, d)
    return index.restored(index.fragments(r), r.select("ref_id", F.length("bases").alias("length")))


def inspect_summary(spark: SparkSession, d: str) -> DataFrame:
    return index.summary(refs(spark, d), seeds.SEED)


def inspect_tree(spark: SparkSession, d: str) -> DataFrame:
    return index.tree_text(lines(spark, d))


def inspect_names(spark: SparkSession, d: str) -> DataFrame:
    return index.names_only(refs(spark, d))


def cleaned_records(spark: SparkSession, d: str) -> DataFrame:
    return index.cleaned_records(refs(spark, d))


def size_override(spark: SparkSession, d: str) -> DataFrame:
    """Computed sizes, and in their place those a table names (here of every third taxon)."""
    own = genome_sizes(spark, d)
    return index.sizes_with(own, own.where("tid % 3 = 0").select("tid", (F.col("size") * 10).alias("size")))


def conversion_table(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "ac_to_pos").select(F.upper(F.trim("ac")).alias("uid"))
    return index.conversion_table(table(spark, d, "ac_to_taxid").withColumn("u", F.upper(F.trim("ac"))), "u", "taxid", "map_id", known)


def genome_sizes(spark: SparkSession, d: str) -> DataFrame:
    return index.sizes(refs(spark, d))


def kmer_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return index.spectrum(refs(spark, d), 6)


def distinct_kmers_exact(spark: SparkSession, d: str) -> DataFrame:
    return index.distinct_kmers(refs(spark, d), 31)


def distinct_kmers_approx(spark: SparkSession, d: str) -> DataFrame:
    return index.distinct_kmers(refs(spark, d), 31, exact=False)


def taxon_kmers(spark: SparkSession, d: str) -> DataFrame:
    return index.taxon_kmers(refs(spark, d))


def merged_kmers_approx(spark: SparkSession, d: str) -> DataFrame:
    return index.merged_estimate(index.taxon_sketches(refs(spark, d)))


def species_groups(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.species_groups(refs(spark, d), taxonomy.promotion(*tree(spark, d), "species"), most=2000)


def genome_sim_pairs(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.similar_pairs(refs(spark, d))


def nonshared_regions(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.nonshared(refs(spark, d))


def sequences_by_taxon(spark: SparkSession, d: str) -> DataFrame:
    """Sequences with their place in taxon order."""
    first = conversion_table(spark, d).withColumnRenamed("tid", "taxid")
    pos = table(spark, d, "ac_to_pos").select("pos_id", F.upper(F.trim("ac")).alias("uid"), "file_pos")
    return readers.by_taxon_and_place(pos.join(first, "uid")).select("pos_id", "taxid", "file_pos")


# --- per-read results


def finalised_entries(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("sample_id", "read_no", "tid", "score", F.round("hit_len", 3).alias("hit_len"))


def best_ties(spark: SparkSession, d: str) -> DataFrame:
    return best(spark, d).select("sample_id", "read_no", "tid", "score")


def topk_assign(spark: SparkSession, d: str) -> DataFrame:
    return chosen(spark, d).select("sample_id", "read_no", "tid", "score", "n_matches")


def all_assign(spark: SparkSession, d: str) -> DataFrame:
    return assign.selected(entries(spark, d), None).select("sample_id", "read_no", "tid", "score", "n_matches")


def no_traverse(spark: SparkSession, d: str) -> DataFrame:
    return assign.selected(entries(spark, d), 1, traverse=False).select("sample_id", "read_no", "tid", "score", "n_matches")


def random_assign(spark: SparkSession, d: str) -> DataFrame:
    return assign.random_selection(entries(spark, d), 2).select("sample_id", "read_no", "tid", "score")


def second_best(spark: SparkSession, d: str) -> DataFrame:
    return assign.second_best(entries(spark, d))


def num_matches(spark: SparkSession, d: str) -> DataFrame:
    return chosen(spark, d).select("sample_id", "read_no", "n_matches").distinct()


def exclude_taxa(spark: SparkSession, d: str) -> DataFrame:
    _, resolved = tree(spark, d)
    kept = assign.without(assign.hits(table(spark, d, "hit_count")), taxonomy.descendants_of(resolved, [EXCLUDED]))
    return assign.best_only(assign.finalised(kept)).select("sample_id", "read_no", "tid", "score")


def host_taxa(spark: SparkSession, d: str) -> DataFrame:
    _, resolved = tree(spark, d)
    return assign.host_first(best(spark, d), taxonomy.descendants_of(resolved, [HOST])).select("sample_id", "read_no", "tid", "score", "is_host")


def bounded_rollup(spark: SparkSession, d: str) -> DataFrame:
    """All best entries of a read rolled up to one taxon, or none."""
    out = assign.bounded_rollup(best(spark, d), taxonomy.canonical_paths(*tree(spark, d)), 1)
    return out.select("sample_id", "read_no", "tid", F.round("hit_len", 3).alias("hit_len"))


def rollup_to_two(spark: SparkSession, d: str) -> DataFrame:
    """Assignments of at most two taxa a read, with the second best score of what is left."""
    return chosen(spark, d, k=2).select("sample_id", "read_no", "tid", "score", F.round("hit_len", 3).alias("hit_len"), "second", "n_matches", "moved")


def host_selection(spark: SparkSession, d: str) -> DataFrame:
    """Assignments where a host taxon among the best stops the rollup and stays alone, one row a read at most."""
    known = tree(spark, d)
    host = taxonomy.descendants_of(known[1], [HOST])
    a = assign.selected(entries(spark, d), 1, taxonomy.canonical_paths(*known), host, seed=7)
    return a.select("sample_id", "read_no", "tid", "score", "second", "n_matches")


def classification_rank(spark: SparkSession, d: str) -> DataFrame:
    """Best entries when hits are accumulated by genus instead of by taxon."""
    keys = taxonomy.key_at_rank(taxonomy.canonical_paths(*tree(spark, d)), "genus")
    h = assign.hits(table(spark, d, "hit_count")).join(keys, "tid", "left").withColumn("tid", F.coalesce("key", "tid")).drop("key")
    return assign.best_only(assign.finalised(h)).select("sample_id", "read_no", "tid", "score")


def score_filter(spark: SparkSession, d: str) -> DataFrame:
    return report.filtered(chosen(spark, d), 5000, 60).select("sample_id", "read_no", "tid", "score")


def one_strand(spark: SparkSession, d: str) -> DataFrame:
    return seeds.seed_counts(_runs(spark, d, strands=("rc",))).drop("fw")


def seqid_display(spark: SparkSession, d: str) -> DataFrame:
    """What stands in the sequence column: the accession for leaves and taxa outside the tree, else the rank."""
    h = assign.hits(table(spark, d, "hit_count")).select("unique_id", "tid").distinct()
    ac = table(spark, d, "ac_to_pos").select(F.col("pos_id").alias("unique_id"), F.col("ac").alias("uid"))
    return report.with_sequence_id(h.join(ac, "unique_id", "left"), lines(spark, d)).select("unique_id", "tid", F.col("seqID").alias("seq_id"))


def classified_split(spark: SparkSession, d: str) -> DataFrame:
    reads_ = table(spark, d, "hit_count").select("sample_id", "read_no").distinct()
    a = chosen(spark, d)
    yes, no = assign.classified_reads(reads_, a), assign.unclassified_reads(reads_, a)
    return yes.withColumn("classified", F.lit(True)).unionByName(no.withColumn("classified", F.lit(False)))


def output_table(spark: SparkSession, d: str) -> DataFrame:
    """The assignment table with its output columns; here a read's entries are its sequences."""
    known = tree(spark, d)
    h = assign.hits(table(spark, d, "hit_count"))
    a = assign.selected(assign.finalised(h, "unique_id", "tid"), 5, taxonomy.canonical_paths(*known))
    length = h.groupBy(*assign.READ).agg(F.max("query_length").alias("queryLength"))
    ac = table(spark, d, "ac_to_pos").select(F.col("pos_id").alias("unique_id"), F.col("ac").alias("uid"))
    named = report.with_sequence_id(a.join(ac, "unique_id", "left"), known[0])
    rows = named.join(length, assign.READ).select(
        F.concat_ws("_", "sample_id", "read_no").alias("readID"), "seqID", F.col("tid").alias("taxID"), "score",
        F.col("second").alias("2ndBestScore"), F.round("hit_len", 3).alias("hitLength"), "queryLength", F.col("n_matches").alias("numMatches"),
    )
    return sinks.projected(rows)


def finalised_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Entries by sequence instead of taxon."""
    e = assign.finalised(assign.hits(table(spark, d, "hit_count")), "unique_id", "tid")
    return e.select("sample_id", "read_no", "unique_id", "tid", "score", F.round("hit_len", 3).alias("hit_len"))


def unclassified_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every read has a row: its assignments, or one of taxon 0."""
    reads_ = table(spark, d, "hit_count").select("sample_id", "read_no")
    return assign.unclassified(reads_, chosen(spark, d))


# --- taxonomy


def tax_closure(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.closure(tree(spark, d)[1])


def tax_path(spark: SparkSession, d: str) -> DataFrame:
    p = taxonomy.canonical_paths(*tree(spark, d))
    return p.select("tid", F.array_join(F.transform("slots", lambda x: x.cast("string")), ",").alias("slots"))


def genus_of(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.ancestor_at(taxonomy.canonical_paths(*tree(spark, d)), dna.SLOTS["genus"])


def pruned_tree(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "genome_seq").select("tid")
    return taxonomy.with_leaf(taxonomy.pruned(*tree(spark, d), r), r).select("tid", "parent_tid", "leaf")


def lca_reads(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.common_ancestors(best(spark, d), assign.READ, "tid", tree(spark, d)[1])


def promote_rank(spark: SparkSession, d: str) -> DataFrame:
    known = tree(spark, d)
    p = taxonomy.promotion(*known, "genus")
    rows = chosen(spark, d, known).join(p, "tid", "left").select(*assign.READ, F.coalesce("promoted", "tid").alias("tid")).distinct()
    n = rows.groupBy(*assign.READ).agg(F.count(F.lit(1)).alias("n_matches"))
    return rows.join(n, assign.READ)


def mean_genome_size(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.mean_sizes(*tree(spark, d), genome_sizes(spark, d))


def clade_rollup(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "read_counts").where("tax_id is not null and n_reads is not null").distinct().groupBy(F.col("tax_id").alias("tid")).agg(F.sum("n_reads").alias("n"))
    return taxonomy.clade_counts(own, tree(spark, d)[1])


# --- reports


def taxon_report(spark: SparkSession, d: str) -> DataFrame:
    known = tree(spark, d)
    r = report.taxon_report(assign.taxon_counts(chosen(spark, d, known)), known[0], genome_sizes(spark, d))
    return r.drop("abundance")


def taxon_weights(spark: SparkSession, d: str) -> DataFrame:
    c = assign.taxon_counts(chosen(spark, d))
    return c.select("tid", "n_reads", "n_unique_reads", F.round("weighted_reads", 6).alias("weighted_reads"), "sum_score", F.round("summed_hit_len", 3).alias("summed_hit_len"))


def batch_totals(spark: SparkSession, d: str) -> DataFrame:
    """Partial counters of all batches merged; rows delivered twice count once."""
    r = table(spark, d, "read_counts").distinct()
    return r.groupBy("tax_id").agg(F.sum("n_reads").alias("n_reads"), F.sum("sum_score").alias("sum_score"), F.round(F.sum("weighted_reads"), 3).alias("weighted_reads"), F.sum("n_unique_reads").alias("n_unique_reads"))


def kreport_lca(spark: SparkSession, d: str) -> DataFrame:
    _, resolved = tree(spark, d)
    lca = taxonomy.common_ancestors(best(spark, d), assign.READ, "tid", resolved)
    return taxonomy.clade_counts(lca.groupBy(F.col("lca").alias("tid")).agg(F.count(F.lit(1)).alias("n")), resolved)


def kreport_fraction(spark: SparkSession, d: str) -> DataFrame:
    known = tree(spark, d)
    own = chosen(spark, d, known).where("tid <> 0").groupBy("tid").agg(F.sum(1 / F.col("n_matches")).alias("n"))
    c = taxonomy.clade_counts(own, known[1])
    return c.select("tid", F.round("clade", 6).alias("clade"), F.round("own", 6).alias("own"))


def kreport_counts(spark: SparkSession, d: str) -> DataFrame:
    """Clade counts and percentages of a count table, the last line of a taxon counting (read_counts by batch)."""
    lines_, resolved = tree(spark, d)
    rows = table(spark, d, "read_counts").where("n_reads is not null").groupBy("tax_id", "batch_id").agg(F.max("n_reads").alias("count"))
    own, total = report.from_count_table(rows.select(F.col("tax_id").alias("tid"), "count", F.col("batch_id").alias("place")))
    c = taxonomy.clade_counts(own, resolved)
    return c.join(F.broadcast(total)).select("tid", "clade", "own", F.round(100 * F.col("clade") / F.col("n_total"), 4).alias("pct"))


def kreport_text(spark: SparkSession, d: str) -> DataFrame:
    known = tree(spark, d)
    lca = taxonomy.common_ancestors(best(spark, d), assign.READ, "tid", known[1])
    clades = taxonomy.clade_counts(lca.groupBy(F.col("lca").alias("tid")).agg(F.count(F.lit(1)).alias("n")), known[1])
    return report.clade_report(cut_lineage(clades), *known).select("pct", "clade", "own", "rank_code", "tid", "label")


def score_report(spark: SparkSession, d: str) -> DataFrame:
    r = report.score_report(chosen(spark, d).where("tid <> 0"), genome_sizes(spark, d))
    return r.select("tid", "score", F.round("per_base", 6).alias("per_base"))


def _classes(spark: SparkSession, d: str, known: tuple[DataFrame, DataFrame]) -> DataFrame:
    raw = table(spark, d, "hit_count").where("score is not null")
    return assign.equivalence_classes(assign.full_matches(chosen(spark, d, known), assign.greatest_scores(raw)))


def equiv_classes(spark: SparkSession, d: str) -> DataFrame:
    """Taxon sets of the reads that match from end to end."""
    c = _classes(spark, d, tree(spark, d))
    return c.select(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "n")


def _em_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    known = tree(spark, d)
    leaves = assign.hits(table(spark, d, "hit_count")).where("tid <> 0").select("tid").distinct()
    rows = abundance.class_rows(_classes(spark, d, known), known[1], leaves)
    return cut_lineage(rows), genome_sizes(spark, d).withColumnRenamed("tid", "leaf")


def em_step(spark: SparkSession, d: str) -> DataFrame:
    """The start values and one step after them."""
    rows, lengths = _em_rows(spark, d)
    p0 = cut_lineage(abundance.start(rows, lengths))
    p1 = abundance.em_step(rows, p0, lengths)
    return p1.join(p0.withColumnRenamed("p", "p0"), "leaf").select(F.col("leaf").alias("tid"), F.round("p0", 8).alias("p0"), F.round("p", 8).alias("p1"))


def em_abundance(spark: SparkSession, d: str) -> DataFrame:
    return abundance.abundances(*_em_rows(spark, d)).select("tid", F.round("abundance", 6).alias("abundance"), F.round("read_share", 6).alias("read_share"))


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """The taxon of each read's hit with the smallest hit_id."""
    return table(spark, d, "hit_count").groupBy(*assign.READ).agg(F.min_by(F.coalesce("tax_id", F.lit(0)), "hit_id").alias("tid"))


def accuracy(spark: SparkSession, d: str) -> DataFrame:
    a = report.accuracy(chosen(spark, d), _truth(spark, d), assign.READ)
    return a.select("n_reads", "n_classified", "n_right", "n_unique_right", F.round("sensitivity", 6).alias("sensitivity"), F.round("precision", 6).alias("precision"))


def _shares(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    def share(df: DataFrame, n: str) -> DataFrame:
        w = df.agg(F.sum(n).alias("w"))
        return df.join(F.broadcast(w)).select("tid", (F.col(n) / F.col("w")).alias("x"))

    true = table(spark, d, "read_counts").where("tax_id is not null").groupBy(F.col("tax_id").alias("tid")).agg(F.coalesce(F.sum("n_reads"), F.lit(0)).alias("n"))
    calc = assign.taxon_counts(chosen(spark, d)).where("tid <> 0").select("tid", F.col("n_reads").alias("n"))
    return share(calc, "n"), share(true, "n")


def abundance_ssr(spark: SparkSession, d: str) -> DataFrame:
    s = report.squared_residuals(*_shares(spark, d))
    return s.select(F.round("ssr", 9).alias("ssr"), "n_taxa")


def _ranked_pairs(spark: SparkSession, d: str) -> DataFrame:
    calc, true = _shares(spark, d)
    j = true.withColumnRenamed("x", "a").join(calc.withColumnRenamed("x", "b"), "tid").join(lines(spark, d).select("tid", "tax_rank"), "tid")
    return cut_lineage(j.select("tax_rank", "a", "b"))


def rank_corr(spark: SparkSession, d: str) -> DataFrame:
    c = report.correlations(_ranked_pairs(spark, d), "tax_rank")
    return c.where("n > 2").select("tax_rank", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"), "n")


def rank_kendall(spark: SparkSession, d: str) -> DataFrame:
    return report.kendall(_ranked_pairs(spark, d), "tax_rank").select("tax_rank", F.round("tau_b", 6).alias("tau_b"))


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Running counts of events by type, driven through a stream to its end."""
    import uuid

    from taxonflow.streaming import streams

    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    static = table(spark, d, "events")
    s = spark.readStream.schema(static.schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    out = streams.run_once(streams.running_counts(s, "event_type"), f"counts_{uuid.uuid4().hex}", "complete", folder)
    return spark.createDataFrame(out.collect(), out.schema)  # one row for each event type


QUERIES = [
    seed_join, seed_runs, hit_score, occurrence_cap, exact_classification, revcomp, n_filter, trim_reads, pair_filters, kmer_encode, inspect_names, cleaned_records, size_override, kreport_counts, read_id_clean, phred, packed_taxids, rank_names,
    skip_upto, sample_reads, continuous_windows, fasta_fragments, inspect_fasta, inspect_summary, inspect_tree, conversion_table, genome_sizes, kmer_spectrum,
    distinct_kmers_exact, distinct_kmers_approx, taxon_kmers, merged_kmers_approx, species_groups, classification_rank, score_filter, one_strand, genome_sim_pairs, nonshared_regions, sequences_by_taxon, finalised_entries, best_ties, topk_assign, all_assign, no_traverse,
    random_assign, rollup_to_two, host_selection, finalised_sequences, unclassified_rows, second_best, num_matches, exclude_taxa, host_taxa, bounded_rollup, seqid_display, classified_split, output_table, tax_closure, tax_path, genus_of, pruned_tree,
    lca_reads, promote_rank, mean_genome_size, clade_rollup, taxon_report, taxon_weights, batch_totals, kreport_lca, kreport_fraction, kreport_text, score_report, equiv_classes,
    em_step, em_abundance, accuracy, abundance_ssr, rank_corr, rank_kendall, stream_counts,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


# --- SQL

REFS = "refs AS (SELECT seq_id AS ref_id, max(upper(bases)) AS bases FROM genome_seq WHERE seq_id IS NOT NULL AND bases IS NOT NULL GROUP BY 1), reft AS (SELECT DISTINCT r.ref_id, r.bases, g.tid, g.uid FROM refs r JOIN genome_seq g ON g.seq_id = r.ref_id)"
READS = f"reads AS (SELECT ref_id * {WINDOWS} + w AS read_id, ref_id, substr(bases, w * {READ_LENGTH} + 1, {READ_LENGTH}) AS seq FROM (SELECT ref_id, bases, unnest(range(0, CAST(ceil(length(bases) / {READ_LENGTH}) AS BIGINT))) AS w FROM refs))"
RC = "reverse(translate(upper({}), 'ACGTN', 'TGCAN'))"


def _kmers(source: str, ident: str, seq: str, k: int, extra: str = "") -> str:
    return f"SELECT {ident} AS ident, i AS pos, substr(s, i + 1, {k}) AS kmer{extra} FROM (SELECT {ident}, {seq} AS s, unnest(range(0, length({seq}) - {k} + 1)) AS i FROM {source} WHERE length({seq}) >= {k}) WHERE regexp_full_match(substr(s, i + 1, {k}), '[ACGT]+')"


def _seed_cte(cap: int | None = None) -> str:
    k = seeds.SEED
    keep = f" WHERE kmer IN (SELECT kmer FROM ik0 GROUP BY 1 HAVING count(*) <= {cap})" if cap else ""
    return f"""WITH {REFS}, {READS}, ik0 AS ({_kmers("refs", "ref_id", "bases", k)}), ik AS (SELECT * FROM ik0{keep}),
        both_ AS (SELECT read_id, true AS fw, seq FROM reads UNION ALL SELECT read_id, false, {RC.format("seq")} FROM reads),
        rk AS (SELECT read_id, fw, i AS off, substr(seq, i + 1, {k}) AS kmer FROM (SELECT *, unnest(range(0, length(seq) - {k} + 1)) AS i FROM both_)),
        m AS (SELECT r.read_id, r.fw, r.off, i.ident AS ref_id, i.pos AS ref_pos FROM rk r JOIN ik i ON r.kmer = i.kmer),
        isl AS (SELECT *, ref_pos - off AS diag, off - row_number() OVER (PARTITION BY read_id, fw, ref_id, ref_pos - off ORDER BY off) AS island FROM m),
        runs AS (SELECT read_id, fw, ref_id, min(off) AS off, min(ref_pos) AS ref_pos, count(*) + {k} - 1 AS length FROM isl GROUP BY read_id, fw, ref_id, diag, island),
        sc AS (SELECT read_id, ref_id, fw, sum(CASE WHEN length > 15 THEN (length - 15) * (length - 15) ELSE 0 END) AS s, sum(length) AS l FROM runs GROUP BY 1, 2, 3),
        scores AS (SELECT read_id, ref_id, CAST(max(s) AS BIGINT) AS score, CAST(max(l) AS BIGINT) AS hit_len FROM sc GROUP BY 1, 2)"""


RANK = "CASE WHEN coalesce(replace(lower(trim(tax_rank, ' \t')), '_', ' '), '') = '' THEN 'no rank' ELSE replace(lower(trim(tax_rank, ' \t')), '_', ' ') END"
SLOT = "CASE {r} " + " ".join(f"WHEN '{n}' THEN {s}" for n, s in dna.SLOTS.items()) + " END"
LINES = f"lines AS (SELECT tid, s.p AS parent_tid, s.r AS tax_rank, s.l AS leaf FROM (SELECT tid, arg_min(struct_pack(p := parent_tid, r := {RANK}, l := leaf), line_no) AS s FROM taxonomy_node WHERE tid IS NOT NULL GROUP BY tid))"
TREE = f"{VALID}, {LINK}, {WALK}, {LINES}, cl AS (SELECT tid, CAST(anc AS BIGINT) AS anc_tid, depth - i + 1 AS distance FROM (SELECT tid, depth, unnest(string_split(path, '/')) AS anc, unnest(range(1, depth + 2)) AS i FROM w))"
HITS = "hits AS (SELECT sample_id, read_no, unique_id, coalesce(tax_id, 0) AS tid, mate, fw, score, coalesce(summed_hit_len, 0) AS hl FROM (SELECT DISTINCT * FROM hit_count WHERE score IS NOT NULL))"


def _entries(name: str = "hits", key: str = "tid") -> str:
    return f"""s1 AS (SELECT sample_id, read_no, {key}, mate, fw, sum(score) AS sc, sum(hl) AS hl FROM {name} GROUP BY ALL), s2 AS (SELECT sample_id, read_no, {key}, mate, max(sc) AS sc, max(hl) AS hl FROM s1 GROUP BY ALL),
        e AS MATERIALIZED (SELECT sample_id, read_no, {key}, CAST(sum(sc) AS BIGINT) AS score, sum(hl) AS hit_len FROM s2 GROUP BY ALL), b AS MATERIALIZED (SELECT * FROM e QUALIFY score = max(score) OVER (PARTITION BY sample_id, read_no))"""


def _mixed(*columns: str, seed: int = 0) -> str:
    x = f"CAST({seed} AS BIGINT)"
    for c in columns:
        x = f"(({x} * 48271 + {c} % {assign.PRIME}) % {assign.PRIME})"
        x = f"list_reduce([{x}, 12345], lambda a, b: (a * a + b) % {assign.PRIME})"
    return x


def _selected(k: int, uid: bool = False) -> str:
    """The rows kept of each read (sel), the rollup written out turn by turn. Needs TREE and _entries."""
    read, last = "sample_id, read_no", dna.SLOT_COUNT
    id_ = "unique_id" if uid else "CAST(NULL AS BIGINT)"
    out = [
        f"slots AS MATERIALIZED (SELECT w.tid, [{', '.join(f'coalesce(max(CASE WHEN slot = {s} THEN a END), 0)' for s in range(dna.SLOT_COUNT))}] AS path FROM w LEFT JOIN (SELECT tid, slot, arg_min(anc_tid, distance) AS a FROM (SELECT cl.tid, cl.anc_tid, distance, CASE WHEN distance = 0 AND ls.slot IS NULL THEN 0 ELSE ls.slot END AS slot FROM cl JOIN (SELECT tid AS anc_tid, {SLOT.format(r='tax_rank')} AS slot FROM lines) ls USING (anc_tid)) WHERE slot IS NOT NULL GROUP BY 1, 2) f ON f.tid = w.tid GROUP BY w.tid)",
        f"st AS MATERIALIZED (SELECT {read}, count(*) AS n_all, max(score) AS top FROM e GROUP BY ALL), sb AS MATERIALIZED (SELECT e.sample_id, e.read_no, count(*) FILTER (WHERE score = top) AS n_top, coalesce(max(CASE WHEN score < top AND n_all <= {k} THEN score END), 0) AS below FROM e JOIN st USING ({read}) GROUP BY ALL)",
        f"bt AS MATERIALIZED (SELECT b.*, n_top, below FROM b JOIN sb ON b.sample_id = sb.sample_id AND b.read_no = sb.read_no)",
        f"r0 AS MATERIALIZED (SELECT *, len(path) AS plen, first_value(len(path)) OVER (PARTITION BY {read} ORDER BY ord) AS turns FROM (SELECT {read}, {id_} AS uid, bt.tid, score, hit_len, n_top AS n, n_top, below, 0 AS lvl, false AS moved, coalesce(path, []) AS path, row_number() OVER (PARTITION BY {read} ORDER BY bt.tid, {id_}) AS ord FROM bt LEFT JOIN slots ON slots.tid = bt.tid))",
    ]
    for r in range(last + 1):
        go = f"n > {k} AND {r} <= turns"
        lifted = f"{go} AND lvl < {r}"
        out += [
            # entries lifted to the turn, with the parent they wait for
            f"p{r} AS MATERIALIZED (SELECT *, CASE WHEN {go} AND lvl = {r} THEN CASE WHEN {r + 1} < plen THEN path[{r + 2}] ELSE {taxonomy.ROOT} END ELSE 0 END AS par FROM (SELECT * REPLACE (CASE WHEN {lifted} AND {r} < plen THEN path[{r + 1}] ELSE tid END AS tid, moved OR ({lifted} AND {r} < plen) AS moved, CASE WHEN {lifted} THEN CASE WHEN {r} < plen THEN {r} ELSE 999 END ELSE lvl END AS lvl) FROM r{r}))",
            # parents whose entries are merged: those reached while more than k entries are left
            f"t{r} AS MATERIALIZED (SELECT {read}, g FROM (SELECT *, n - coalesce(sum(m - 1) OVER (PARTITION BY {read} ORDER BY c DESC, g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT g.sample_id, g.read_no, g.g, any_value(g.c) AS c, any_value(g.n) AS n, count(*) AS m FROM (SELECT {read}, par AS g, count(*) AS c, any_value(n) AS n FROM p{r} WHERE par <> 0 GROUP BY ALL) g JOIN p{r} p ON p.sample_id = g.sample_id AND p.read_no = g.read_no AND (p.par = g.g OR p.tid = g.g) GROUP BY ALL)) WHERE before > {k})",
            f"r{r + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {read}) AS n FROM (SELECT {read}, uid, coalesce(to_, tid) AS tid, score, hit_len, CASE WHEN par = to_ THEN {r + 1} ELSE lvl END AS lvl, moved OR coalesce(par = to_, false) AS moved, path, ord, plen, turns, n_top, below FROM (SELECT p.*, coalesce(x.g, y.g) AS to_ FROM p{r} p LEFT JOIN t{r} x ON x.sample_id = p.sample_id AND x.read_no = p.read_no AND x.g = p.par LEFT JOIN t{r} y ON y.sample_id = p.sample_id AND y.read_no = p.read_no AND y.g = p.tid) QUALIFY row_number() OVER (PARTITION BY {read}, coalesce(to_, -ord) ORDER BY ord) = 1))",
        ]
    done = f"r{last + 1}"
    out.append(
        f"sel AS MATERIALIZED (SELECT {read}, CASE WHEN NOT moved AND n <= {k} THEN uid END AS unique_id, CASE WHEN n <= {k} THEN tid ELSE 0 END AS tid, CASE WHEN n <= {k} THEN score ELSE 0 END AS score, CASE WHEN n <= {k} THEN hit_len ELSE 0 END AS hit_len,"
        f" CASE WHEN n BETWEEN 2 AND {k} THEN score WHEN n_top = 1 THEN below ELSE 0 END AS second, CASE WHEN n <= {k} THEN n ELSE 1 END AS n_matches, moved OR n > {k} AS moved FROM {done} QUALIFY n <= {k} OR row_number() OVER (PARTITION BY {read} ORDER BY ord) = 1)"
    )
    return ", ".join(out)


ENT = f"{HITS}, {_entries()}"
SEL = f"WITH RECURSIVE {TREE}, {ENT}, {_selected(5)}"
#: A read's greatest possible score, and the ids of the reads that reach it.
FULL = "mx AS (SELECT sample_id, read_no, m * greatest(0, n / m - 15) * greatest(0, n / m - 15) AS most FROM (SELECT sample_id, read_no, max(query_length) AS n, CASE WHEN max(mate) = 2 THEN 2 ELSE 1 END AS m FROM hit_count WHERE score IS NOT NULL GROUP BY ALL)), full_ AS (SELECT sel.* FROM sel JOIN mx USING (sample_id, read_no) WHERE score >= most OR (tid = 0 AND moved))"
LCA = f"""bp AS (SELECT sample_id, read_no, b.tid, w.path FROM b LEFT JOIN w ON w.tid = b.tid WHERE b.tid <> 0),
        anc AS (SELECT sample_id, read_no, tid, unnest(string_split(coalesce(path, '{taxonomy.ROOT}'), '/')) AS a, unnest(range(0, len(string_split(coalesce(path, '{taxonomy.ROOT}'), '/')))) AS dep FROM bp),
        cnt AS (SELECT sample_id, read_no, a, max(dep) AS dep, count(DISTINCT tid) AS n FROM anc GROUP BY 1, 2, 3), tot AS (SELECT sample_id, read_no, count(DISTINCT tid) AS n FROM bp GROUP BY 1, 2),
        lca AS (SELECT tot.sample_id, tot.read_no, coalesce(arg_max(CAST(cnt.a AS BIGINT), cnt.dep), {taxonomy.ROOT}) AS lca FROM tot LEFT JOIN cnt ON cnt.sample_id = tot.sample_id AND cnt.read_no = tot.read_no AND cnt.n = tot.n GROUP BY 1, 2)"""


def _clades(own: str) -> str:
    return f"""own AS ({own}), op AS (SELECT own.tid, n, coalesce(w.path, '{taxonomy.ROOT}') AS path FROM own LEFT JOIN w ON w.tid = own.tid),
        fl AS (SELECT n, CAST(unnest(string_split(path, '/')) AS BIGINT) AS anc, CAST(string_split(path, '/')[-1] AS BIGINT) AS node FROM op),
        clades AS (SELECT anc AS tid, sum(n) AS clade, sum(CASE WHEN anc = node THEN n ELSE 0 END) AS own FROM fl GROUP BY 1)"""


SIZES = "sizes AS (SELECT tid, CAST(sum(length(bases)) AS BIGINT) AS size FROM reft WHERE tid IS NOT NULL GROUP BY 1)"
CODE = "CASE {r} " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in dna.RANK_CODES.items()) + " ELSE '-' END"
AC = "upper(trim(ac))"
CONV = f"conv AS (SELECT {AC} AS uid, arg_min(taxid, map_id) AS tid FROM ac_to_taxid WHERE ac IS NOT NULL AND taxid IS NOT NULL AND {AC} IN (SELECT {AC} FROM ac_to_pos) GROUP BY 1)"
LEAFROWS = """lf AS (SELECT DISTINCT tid AS leaf FROM hits WHERE tid <> 0), lp AS (SELECT DISTINCT cl.tid AS leaf, anc_tid FROM cl JOIN lf ON lf.leaf = cl.tid),
        ec AS (SELECT ids, count(*) AS n FROM (SELECT list_sort(list(tid)) AS ids FROM full_ GROUP BY sample_id, read_no) GROUP BY 1), ex AS (SELECT ids, n, unnest(ids) AS id FROM ec),
        er AS (SELECT DISTINCT ids, n, leaf FROM ex JOIN lp ON lp.anc_tid = ex.id), len AS (SELECT er.*, coalesce(size, 18446744073709551615.0) AS size FROM er LEFT JOIN sizes ON sizes.tid = er.leaf),
        d0 AS (SELECT leaf, sum(n / m / size) AS d FROM (SELECT *, count(*) OVER (PARTITION BY ids) AS m FROM len) GROUP BY 1), q0 AS (SELECT leaf, d / sum(d) OVER () AS p FROM d0),
        d1 AS (SELECT leaf, sum(n * p / tot / size) AS d FROM (SELECT len.*, p, sum(p) OVER (PARTITION BY ids) AS tot FROM len JOIN q0 USING (leaf)) GROUP BY 1), q1 AS (SELECT leaf, d / sum(d) OVER () AS p FROM d1)"""
SHARES = "tr AS (SELECT tax_id AS tid, coalesce(sum(n_reads), 0) AS n FROM read_counts WHERE tax_id IS NOT NULL GROUP BY 1), tx AS (SELECT tid, n / sum(n) OVER () AS x FROM tr), ca AS (SELECT tid, count(*) AS n FROM sel WHERE tid <> 0 GROUP BY 1), cx AS (SELECT tid, n / sum(n) OVER () AS x FROM ca)"


def oracle_sql() -> dict[str, str]:
    code = "CAST(list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split({}, ''), lambda c: CAST(instr('ACGT', c) - 1 AS HUGEINT))), lambda a, c: a * 4 + c) AS BIGINT)"
    k31 = _kmers("refs", "ref_id", "bases", 31)
    spectrum = " UNION ALL ".join(f"SELECT {k} AS k, count(DISTINCT kmer) AS n_distinct, count(*) AS n_total FROM ({_kmers('refs', 'ref_id', 'bases', k)})" for k in range(1, 7))
    frag = "sp AS (SELECT ref_id, string_split_regex(bases, '[^ACGT]') AS a FROM refs), fr AS (SELECT ref_id, a[i] AS bases, i, CAST(coalesce(list_sum(list_transform(a[1 : i - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS ref_off FROM (SELECT ref_id, a, unnest(range(1, len(a) + 1)) AS i FROM sp))"
    shared = f"""km AS ({k31}), sh AS (SELECT kmer FROM km GROUP BY 1 HAVING count(DISTINCT ident) > 1), at_ AS (SELECT DISTINCT ident, pos FROM km JOIN sh USING (kmer)),
        fz AS (SELECT ident, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY ident ORDER BY pos) <= 31 THEN 0 ELSE 1 END AS fresh FROM at_), rz AS (SELECT *, sum(fresh) OVER (PARTITION BY ident ORDER BY pos) AS r FROM fz),
        cov AS (SELECT ident AS ref_id, min(pos) AS start, max(pos) + 31 AS stop FROM rz GROUP BY ident, r UNION ALL SELECT ref_id, length(bases), length(bases) FROM refs),
        gap AS (SELECT ref_id, coalesce(lag(stop) OVER (PARTITION BY ref_id ORDER BY start, stop), 0) AS f, start FROM cov)"""
    rank_pairs = f"pr AS (SELECT tax_rank, tx.x AS a, cx.x AS b FROM tx JOIN cx USING (tid) JOIN lines USING (tid))"
    ex = f"WITH RECURSIVE {TREE}, {HITS}, bad AS (SELECT tid FROM cl WHERE anc_tid = {EXCLUDED} UNION SELECT {EXCLUDED}), kept AS (SELECT * FROM hits WHERE tid NOT IN (SELECT tid FROM bad)), {_entries('kept')}"
    host = f"WITH RECURSIVE {TREE}, {ENT}, hs AS (SELECT tid FROM cl WHERE anc_tid = {HOST} UNION SELECT {HOST}), bh AS (SELECT *, tid IN (SELECT tid FROM hs) AS is_host FROM b)"
    lca_clades = f"WITH RECURSIVE {TREE}, {ENT}, {LCA}, {_clades('SELECT lca AS tid, count(*) AS n FROM lca GROUP BY 1')}"
    truth = "truth AS (SELECT sample_id, read_no, arg_min(coalesce(tax_id, 0), hit_id) AS tid FROM hit_count GROUP BY 1, 2)"
    return {
        "seed_join": f"{_seed_cte()} SELECT read_id, ref_id, fw, count(*) AS n_seeds FROM m GROUP BY 1, 2, 3",
        "seed_runs": f"{_seed_cte()} SELECT * FROM runs",
        "hit_score": f"{_seed_cte()} SELECT * FROM scores",
        "occurrence_cap": f"{_seed_cte(2)} SELECT * FROM scores",
        "revcomp": f"WITH {REFS} SELECT ref_id, {RC.format('''regexp_replace(bases, '[^ACGT]', 'N', 'g')''')} AS rc FROM refs",
        "n_filter": f"WITH {REFS}, {READS} SELECT read_id, length(seq) - length(regexp_replace(seq, '[^ACGT]', '', 'g')) AS n_ambiguous, length(seq) - length(regexp_replace(seq, '[^ACGT]', '', 'g')) <= floor(0.15 * length(seq)) AS passes FROM reads",
        "trim_reads": f"WITH {REFS}, {READS} SELECT read_id, substr(seq, 8, greatest(0, length(seq) - 12)) AS seq FROM reads",
        "kmer_encode": f"WITH k AS (SELECT DISTINCT genome_id, kmer, coalesce(regexp_full_match(upper(kmer), '[ACGT]{{1,62}}'), false) AS good FROM local_kmer) SELECT genome_id, kmer, CASE WHEN good THEN {code.format('substr(upper(kmer), 1, 31)')} END AS code_1, CASE WHEN good AND length(kmer) > 31 THEN {code.format('substr(upper(kmer), 32)')} END AS code_2 FROM k",
        "pair_filters": f"""WITH {REFS}, {READS}, x AS (SELECT *, read_id % {WINDOWS} AS w, length(regexp_replace(seq, '[ACGT]', '', 'g')) AS n, length(seq) AS l FROM reads)
            SELECT a.read_id, a.n <= floor(0.15 * a.l) AND a.l >= 2 AND a.read_id % 3 <> 0 AS passes, coalesce(b.n <= floor(0.15 * b.l) AND b.l >= 2, false) AS passes2, a.n + coalesce(b.n, 0) <= floor(0.15 * (a.l + coalesce(b.l, 0))) AS passes_together
            FROM x a LEFT JOIN x b ON b.ref_id = a.ref_id AND b.w = a.w + 1 WHERE a.w % 2 = 0""",
        "inspect_names": f"WITH {REFS} SELECT coalesce(uid, CAST(ref_id AS VARCHAR)) AS name FROM reft",
        "cleaned_records": f"WITH {REFS}, t AS (SELECT ref_id, concat_ws(' ', CASE WHEN coalesce(tid, 0) >> 32 = 0 THEN CAST(coalesce(tid, 0) AS VARCHAR) ELSE (tid & 4294967295) || '.' || (tid >> 32) END, uid) AS header, replace(bases, 'N', '') AS t FROM reft) SELECT ref_id, header, i AS line_no, substr(t, i * 80 + 1, 80) AS line FROM (SELECT *, unnest(range(0, CAST(ceil(length(t) / 80) AS BIGINT))) AS i FROM t WHERE t <> '')",
        "size_override": f"WITH {REFS}, {SIZES} SELECT tid, CASE WHEN tid % 3 = 0 THEN size * 10 ELSE size END AS size FROM sizes",
        "kreport_counts": f"""WITH RECURSIVE {TREE}, rows_ AS (SELECT tax_id, batch_id, max(n_reads) AS c FROM read_counts WHERE n_reads IS NOT NULL AND tax_id IS NOT NULL GROUP BY ALL), {_clades('SELECT tax_id AS tid, arg_max(c, batch_id) AS n FROM rows_ GROUP BY 1')}
            SELECT tid, CAST(clade AS BIGINT) AS clade, CAST(own AS BIGINT) AS own, round(100 * clade / (SELECT sum(c) FROM rows_), 4) AS pct FROM clades""",
        "rank_kendall": f"""{SEL}, {SHARES}, {rank_pairs}, z AS (SELECT *, row_number() OVER () AS i FROM pr), s AS (SELECT x.tax_rank, sum(sign(x.a - y.a) * sign(x.b - y.b)) AS s, sum(abs(sign(x.a - y.a))) AS ta, sum(abs(sign(x.b - y.b))) AS tb FROM z x JOIN z y ON x.tax_rank = y.tax_rank AND x.i < y.i GROUP BY 1)
            SELECT r.tax_rank, CASE WHEN ta > 0 AND tb > 0 THEN round(s / sqrt(CAST(ta AS DOUBLE) * CAST(tb AS DOUBLE)), 6) END AS tau_b FROM (SELECT DISTINCT tax_rank FROM pr) r LEFT JOIN s USING (tax_rank)""",
        "read_id_clean": "SELECT pos_id, regexp_extract(regexp_replace(header, '^>', ''), '^([^\\s|]*(?:\\|[^\\s|]*)?)', 1) AS uid, regexp_replace(regexp_extract(regexp_replace(header, '^>', '') || '/1', '^(\\S*)', 1), '/[123]$', '') AS name FROM ac_to_pos",
        "phred": "SELECT pos_id, chr(CAST(33 + seq_len % 41 AS INT)) AS from64, chr(CAST(33 + seq_len % 41 AS INT)) AS fromint FROM ac_to_pos WHERE seq_len IS NOT NULL",
        "packed_taxids": "SELECT DISTINCT tid, CASE WHEN tid >> 32 = 0 THEN CAST(tid AS VARCHAR) ELSE (tid & 4294967295) || '.' || (tid >> 32) END AS shown, tid AS back FROM taxonomy_node WHERE tid IS NOT NULL",
        "rank_names": f"SELECT rank, {CODE.format(r='rank')} AS code, {SLOT.format(r='rank')} AS slot, count(*) AS n FROM (SELECT {RANK} AS rank FROM taxonomy_node) GROUP BY 1",
        "skip_upto": "SELECT hit_id, read_no FROM hit_count WHERE read_no >= 10 AND read_no < 500",
        "sample_reads": "SELECT DISTINCT sample_id, read_no FROM hit_count WHERE (read_no * 7919 + sample_id * 104729) % 100 < 20",
        "continuous_windows": f"WITH {REFS} SELECT coalesce(uid, 'r' || ref_id) || '_' || i AS name, regexp_replace(substr(bases, i + 1, 60), '[^ACGT]', 'N', 'g') AS seq FROM (SELECT uid, ref_id, bases, unnest(range(0, length(bases) - 59, 45)) AS i FROM reft WHERE length(bases) >= 60)",
        "fasta_fragments": f"WITH {REFS}, {frag} SELECT ref_id, row_number() OVER (PARTITION BY ref_id ORDER BY ref_off) - 1 AS frag_no, ref_off, bases FROM fr WHERE length(bases) > 0",
        "inspect_fasta": f"WITH {REFS} SELECT ref_id, i AS line_no, substr(b, i * 60 + 1, 60) AS line FROM (SELECT ref_id, b, unnest(range(0, greatest(1, CAST(ceil(length(b) / 60) AS BIGINT)))) AS i FROM (SELECT ref_id, regexp_replace(bases, '[^ACGT]', 'N', 'g') AS b FROM refs))",
        "inspect_summary": f"WITH {REFS} SELECT 'seed_length' AS key, '{seeds.SEED}' AS value UNION ALL SELECT 'sequences', CAST(count(*) AS VARCHAR) FROM refs UNION ALL SELECT 'bases', CAST(CAST(sum(length(bases)) AS BIGINT) AS VARCHAR) FROM refs UNION ALL SELECT 'sequence ' || coalesce(uid, CAST(ref_id AS VARCHAR)), CAST(length(bases) AS VARCHAR) FROM reft",
        "inspect_tree": f"WITH {LINES}, f AS (SELECT tid, coalesce(parent_tid, 0) AS p, tax_rank FROM lines) SELECT (CASE WHEN tid >> 32 = 0 THEN CAST(tid AS VARCHAR) ELSE (tid & 4294967295) || '.' || (tid >> 32) END) || '\t|\t' || (CASE WHEN p >> 32 = 0 THEN CAST(p AS VARCHAR) ELSE (p & 4294967295) || '.' || (p >> 32) END) || '\t|\t' || tax_rank AS line FROM f",
        "conversion_table": f"WITH {CONV} SELECT * FROM conv",
        "genome_sizes": f"WITH {REFS}, {SIZES} SELECT * FROM sizes",
        "kmer_spectrum": f"WITH {REFS} {spectrum}",
        "distinct_kmers_exact": f"WITH {REFS} SELECT count(DISTINCT kmer) AS n_kmers FROM ({k31})",
        "taxon_kmers": f"WITH {REFS} SELECT tid, count(DISTINCT kmer) AS n_kmers FROM ({k31}) k JOIN reft ON reft.ref_id = k.ident WHERE tid IS NOT NULL GROUP BY 1",
        "species_groups": f"""WITH RECURSIVE {TREE}, {REFS}, g AS (SELECT cl.tid, arg_min(cl.anc_tid, distance) AS a FROM cl JOIN lines ON lines.tid = cl.anc_tid WHERE tax_rank = 'species' GROUP BY 1), x AS (SELECT coalesce(g.a, reft.tid) AS species, length(bases) AS n FROM reft LEFT JOIN g ON g.tid = reft.tid WHERE reft.tid IS NOT NULL)
            SELECT species, 'cid|' || CASE WHEN species >> 32 = 0 THEN CAST(species AS VARCHAR) ELSE (species & 4294967295) || '.' || (species >> 32) END AS header, count(*) AS n_genomes, CAST(sum(n) AS BIGINT) // count(*) AS mean_size, max(n) AS longest, CAST(sum(n) AS BIGINT) // count(*) > 2000 AS is_large FROM x GROUP BY 1""",
        "classification_rank": f"""WITH RECURSIVE {TREE}, {HITS}, rs AS (SELECT tid AS anc_tid, {SLOT.format(r="tax_rank")} AS slot FROM lines), up AS (SELECT cl.tid, cl.anc_tid, distance, slot FROM cl JOIN rs USING (anc_tid) WHERE slot >= 2),
            f AS (SELECT tid, slot, arg_min(anc_tid, distance) AS a FROM up GROUP BY 1, 2), g AS (SELECT tid, arg_min(a, slot) AS a FROM f GROUP BY 1), kept AS (SELECT hits.* REPLACE (coalesce(g.a, hits.tid) AS tid) FROM hits LEFT JOIN g ON g.tid = hits.tid), {_entries('kept')} SELECT sample_id, read_no, tid, score FROM b""",
        "score_filter": f"{SEL} SELECT sample_id, read_no, tid, score FROM sel WHERE score >= 5000 AND hit_len >= 60",
        "one_strand": f"{_seed_cte()} SELECT read_id, ref_id, count(*) AS n_seeds FROM m WHERE NOT fw GROUP BY 1, 2",
        "genome_sim_pairs": f"WITH {REFS}, km AS (SELECT DISTINCT ident, kmer FROM ({k31})) SELECT a.ident AS a, b.ident AS b, count(*) AS n FROM km a JOIN km b ON a.kmer = b.kmer AND a.ident < b.ident GROUP BY 1, 2",
        "nonshared_regions": f"WITH {REFS}, {shared} SELECT ref_id, f AS start, start - f AS length FROM gap WHERE start - f >= 1",
        "sequences_by_taxon": f"WITH {CONV} SELECT pos_id, tid AS taxid, file_pos FROM ac_to_pos p JOIN conv ON conv.uid = upper(trim(p.ac))",
        "finalised_entries": f"WITH {ENT} SELECT sample_id, read_no, tid, score, round(hit_len, 3) AS hit_len FROM e",
        "best_ties": f"WITH {ENT} SELECT sample_id, read_no, tid, score FROM b",
        "topk_assign": f"{SEL} SELECT sample_id, read_no, tid, score, n_matches FROM sel",
        "all_assign": f"WITH {ENT} SELECT sample_id, read_no, tid, score, count(*) OVER (PARTITION BY sample_id, read_no) AS n_matches FROM b",
        "no_traverse": f"WITH {ENT}, c AS (SELECT *, count(*) OVER (PARTITION BY sample_id, read_no) AS c FROM b) SELECT sample_id, read_no, tid, score, 1 AS n_matches FROM c WHERE c = 1 UNION ALL SELECT DISTINCT sample_id, read_no, 0, 0, 1 FROM c WHERE c > 1",
        "second_best": f"WITH {ENT}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, read_no ORDER BY score DESC, tid) AS n FROM e) SELECT sample_id, read_no, max(score) AS best, coalesce(max(CASE WHEN n = 2 THEN score END), 0) AS second FROM r GROUP BY 1, 2",
        "num_matches": f"{SEL} SELECT DISTINCT sample_id, read_no, n_matches FROM sel",
        "exclude_taxa": f"{ex} SELECT sample_id, read_no, tid, score FROM b",
        "host_taxa": f"{host} SELECT sample_id, read_no, tid, score, is_host FROM bh QUALIFY is_host OR NOT bool_or(is_host) OVER (PARTITION BY sample_id, read_no)",
        "seqid_display": f"WITH {LINES}, {HITS} SELECT DISTINCT h.unique_id, h.tid, CASE WHEN h.tid = 0 THEN 'unclassified' WHEN coalesce(l.leaf, true) THEN coalesce(p.ac, l.tax_rank, 'no rank') ELSE l.tax_rank END AS seq_id FROM hits h LEFT JOIN lines l ON l.tid = h.tid LEFT JOIN ac_to_pos p ON p.pos_id = h.unique_id",
        "classified_split": f"{SEL}, y AS (SELECT DISTINCT sample_id, read_no FROM sel WHERE tid <> 0), r AS (SELECT DISTINCT sample_id, read_no FROM hit_count) SELECT r.sample_id, r.read_no, y.read_no IS NOT NULL AS classified FROM r LEFT JOIN y ON y.sample_id = r.sample_id AND y.read_no = r.read_no",
        "output_table": f"""WITH RECURSIVE {TREE}, {HITS}, {_entries(key="unique_id, tid")}, {_selected(5, uid=True)}, q AS (SELECT sample_id, read_no, max(query_length) AS ql FROM hit_count WHERE score IS NOT NULL GROUP BY ALL)
            SELECT sel.sample_id || '_' || sel.read_no AS "readID", CASE WHEN sel.tid = 0 THEN 'unclassified' WHEN coalesce(leaf, true) THEN coalesce(ac, tax_rank, 'no rank') ELSE tax_rank END AS "seqID", sel.tid AS "taxID", score, second AS "2ndBestScore", round(hit_len, 3) AS "hitLength", ql AS "queryLength", n_matches AS "numMatches"
            FROM sel JOIN q USING (sample_id, read_no) LEFT JOIN lines ON lines.tid = sel.tid LEFT JOIN ac_to_pos ON pos_id = sel.unique_id""",
        "finalised_sequences": f"WITH {HITS}, {_entries(key='unique_id, tid')} SELECT sample_id, read_no, unique_id, tid, score, round(hit_len, 3) AS hit_len FROM e",
        "bounded_rollup": f"WITH RECURSIVE {TREE}, {ENT}, {_selected(1)} SELECT sample_id, read_no, tid, round(hit_len, 3) AS hit_len FROM sel",
        "rollup_to_two": f"WITH RECURSIVE {TREE}, {ENT}, {_selected(2)} SELECT sample_id, read_no, tid, score, round(hit_len, 3) AS hit_len, second, n_matches, moved FROM sel",
        "host_selection": f"""WITH RECURSIVE {TREE}, {ENT}, {_selected(1)}, hs AS (SELECT tid FROM cl WHERE anc_tid = {HOST} UNION SELECT {HOST}), hb AS (SELECT b.*, count(*) OVER (PARTITION BY sample_id, read_no) AS c FROM b WHERE tid IN (SELECT tid FROM hs)),
            hl AS (SELECT e.sample_id, e.read_no, max(e.score) AS s FROM e JOIN st USING (sample_id, read_no) WHERE e.score < top AND tid IN (SELECT tid FROM hs) GROUP BY ALL)
            SELECT sample_id, read_no, tid, score, second, n_matches FROM sel ANTI JOIN hb USING (sample_id, read_no)
            UNION ALL SELECT sample_id, read_no, tid, score, CASE WHEN c > 1 THEN score ELSE coalesce(hl.s, 0) END, 1 FROM (SELECT * FROM hb QUALIFY row_number() OVER (PARTITION BY sample_id, read_no ORDER BY {_mixed("sample_id", "read_no", "tid", seed=7)}, tid) = 1) LEFT JOIN hl USING (sample_id, read_no)""",
        "random_assign": f"WITH {ENT} SELECT sample_id, read_no, tid, score FROM e QUALIFY row_number() OVER (PARTITION BY sample_id, read_no ORDER BY {_mixed('sample_id', 'read_no', 'tid')}, tid) <= 2",
        "unclassified_rows": f"{SEL}, r AS (SELECT DISTINCT sample_id, read_no FROM hit_count) SELECT r.sample_id, r.read_no, coalesce(tid, 0) AS tid, coalesce(score, 0) AS score, coalesce(n_matches, 1) AS n_matches FROM r LEFT JOIN sel USING (sample_id, read_no)",
        "tax_closure": f"WITH RECURSIVE {TREE} SELECT tid, anc_tid, distance FROM cl",
        "tax_path": f"""WITH RECURSIVE {TREE}, rs AS (SELECT tid AS anc_tid, {SLOT.format(r="tax_rank")} AS slot FROM lines), up AS (SELECT cl.tid, cl.anc_tid, distance, CASE WHEN distance = 0 AND slot IS NULL THEN 0 ELSE slot END AS slot FROM cl JOIN rs USING (anc_tid)),
            f AS (SELECT tid, slot, arg_min(anc_tid, distance) AS a FROM up WHERE slot IS NOT NULL GROUP BY 1, 2) SELECT w.tid, {" || ',' || ".join(f"coalesce(max(CASE WHEN slot = {s} THEN a END), 0)" for s in range(dna.SLOT_COUNT))} AS slots FROM w LEFT JOIN f ON f.tid = w.tid GROUP BY w.tid""",
        "genus_of": f"WITH RECURSIVE {TREE}, g AS (SELECT cl.tid, arg_min(cl.anc_tid, distance) AS a FROM cl JOIN lines ON lines.tid = cl.anc_tid WHERE tax_rank = 'genus' GROUP BY 1) SELECT w.tid, coalesce(g.a, 0) AS anc_tid FROM w LEFT JOIN g ON g.tid = w.tid",
        "pruned_tree": f"WITH RECURSIVE {TREE}, r AS (SELECT DISTINCT tid FROM genome_seq WHERE tid IS NOT NULL) SELECT l.tid, l.parent_tid, l.tid IN (SELECT tid FROM r) AS leaf FROM lines l WHERE l.tid IN (SELECT anc_tid FROM cl WHERE tid IN (SELECT tid FROM r))",
        "lca_reads": f"WITH RECURSIVE {TREE}, {ENT}, {LCA} SELECT sample_id, read_no, lca FROM lca",
        "promote_rank": f"{SEL}, g AS (SELECT cl.tid, arg_min(cl.anc_tid, distance) AS a FROM cl JOIN lines ON lines.tid = cl.anc_tid WHERE tax_rank = 'genus' GROUP BY 1), p AS (SELECT DISTINCT sample_id, read_no, coalesce(g.a, sel.tid) AS tid FROM sel LEFT JOIN g ON g.tid = sel.tid) SELECT *, count(*) OVER (PARTITION BY sample_id, read_no) AS n_matches FROM p",
        "mean_genome_size": f"""WITH RECURSIVE {TREE}, {REFS}, {SIZES}, rs AS (SELECT tid, {SLOT.format(r="tax_rank")} AS slot FROM lines), low AS (SELECT s.tid, s.size FROM sizes s LEFT JOIN rs ON rs.tid = s.tid WHERE slot IS NULL OR slot = 0),
            mean AS (SELECT cl.anc_tid AS tid, CAST(sum(low.size) AS BIGINT) // count(*) AS m FROM cl JOIN low ON low.tid = cl.tid JOIN rs ON rs.tid = cl.anc_tid WHERE rs.slot BETWEEN 1 AND 6 GROUP BY 1) SELECT coalesce(mean.tid, sizes.tid) AS tid, coalesce(m, size) AS size FROM sizes FULL JOIN mean ON mean.tid = sizes.tid""",
        "clade_rollup": f"WITH RECURSIVE {TREE}, {_clades('SELECT tax_id AS tid, sum(n_reads) AS n FROM (SELECT DISTINCT * FROM read_counts WHERE tax_id IS NOT NULL AND n_reads IS NOT NULL) GROUP BY 1')} SELECT tid, CAST(clade AS BIGINT) AS clade, CAST(own AS BIGINT) AS own FROM clades",
        "taxon_report": f"""{SEL}, {REFS}, {SIZES}, c AS (SELECT tid, count(*) AS n, count(*) FILTER (WHERE n_matches = 1) AS u FROM sel WHERE tid <> 0 GROUP BY 1)
            SELECT CASE WHEN c.tid >> 32 = 0 THEN CAST(c.tid AS VARCHAR) ELSE (c.tid & 4294967295) || '.' || (c.tid >> 32) END AS name, c.tid AS "taxID", CASE WHEN coalesce(tax_rank, 'no rank') = 'no rank' AND leaf THEN 'leaf' ELSE coalesce(tax_rank, 'no rank') END AS "taxRank", coalesce(size, 0) AS "genomeSize", n AS "numReads", u AS "numUniqueReads"
            FROM c LEFT JOIN lines ON lines.tid = c.tid LEFT JOIN sizes ON sizes.tid = c.tid""",
        "taxon_weights": f"{SEL} SELECT tid, count(*) AS n_reads, count(*) FILTER (WHERE n_matches = 1) AS n_unique_reads, round(sum(1 / n_matches), 6) AS weighted_reads, count(*) AS sum_score, round(sum(hit_len), 3) AS summed_hit_len FROM sel GROUP BY 1",
        "batch_totals": "SELECT tax_id, CAST(sum(n_reads) AS BIGINT) AS n_reads, CAST(sum(sum_score) AS BIGINT) AS sum_score, round(sum(weighted_reads), 3) AS weighted_reads, CAST(sum(n_unique_reads) AS BIGINT) AS n_unique_reads FROM (SELECT DISTINCT * FROM read_counts) GROUP BY 1",
        "kreport_lca": f"{lca_clades} SELECT tid, CAST(clade AS BIGINT) AS clade, CAST(own AS BIGINT) AS own FROM clades",
        "kreport_fraction": f"{SEL}, {_clades('SELECT tid, sum(1 / n_matches) AS n FROM sel WHERE tid <> 0 GROUP BY 1')} SELECT tid, round(clade, 6) AS clade, round(own, 6) AS own FROM clades",
        "kreport_text": f"""{lca_clades} SELECT round(100 * clade / (SELECT sum(own) FROM clades), 2) AS pct, CAST(clade AS BIGINT) AS clade, CAST(clades.own AS BIGINT) AS own, {CODE.format(r="tax_rank")} AS rank_code, clades.tid, repeat('  ', w.depth) || CASE WHEN clades.tid >> 32 = 0 THEN CAST(clades.tid AS VARCHAR) ELSE (clades.tid & 4294967295) || '.' || (clades.tid >> 32) END AS label
            FROM clades JOIN w ON w.tid = clades.tid LEFT JOIN lines ON lines.tid = clades.tid""",
        "score_report": f"{SEL}, {REFS}, {SIZES}, s AS (SELECT tid, CAST(sum(score) AS BIGINT) AS score FROM sel WHERE tid <> 0 GROUP BY 1) SELECT s.tid, s.score, round(s.score / size, 6) AS per_base FROM s LEFT JOIN sizes ON sizes.tid = s.tid",
        "equiv_classes": f"{SEL}, {FULL} SELECT ids, count(*) AS n FROM (SELECT array_to_string(list_sort(list(tid)), ',') AS ids FROM full_ GROUP BY sample_id, read_no) GROUP BY 1",
        "em_step": f"{SEL}, {FULL}, {REFS}, {SIZES}, {LEAFROWS} SELECT leaf AS tid, round(q0.p, 8) AS p0, round(q1.p, 8) AS p1 FROM q0 JOIN q1 USING (leaf)",
        "accuracy": f"""{SEL}, {truth}, a AS (SELECT sel.sample_id, sel.read_no, bool_or(sel.tid = truth.tid) AS hit, count(*) AS n FROM sel JOIN truth USING (sample_id, read_no) WHERE sel.tid <> 0 GROUP BY 1, 2)
            SELECT (SELECT count(*) FROM truth) AS n_reads, count(*) AS n_classified, count(*) FILTER (WHERE hit) AS n_right, count(*) FILTER (WHERE hit AND n = 1) AS n_unique_right, round(count(*) FILTER (WHERE hit) / (SELECT count(*) FROM truth), 6) AS sensitivity, round(count(*) FILTER (WHERE hit) / count(*), 6) AS precision FROM a""",
        "abundance_ssr": f"{SEL}, {SHARES} SELECT round(sum(pow(tx.x - coalesce(cx.x, 0), 2)), 9) AS ssr, count(*) AS n_taxa FROM tx LEFT JOIN cx ON cx.tid = tx.tid",
        "rank_corr": f"""{SEL}, {SHARES}, {rank_pairs}, rk AS (SELECT *, rank() OVER (PARTITION BY tax_rank ORDER BY a) + (count(*) OVER (PARTITION BY tax_rank, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY tax_rank ORDER BY b) + (count(*) OVER (PARTITION BY tax_rank, b) - 1) / 2 AS rb FROM pr)
            SELECT tax_rank, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM rk GROUP BY 1 HAVING count(*) > 2""",
        "stream_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    }

"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxonflow.llm import bitsketch, leakage, overlap, packing, spans, stuffing, topn
from taxonflow.session import cut_lineage, table


def _valid_kmer():
    k = F.upper("kmer")
    return F.when(k.rlike("^[ACGT]+$"), k)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.sharing_pairs(table(spark, d, "local_kmer"), "genome_id", _valid_kmer(), 0.08)
    return pairs.select(F.col("a").alias("genome_a"), F.col("b").alias("genome_b"))


def p1_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of genomes: estimated shared k-mers, both differences and the standard error."""
    est = overlap.overlaps(overlap.sketches(overlap.members(table(spark, d, "local_kmer"), "genome_id", _valid_kmer())))
    return est.select(F.col("a").alias("genome_a"), F.col("b").alias("genome_b"), "shared", (F.col("n_a") - F.col("shared")).alias("only_a"), (F.col("n_b") - F.col("shared")).alias("only_b"), "std_error")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "hit_count"), ["sample_id", "read_no"], "unique_id", "score", 5).select("sample_id", "read_no", "unique_id")


def p5_ranked(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "hit_count"), ["sample_id", "read_no"], "unique_id", "score", 5)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    runs = spans.shared_runs(table(spark, d, "genome_seq"), "seq_id", "bases")
    return runs.select(F.col("rec").alias("seq_id"), F.col("start").alias("pos"), F.col("length").alias("fw_length"))


def p6_shared_share(spark: SparkSession, d: str) -> DataFrame:
    share = spans.shared_share(table(spark, d, "genome_seq"), "seq_id", "bases")
    return share.select(F.col("rec").alias("seq_id"), "n_letters", "n_shared", F.round("share", 6).alias("share"))


def _kmer_sketch(spark: SparkSession, d: str) -> DataFrame:
    return bitsketch.build(table(spark, d, "species_kmer"), ["seen_day", "tax_id", "sample_id"], "kmer_hash")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    days = ["seen_day", "tax_id"]
    est = bitsketch.estimate(bitsketch.build(table(spark, d, "species_kmer"), days, "kmer_hash"), days)
    return est.where("n_distinct >= 200 and seen_day is not null and tax_id is not null").select(F.date_format("seen_day", "yyyy-MM-dd").alias("seen_day"), "tax_id")


def _named_sets(base: DataFrame, member: str, name: str, n: int) -> DataFrame:
    """(set_id, member): the values of a group column in n sets, by their remainder."""
    return base.select(F.col(member).alias("member")).where("member is not null").distinct().select(F.concat(F.lit(name + " "), (F.col("member") % n).cast("string")).alias("set_id"), "member")


def p7_combinations(spark: SparkSession, d: str, taxa: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """Counts per day, per taxon, per sample, per each combination of them, over everything, and over named sets of taxa and
    of samples (set_id, member), all merged from one stored sketch. The name of a set stands in the column of its members."""
    base = cut_lineage(_kmer_sketch(spark, d))
    keys = ("seen_day", "tax_id", "sample_id")
    sets = {"tax_id": _named_sets(base, "tax_id", "taxa", 8) if taxa is None else taxa, "sample_id": _named_sets(base, "sample_id", "samples", 4) if samples is None else samples}

    def shown(sketch: DataFrame, groups: list[str], grouping: str) -> DataFrame:
        est = bitsketch.estimate(sketch, groups)
        cols = [F.col(c).cast("string").alias(c) if c in groups else F.lit(None).cast("string").alias(c) for c in keys]
        return est.select(F.lit(grouping).alias("grouping"), *cols, "n_distinct", "std_error", "lower", "upper")

    out = None
    for groups in ([list(g) for n in (1, 2, 3) for g in combinations(keys, n)] + [[]]):
        part = shown(bitsketch.merge(base, groups), groups, "+".join(groups) or "all")
        out = part if out is None else out.unionByName(part)
    for member, named in sets.items():
        out = out.unionByName(shown(bitsketch.united(base, member, named).withColumnRenamed("set_id", member), [member], f"{member} set"))
    return out


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return packing.packed(packing.token_counts(docs), docs.count())


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_packing(spark, d))


def p8_validity(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed, and what is wrong with the packing: nothing."""
    counts = cut_lineage(packing.token_counts(table(spark, d, "documents")))
    return packing.validity(counts, packing.packed(counts, counts.count()))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_longest_runs(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed(table(spark, d, "documents"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """The share of stuffing and its autocorrelation, of every document with any."""
    return stuffing.scores(table(spark, d, "documents")).select("doc_id", F.round("share", 6).alias("share"), F.round("correlation", 6).alias("correlation"), "listed")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_overlaps, p5_found, p5_ranked, p6_found, p6_shared_share, p7_found, p7_combinations, p8_packing, p8_fill, p8_validity, p9_found, p9_longest_runs, p10_found, p10_scores)}


def oracle_sql() -> dict[str, str]:
    best = """SELECT sample_id, read_no, unique_id, score, row_number() OVER (PARTITION BY sample_id, read_no ORDER BY score DESC, unique_id) AS rank
        FROM (SELECT sample_id, read_no, unique_id, max(score) AS score FROM hit_count WHERE score IS NOT NULL AND unique_id IS NOT NULL GROUP BY 1, 2, 3) QUALIFY rank <= 5"""
    runs = """g AS (SELECT seq_id, max(upper(bases)) AS b FROM genome_seq WHERE seq_id IS NOT NULL AND bases IS NOT NULL GROUP BY 1),
        w AS (SELECT seq_id, i, substr(b, i + 1, 100) AS s FROM (SELECT seq_id, b, unnest(range(0, length(b) - 99)) AS i FROM g WHERE length(b) >= 100)),
        v AS (SELECT * FROM w WHERE regexp_full_match(s, '[ACGT]+')), m AS (SELECT s FROM v GROUP BY 1 HAVING count(DISTINCT seq_id) > 1),
        h AS (SELECT seq_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY seq_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM v JOIN m USING (s)),
        run AS (SELECT seq_id, i, sum(fresh) OVER (PARTITION BY seq_id ORDER BY i) AS r FROM h)"""
    return {
        "p1_found": """WITH k AS (SELECT DISTINCT genome_id AS g, upper(kmer) AS k FROM local_kmer WHERE genome_id IS NOT NULL AND regexp_full_match(upper(kmer), '[ACGT]+')),
            s AS (SELECT g, count(*) AS n FROM k GROUP BY 1), p AS (SELECT a.g AS ga, b.g AS gb, count(*) AS n FROM k a JOIN k b ON a.k = b.k AND a.g < b.g GROUP BY 1, 2)
            SELECT ga AS genome_a, gb AS genome_b FROM p JOIN s x ON x.g = ga JOIN s y ON y.g = gb WHERE p.n >= 0.08 * least(x.n, y.n)""",
        "p5_found": f"SELECT sample_id, read_no, unique_id FROM ({best})",
        "p5_ranked": best,
        "p7_found": "SELECT strftime(seen_day, '%Y-%m-%d') AS seen_day, tax_id FROM species_kmer WHERE seen_day IS NOT NULL AND tax_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT kmer_hash) >= 200",
        "p6_found": f"WITH {runs} SELECT seq_id, min(i) AS pos, max(i) + 100 - min(i) AS fw_length FROM run GROUP BY seq_id, r",
        "p6_shared_share": f"""WITH {runs}, l AS (SELECT seq_id, max(i) + 100 - min(i) AS n FROM run GROUP BY seq_id, r), t AS (SELECT seq_id, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY 1)
            SELECT g.seq_id, length(g.b) AS n_letters, coalesce(t.n, 0) AS n_shared, round(coalesce(t.n, 0) / length(g.b), 6) AS share FROM g LEFT JOIN t ON t.seq_id = g.seq_id""",
        "p8_validity": "SELECT count(*) AS n_documents, 0 AS n_wrong_tokens, 0 AS n_cut_early, 0 AS n_overfull, 0 AS n_gaps FROM documents",
        "p9_longest_runs": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), e AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
            dw AS (SELECT doc_id, i, array_to_string(w[i : i + 24], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 23)) AS i FROM d WHERE len(w) >= 25)),
            ew AS (SELECT item_id, i AS j, array_to_string(w[i : i + 24], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 23)) AS i FROM e WHERE len(w) >= 25)),
            m AS (SELECT doc_id, item_id, i, i - j AS diagonal FROM dw JOIN ew USING (s)), r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) AS island FROM m),
            n AS (SELECT doc_id, item_id, count(*) + 24 AS n_words FROM r GROUP BY doc_id, item_id, diagonal, island) SELECT doc_id, item_id, max(n_words) AS n_words FROM n GROUP BY 1, 2""",
        "p9_found": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), e AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
            dw AS (SELECT doc_id, array_to_string(w[i : i + 24], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 23)) AS i FROM d WHERE len(w) >= 25)),
            ew AS (SELECT item_id, array_to_string(w[i : i + 24], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 23)) AS i FROM e WHERE len(w) >= 25))
            SELECT DISTINCT doc_id, item_id FROM dw JOIN ew ON dw.s = ew.s""",
    }

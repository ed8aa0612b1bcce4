"""Readers and sinks on small files, and streams."""

import gzip

import pytest
from pyspark.sql import functions as F

from taxonflow.functions import dna
from taxonflow.operators import index, seeds
from taxonflow.sources import readers, sinks
from taxonflow.streaming import streams


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def _rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("rdid").collect()]


def test_fasta(spark, tmp_path):
    p = _write(tmp_path, "a.fa", ">r1 first\nACGT\nacgn\n;comment\n>\nGG\n>empty\n>r4\nA-C.T\n")
    assert _rows(readers.fasta(spark, p), "rdid", "name", "seq") == [(0, "r1 first", "ACGTACGN"), (1, "1", "GG"), (2, "empty", ""), (3, "r4", "ACNT")]
    assert readers.fasta(spark, p).first()["qual"] == "IIIIIIII"
    gz = tmp_path / "b.fa.gz"
    gz.write_bytes(gzip.compress(b">x\nAC\n"))
    assert _rows(readers.read(spark, str(gz), "fasta"), "name", "seq") == [("x", "AC")]


def test_fastq_pairs_and_interleaved(spark, tmp_path):
    one = _write(tmp_path, "1.fq", "@a/1\nAC.T\n+\nIIII\n@\nGG\n+x\nII\n")
    two = _write(tmp_path, "2.fq", "@a/2\nTTTT\n+\nIIII\n@b/2\nCC\n+\nII\n")
    assert _rows(readers.fastq(spark, one), "rdid", "name", "seq", "qual") == [(0, "a/1", "ACNT", "IIII"), (1, "1", "GG", "II")]
    pair = readers.paired(readers.fastq(spark, one), readers.fastq(spark, two))
    assert _rows(pair, "seq", "seq2") == [("ACNT", "TTTT"), ("GG", "CC")]
    both = _write(tmp_path, "i.fq", "@a/1\nAC\n+\nII\n@a/2\nGT\n+\nII\n")
    assert _rows(readers.interleaved(readers.fastq(spark, both)), "seq", "seq2") == [("AC", "GT")]
    with pytest.raises(ValueError):
        readers.paired(readers.fastq(spark, one), readers.fastq(spark, both).limit(1))
    m = readers.mixed([readers.fastq(spark, one), readers.fastq(spark, two)])
    assert sorted({r["file_idx"] for r in m.collect()}) == [0, 1]


def test_other_formats(spark, tmp_path):
    t = _write(tmp_path, "t.tab", "a\tAC\tII\nb\tAC\tII\tGT\tJJ\nc\tAC\tII\td\tGG\tKK\n")
    assert _rows(readers.read(spark, t, "tab6"), "name", "seq", "name2", "seq2", "qual2") == [("a", "AC", None, None, None), ("b", "AC", "b", "GT", "JJ"), ("c", "AC", "d", "GG", "KK")]
    q = _write(tmp_path, "q.txt", "M\t1\t2\t3\t4\t5\t0\t1\tAC.T\tIIII\t1\nshort\tline\n")
    assert _rows(readers.qseq(spark, q), "name", "seq", "filter") == [("M_1_2_3_4_5_0/1", "ACNT", "1")]
    r = _write(tmp_path, "r.txt", "ACGT\n\nGG\n")
    assert _rows(readers.raw(spark, r), "name", "seq") == [("0", "ACGT"), ("1", "GG")]
    assert _rows(readers.literal(spark, ["ACG:JJJ", "TT"]), "seq", "qual") == [("ACG", "JJJ"), ("TT", "II")]
    f = _write(tmp_path, "f.fa", ">chr1 x\nACGTRACGTA\n")
    assert [(r["name"], r["seq"]) for r in readers.read(spark, f, "fasta_cont", length=4, every=3).collect()] == [("chr1_0", "ACGT"), ("chr1_3", "TNAC"), ("chr1_6", "CGTA")]
    with pytest.raises(ValueError):
        readers.read(spark, f, "bam")


def test_tables_of_the_index(spark, tmp_path):
    n = _write(tmp_path, "nodes.dmp", "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tspecies\t|\n2\t|\t9\t|\tgenus\t|\n")
    assert [(r["tid"], r["parent_tid"], r["tax_rank"]) for r in readers.nodes(spark, n).orderBy("line_no").collect()] == [(1, 1, "no rank"), (2, 1, "species"), (2, 9, "genus")]
    m = _write(tmp_path, "names.dmp", "1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\told\t|\t\t|\tscientific name\t|\n2\t|\tnew\t|\t\t|\tscientific name\t|\n2\t|\tsyn\t|\t\t|\tsynonym\t|\n")
    assert {r["tid"]: r["name"] for r in readers.names(spark, m).collect()} == {1: "root", 2: "new"}
    c = _write(tmp_path, "conv.tsv", "# comment\na\t5\nb  7.2\na\t6\n")
    assert {r["uid"]: r["tid"] for r in readers.conversion(spark, c).collect()} == {"a": 5, "b": 7 + 2 * 2**32}
    s = _write(tmp_path, "sizes.tsv", "5\t100\n")
    assert readers.size_table(spark, s).first()["size"] == 100
    a = _write(tmp_path, "acc.tsv", "accession\taccession.version\ttaxid\tgi\nA\tA.1\t3\t0\nB\tB.1\t4\t0\n")
    assert [tuple(r) for r in readers.accession_map(spark, a, spark.createDataFrame([("B.1",)], "ac string")).collect()] == [("B.1", 4)]
    asm = spark.createDataFrame([("latest", "Complete Genome", "na", 1), ("replaced", "Complete Genome", "na", 1), ("latest", "Contig", "na", 2)], "version_status string, assembly_level string, refseq_category string, taxid long")
    assert readers.assemblies(asm, level="Complete Genome", taxids=[1]).count() == 1


def test_sample_sheet(spark, tmp_path):
    one, two = _write(tmp_path, "1.fq", "@a\nAC\n+\nII\n"), _write(tmp_path, "2.fq", "@a\nGT\n+\nII\n")
    sheet = readers.sample_sheet(spark, _write(tmp_path, "s.tsv", f"1\t{one}\t\to1\tr1\n2\t{one}\t{two}\to2\tr2\n"))
    assert [r["type"] for r in sheet] == [2, 1]
    assert {(r["sample_id"], r["seq2"]) for r in readers.samples(spark, sheet).collect()} == {(0, "GT"), (1, None)}
    with pytest.raises(ValueError):
        readers.sample_sheet(spark, _write(tmp_path, "b.tsv", f"3\t{one}\t\to\tr\n"))


def test_sinks_round_trip(spark, tmp_path):
    a = spark.createDataFrame([("r1", "s", 5, 10, 0, 30.0, 100, 1), ("r2", "unclassified", 0, 0, 0, 0.0, 100, 1)], "readID string, seqID string, taxID long, score long, `2ndBestScore` long, hitLength double, queryLength long, numMatches long")
    out = str(tmp_path / "out")
    sinks.write_assignments(a, out, include_unclassified=False)
    back = spark.read.option("sep", "\t").option("header", True).csv(out)
    assert back.columns == sinks.DEFAULT_COLUMNS and back.count() == 1
    sam = sinks.projected(a.withColumn("readSeq", F.lit("A")).withColumn("readQual", F.lit("I")), sinks.SAM_COLUMNS).first()
    assert (sam["RNAME"], sam["CIGAR"], sam["TLEN"], sam["FLAG"]) == (5, "*", 100, 0)
    with pytest.raises(ValueError):
        sinks.projected(a, ["nothing"])
    watched, o = sinks.observed(a)
    watched.count()
    watched.collect()
    assert o.get["rows"] == 2 and o.get["unclassified"] == 1
    reads = spark.createDataFrame([("r1", "ACGT", "IIII")], "name string, seq string, qual string")
    sinks.write_reads(reads, str(tmp_path / "fq"), "fastq", "gzip")
    assert _rows(readers.fastq(spark, str(tmp_path / "fq")), "name", "seq", "qual") == [("r1", "ACGT", "IIII")]
    sinks.write_index({"t": reads}, str(tmp_path / "idx"))
    assert sinks.read_index(spark, str(tmp_path / "idx"), ["t"])["t"].count() == 1
    sinks.write_tree_report(spark.createDataFrame([(50.0, 1, 1, "S", 7, "  7", "a")], "pct double, clade long, own long, rank_code string, tid long, label string, sort_key string"), str(tmp_path / "k"))
    sinks.append_results(reads, str(tmp_path / "runs"))
    sinks.append_results(reads, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_functions(spark):
    r = spark.createDataFrame([("ACGTRn", ">gi|4|emb|X 1", "r/1 x", "@h")], "s string, h string, n string, q string").select(
        dna.cleaned(F.col("s")).alias("c"), dna.reverse_complement(dna.cleaned(F.col("s"))).alias("rc"), dna.header_uid(F.col("h")).alias("u"), dna.read_name(F.col("n")).alias("n"),
        dna.trimmed(F.col("s"), 4, 4).alias("t"), dna.phred33(F.col("q"), "solexa").alias("sol"), dna.bounded_function("S", 1, 2, F.lit(9)).alias("f"), dna.kmer_code(F.lit("ACGT")).alias("k"),
    ).first()
    assert tuple(r) == ("ACGTNN", "NNACGT", "gi|4", "r", "", "$I", 7.0, 27)
    with pytest.raises(ValueError):
        dna.phred33(F.col("q"), "other")
    assert dna.packed_kmers("ACGNACG", 3)[0].tolist() == [0, 4] and dna.packed_kmers("AC", 3)[0].tolist() == []


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    reads = spark.createDataFrame([(1, "ACGTTGCATCGATTAGCCATTGCATTAC"), (2, "AAAA")], "read_id long, seq string")
    reads.write.parquet(str(src))
    refs = spark.createDataFrame([(9, "TTACGTTGCATCGATTAGCCATTGCATTACGG")], "ref_id long, bases string")
    s = streams.source(spark, str(src), "read_id long, seq string")
    got = streams.run_once(streams.matched(s, "read_id", "seq", seeds.index(refs, "ref_id", "bases")), "matched", "append", str(tmp_path / "c1"))
    assert {r["read_id"] for r in got.collect()} == {1}
    counts = streams.run_once(streams.running_counts(streams.source(spark, str(src), "read_id long, seq string"), "read_id"), "counted", "complete", str(tmp_path / "c2"))
    assert {(r["read_id"], r["n"]) for r in counts.collect()} == {(1, 1), (2, 1)}
    seen = []
    streams.for_each_batch(streams.source(spark, str(src), "read_id long, seq string"), lambda df, n: seen.append(df.count()), str(tmp_path / "c3")).awaitTermination()
    assert sum(seen) == 2
    ev = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "t string, k string").select(F.to_timestamp("t").alias("t"), "k")
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    w = streams.windowed_counts(streams.source(spark, str(tmp_path / "ev"), "t timestamp, k string"), "t", "k")
    assert {(r["k"], r["n"]) for r in streams.run_once(w, "windowed", "update", str(tmp_path / "c4")).collect()} == {("a", 2), ("b", 1)}


def test_fragments_with_ambiguous_letters(spark):
    refs = spark.createDataFrame([(1, "NNACGNTT", "u", 5), (2, "", None, None), (3, "NN", None, 2)], "ref_id long, bases string, uid string, tid long")
    assert sorted((r["ref_id"], r["frag_no"], r["ref_off"], r["bases"]) for r in index.fragments(refs).collect()) == [(1, 0, 2, "ACG"), (1, 1, 6, "TT")]
    assert [r["bases"] for r in index.fragments(refs, n_to_a=True).where("ref_id = 1").collect()] == ["AAACGATT"]
    assert index.last_name_wins(spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "t long, n string, o long"), "t", "n", "o").first()["name"] == "b"

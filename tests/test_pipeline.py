"""Read files to assignment table and reports, and the read filters."""

import pytest
from pyspark.sql import functions as F

from taxonflow.operators import assign, filters
from taxonflow.plans import pipeline
from taxonflow.sources import readers

# A published worked example of two short genomes, its reads and the assignments they must get.
GENOMES = {
    "gi|4|emb|X17276.1| Giant Panda satellite 1 DNA": (
        "GGACGCTCTGCTTTGTTACCAATGAGAAGGGCGCTGAATCCTCGAAAATCCTGACCCTTTTAATTCATGCTCCCTTACTCACGAGAGATGATGATCGTTG"
        "ATATTTCCCTGGACTGTGTGGGGTCTCAGAGACCACTATGGGGCACTCTCGTCAGGCTTCGATCCTCCCCAGGCCCCTACACCCAATGTGGAACCGGGGT"
        "CCCGAATGAAAATGCTGCTGTTCCCTGGAGGTGTTTTCCTCGCGACCACGTTCCCTCATGTTTCCCTATTAACGAAGGGTGATGATAGTGCTAAGACGGT"
        "CCCTGTACGGTGTTGTTTCTGACAGACGTGTTTTGGGCCTTTTCGTTCCATTGCCGCCAGCAGTTTTGACAGGATTTCCCCAGGGAGCAAACTTTTCGAT"
        "GGAAACGGGTTTTGGCCGAATTGTCTTTCTCAGTGCTGTGTTCGTCGTGTTTCACTCACGGTACCAAAACACCTTGATTATTGTTCCACCCTCCATAAGG"
        "CCGTCGTGACTTCAAGGGCTTTCCCCTCAAACTTTGTTTCTTGGTTCTACGGGCTG"
    ),
    "gi|7|emb|X51700.1| Bos taurus mRNA for bone Gla protein": (
        "GTCCACGCAGCCGCTGACAGACACACCATGAGAACCCCCATGCTGCTCGCCCTGCTGGCCCTGGCCACACTCTGCCTCGCTGGCCGGGCAGATGCAAAGC"
        "CTGGTGATGCAGAGTCGGGCAAAGGCGCAGCCTTCGTGTCCAAGCAGGAGGGCAGCGAGGGATCCTCCCCAGGCCCCTACACCCAATGTGGAACCGGGGT"
        "CCCGAATGAAAATGCTGCTGTTCCCTGGAGGTGTTTTCCTTGGTGAAGAGACTCAGGCGCTACCTGGACCACTGGCTGGGAGCCCCAGCCCCCTACCCAG"
        "ATCCGCTGGAGCCCAAGAGGGAGGTGTGTGAGCTCAACCCTGACTGTGACGAGCTAGCTGACCACATCGGCTTCCAGGAAGCCTATCGGCGCTTCTACGG"
        "CCCAGTCTAGAGCTTGCAGCCCTGCCCACCTGGCTGGCAGCCCCCAGCTCTGGCTTCTCTCCAGGACCCCTCCCCTCCCCGTCATCCCCGCTGCTCTAGA"
        "ATAAACTCCAGAAGAGG"
    ),
}
READS = {
    "GATCCTCCCCAGGCCCCTACACCCAATGTGGAACCGGGGTCCCGAATGAAAATGCTGCTGTTCCCTGGAGGTGTTTTCCT": ["C_1", "C_2", "C_3", "C_4"],
    "GGACGCTCTGCTTTGTTACCAATGAGAAGGGCGCTGAATCCTCGAAAATCCTGACCCTTTTAATTCATGCTCCCTTACTC": ["1_1"],
    "ACGAGAGATGATGATCGTTGATATTTCCCTGGACTGTGTGGGGTCTCAGAGACCACTATGGGGCACTCTCGTCAGGCTTC": ["1_2"],
    "TGGCCGGGCAGATGCAAAGCCTGGTGATGCAGAGTCGGGCAAAGGCGCAGCCTTCGTGTCCAAGCAGGAGGGCAGCGAGG": ["2_1", "2_2", "2_3", "2_4", "2_5", "2_6"],
}
TAXA = {"gi|4": 9646, "gi|7": 9913}
EXPECTED = {(r, s, TAXA[s], 4225, 4225, 80, 2) for r in ("C_1", "C_2", "C_3", "C_4") for s in TAXA}
EXPECTED |= {(r, "gi|4", 9646, 4225, 0, 80, 1) for r in ("1_1", "1_2")} | {(f"2_{i}", "gi|7", 9913, 4225, 0, 80, 1) for i in range(1, 7)}
NODES = "1\t|\t1\t|\tno rank\t|\n9645\t|\t1\t|\tfamily\t|\n9646\t|\t9645\t|\tspecies\t|\n9903\t|\t1\t|\tgenus\t|\n9913\t|\t9903\t|\tspecies\t|\n7\t|\t1\t|\tspecies\t|\n"
COLUMNS = ["readID", "seqID", "taxID", "score", "2ndBestScore", "hitLength", "numMatches"]


@pytest.fixture(scope="module")
def example(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("example")
    (at / "ref.fa").write_text("".join(f">{h}\n{s}\n" for h, s in GENOMES.items()))
    (at / "reads.fa").write_text("".join(f">{n}\n{s}\n" for s, names in READS.items() for n in names))
    (at / "map.txt").write_text("".join(f"{u}\t{t}\n" for u, t in TAXA.items()))
    (at / "nodes.dmp").write_text(NODES)
    refs = pipeline.sequences(readers.fasta(spark, str(at / "ref.fa")), readers.conversion(spark, str(at / "map.txt")))
    return at, pipeline.build(refs, readers.nodes(spark, str(at / "nodes.dmp")), size_table=spark.createDataFrame([(9646, 5000)], "tid long, size long"))


def test_worked_example(spark, example):
    at, index = example
    rows = pipeline.assignments(readers.read(spark, str(at / "reads.fa"), "fasta"), index)
    got = [tuple(r) for r in rows.select(*COLUMNS).collect()]
    assert len(got) == len(EXPECTED) == 16 and set(got) == EXPECTED
    assert {r["queryLength"] for r in rows.collect()} == {80}
    report = {r["taxID"]: r for r in pipeline.taxon_report(rows, index).collect()}
    assert (report[9646]["numReads"], report[9646]["numUniqueReads"], report[9646]["genomeSize"]) == (6, 2, 5000)
    assert (report[9913]["numReads"], report[9913]["numUniqueReads"], report[9913]["taxRank"]) == (10, 6, "species")
    assert abs(sum(r["abundance"] for r in report.values()) - 1) < 1e-9
    tree = {r["tid"]: (r["clade"], r["own"]) for r in pipeline.tree_report(rows, index).collect()}
    assert tree[1] == (12, 4) and tree[9646] == (2, 2) and tree[9903] == (6, 0) and 7 not in tree


def test_one_match_a_read_rolls_up_to_the_root(spark, example):
    at, index = example
    rows = pipeline.assignments(readers.read(spark, str(at / "reads.fa"), "fasta"), index, k=1).select(*COLUMNS).collect()
    assert {tuple(r) for r in rows if r["readID"][0] == "C"} == {(f"C_{i}", "no rank", 1, 4225, 0, 80, 1) for i in range(1, 5)}
    rows = pipeline.assignments(readers.read(spark, str(at / "reads.fa"), "fasta"), index, k=1, traverse=False).collect()
    assert {(r["seqID"], r["taxID"], r["score"]) for r in rows if r["readID"][0] == "C"} == {("unclassified", 0, 0)}
    rows = pipeline.assignments(readers.read(spark, str(at / "reads.fa"), "fasta"), index, k=1, host=[9903]).collect()
    assert {(r["seqID"], r["taxID"]) for r in rows if r["readID"][0] == "C"} == {("gi|7", 9913)}
    rows = pipeline.assignments(readers.read(spark, str(at / "reads.fa"), "fasta"), index, exclude=[9913]).collect()
    assert {(r["readID"][0], r["taxID"]) for r in rows} == {("C", 9646), ("1", 9646), ("2", 0)}


def test_filtered_reads_keep_their_row(spark, example):
    _, index = example
    seq = next(iter(READS))
    reads = spark.createDataFrame(
        [(0, "a", seq, seq[:40], "1", "0"), (1, "b", "N" * 60, seq, "1", "1"), (2, "c", "N" * 60, "A", "1", "1"), (3, "d", None, None, None, None), (4, "e", seq, "", "0", "1")],
        "rdid long, name string, seq string, seq2 string, filter string, filter2 string",
    )
    got = {r["readID"]: (r["taxID"] > 0, r["max_score"], r["queryLength"]) for r in pipeline.assignments(reads, index, qc=True).collect()}
    assert got == {"a": (True, 4225, 120), "b": (True, 4225, 140), "c": (False, 0, 61), "d": (False, 0, 0), "e": (False, 0, 80)}
    assert pipeline.assignments(reads.limit(0), index).count() == 0


def test_pair_filters(spark):
    df = spark.createDataFrame([("ACGT" * 5, "NNNN"), ("N" * 20, "A" * 200), ("A", "AC"), (None, "AC"), ("ACGTNN", None)], "seq string, seq2 string")
    m = [(r["passes"], r["passes2"]) for r in filters.marked(df).collect()]
    assert m == [(True, False), (False, True), (False, True), (False, True), (False, False)]
    together = [(r["passes"], r["passes2"]) for r in filters.marked(df, together=True).collect()]
    assert together == [(False, False), (True, True), (False, True), (False, True), (False, False)]


def test_rollup_of_many_reads_equals_that_of_each(spark):
    import random

    rng = random.Random(11)
    paths = {t: [t if rng.random() < 0.5 else 0, *[(s + 1) * 100 + t // (2 ** (s + 1)) if rng.random() < 0.8 else 0 for s in range(9)]] for t in range(1, 40)}
    rows = [(i % 3, i, None, t, 50, float(t)) for i in range(60) for t in rng.sample([*paths, 98, 99], rng.randint(1, 12))]
    entries = spark.createDataFrame(rows, "sample_id long, read_no long, unique_id long, tid long, score long, hit_len double")
    table = spark.createDataFrame(list(paths.items()), "tid long, slots array<long>")
    for k in (1, 2, 5):
        got = {}
        for r in assign.selected(entries, k, table).collect():
            got.setdefault((r["sample_id"], r["read_no"]), []).append((r["tid"], r["hit_len"], r["n_matches"]))
        for s, i in {r[:2] for r in rows}:
            e = [(t, h) for a, b, _, t, _, h in rows if (a, b) == (s, i)]
            want = assign.roll_up(paths, e, k) if len(e) > k else e
            want = [(0, 0.0)] if want is None else want
            assert sorted(got[s, i]) == sorted((t, h, len(want)) for t, h in want)
    assert assign.selected(entries.limit(0), 1, table).count() == 0
    lower = spark.createDataFrame([(0, 0, None, t, s, 1.0) for t, s in ((1, 9), (2, 7), (3, 5))], entries.schema)
    assert [r["second"] for r in assign.selected(lower, 3, table).collect()] == [7]
    assert [r["second"] for r in assign.selected(lower, 2, table).collect()] == [0]
    hosts = spark.createDataFrame([(3,), (2,)], "tid long")
    assert [(r["tid"], r["second"]) for r in assign.selected(lower.replace(5, 9, "score"), 1, table, hosts).collect()] == [(3, 7)]
    with pytest.raises(ValueError):
        assign.selected(lower, 2)

"""Exact classification, rollup, abundance and common ancestors against plain models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxonflow.functions import dna
from taxonflow.operators import abundance, assign, exact, hierarchy, redundancy, report, seeds, taxonomy
from taxonflow.plans import catalog


def _dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_perfect_reads_score_by_their_length(spark):
    """An 80-letter read of one genome scores (80 - 15)^2; one of both genomes gets both."""
    rng = random.Random(1)
    common = _dna(rng, 80)
    a, b = _dna(rng, 300) + common, common + _dna(rng, 300)
    rc = a[40:120][::-1].translate(str.maketrans("ACGT", "TGCA"))
    refs = spark.createDataFrame([(4, 9646, a), (7, 9913, b)], "ref_id long, tid long, bases string")
    reads = spark.createDataFrame([(1, a[10:90]), (2, b[200:280]), (3, common), (4, rc), (5, _dna(rng, 80)), (6, None), (7, ""), (8, "ACG"), (9, "N" * 80)], "read_id long, seq string")
    got = {}
    for r in exact.classify(reads, refs).collect():
        got.setdefault(r["read_id"], {})[r["tid"]] = (r["score"], r["hit_len"])
        assert r["max_score"] == 4225
    assert got == {1: {9646: (4225, 80)}, 2: {9913: (4225, 80)}, 3: {9646: (4225, 80), 9913: (4225, 80)}, 4: {9646: (4225, 80)}}
    only = exact.classify(reads, refs, exclude=[9646]).collect()
    assert {(r["read_id"], r["tid"]) for r in only} == {(2, 9913), (3, 9913)}
    assert exact.classify(reads, refs.limit(0)).count() == 0


@pytest.mark.parametrize("shard_letters", [150, 600, 10**6])
def test_references_beyond_one_index_give_the_same_rows(spark, monkeypatch, shard_letters):
    rng = random.Random(7)
    shared = [_dna(rng, n) for n in (30, 60, 90)]
    texts = [_dna(rng, rng.randint(0, 120)) + rng.choice(shared) + rng.choice(["", "N", "acgt"]) + _dna(rng, rng.randint(0, 120)) + rng.choice(shared) for _ in range(30)]
    refs = spark.createDataFrame([*[(100 + i, i % 7 if i % 9 else None, t) for i, t in enumerate([*texts, "", "AC", texts[0] + shared[1]])], (900, 1, None)], "ref_id long, tid long, bases string")
    reads = []
    for i in range(150):
        t = rng.choice(texts)
        at = rng.randint(0, max(0, len(t) - 40))
        r = list(t[at : at + rng.randint(12, 100)])
        for _ in range(rng.randint(0, 2)):
            r[rng.randrange(len(r))] = rng.choice("ACGTN")
        r = "".join(r)
        reads.append((i, r if rng.random() < 0.5 else r[::-1].translate(str.maketrans("ACGT", "TGCA")), rng.choice([None, _dna(rng, 50), rng.choice(texts)[:60]])))
    reads = spark.createDataFrame(reads, "read_id long, seq string, seq2 string")
    want = sorted(exact.classify(reads, refs, exclude=[3]).collect(), key=lambda r: r[:2])
    monkeypatch.setattr(exact, "MOST_LETTERS", 1)
    monkeypatch.setattr(exact, "SHARD_LETTERS", shard_letters)
    got = sorted(exact.classify(reads, refs, exclude=[3]).collect(), key=lambda r: r[:2])
    assert len(want) > 100 and got == want


def test_longest_match_equals_brute_force():
    rng = random.Random(2)
    texts = ["".join(rng.choice("AC") for _ in range(rng.randint(1, 80))) for _ in range(6)]
    ref = exact.Reference(list(range(6)), texts)
    for _ in range(200):
        p = "".join(rng.choice("AC") for _ in range(rng.randint(1, 14)))
        n, lo, hi = ref.longest(p.encode())
        want = max((k for k in range(len(p) + 1) if any(p[:k] in t[::-1] for t in texts)), default=0)
        assert n == want
        owners = sorted({int(x) for x in ref.owner[lo:hi]})
        assert owners == [i for i, t in enumerate(texts) if n and p[:n] in t[::-1]]


def test_reads_with_errors_and_paired_reads():
    rng = random.Random(3)
    g = [_dna(rng, 400) for _ in range(3)]
    ref = exact.Reference([0, 1, 2], g)
    wrong = g[1][50:90] + ("A" if g[1][90] != "A" else "C") + g[1][91:130]
    got, top = exact.classify_read(ref, [wrong])
    assert set(got) == {1} and 0 < got[1][0] < 65**2 and top == 65**2
    pair, top = exact.classify_read(ref, [g[2][:60], g[2][200:260][::-1].translate(str.maketrans("ACGT", "TGCA"))])
    assert pair == {2: (2 * 45**2, 120)} and top == 2 * 45**2


def test_roll_up_examples():
    # two species of genus 10, one of genus 20, both in family 30
    slots = {1: [1, 1, 10, 30], 2: [2, 2, 10, 30], 3: [3, 3, 20, 30]}
    e = [(1, 50.0), (2, 40.0), (3, 30.0)]
    assert assign.roll_up(slots, e, 3) == e
    assert assign.roll_up(slots, e, 2) == [(10, 50.0), (3, 30.0)]
    assert assign.roll_up(slots, e, 1) == [(30, 50.0)]
    assert assign.roll_up({1: [1], 2: [2]}, [(1, 5.0), (2, 4.0)], 1) == [(1, 5.0)]  # past both paths' ends lies the root, 1
    assert assign.roll_up({}, [(8, 1.0), (9, 2.0)], 1) == [(1, 1.0)]  # no path at all: the root is next
    # an empty slot is passed over: both meet in what comes after it, here the root
    assert assign.roll_up({1: [1, 0], 2: [2, 0]}, [(1, 1.0), (2, 1.0)], 1) == [(1, 1.0)]
    assert assign.roll_up({5: [5, 5, 0, 30], 6: [6, 6, 0, 30]}, [(5, 1.0), (6, 2.0)], 1) == [(30, 1.0)]


def test_abundance_solver_and_distributed_steps_agree(spark, monkeypatch):
    classes = [("a", 60.0, [0]), ("b", 30.0, [0, 1]), ("c", 10.0, [1, 2])]
    cls = np.array([i for i, (_, _, ls) in enumerate(classes) for _ in ls])
    leaf = np.array([x for _, _, ls in classes for x in ls])
    n = np.array([c for _, c, ls in classes for _ in ls])
    size = np.array([1000.0, 2000.0, 500.0])
    p, _ = abundance.solve(cls, n, leaf, size)
    assert abs(p.sum() - 1) < 1e-9
    q = p  # a fixed point of the plain step
    of = np.bincount(cls, weights=q[leaf])
    x = np.bincount(leaf, weights=(np.array([60.0, 30.0, 10.0]) / of)[cls] * q[leaf]) / size
    assert np.abs(x / x.sum() - q).sum() < 1e-6
    rows = spark.createDataFrame([(int(c), int(k), int(i)) for c, k, i in zip(cls, n, leaf)], "class long, n long, leaf long")
    lengths = spark.createDataFrame([(0, 1000), (1, 2000), (2, 500)], "leaf long, size long")
    near = {r["tid"]: r["abundance"] for r in abundance.abundances(rows, lengths).collect()}
    monkeypatch.setattr(abundance, "MOST_ROWS", 1)
    far = {r["tid"]: r["abundance"] for r in abundance.abundances(rows, lengths, steps_beyond=20).collect()}
    assert all(abs(near[i] - p[i]) < 1e-9 for i in range(3)) and all(abs(far[i] - p[i]) < 0.02 for i in range(3))
    assert abundance.abundances(rows.limit(0), lengths).count() == 0


def test_distributed_abundance_converges_where_most_reads_are_shared(spark, monkeypatch):
    """Plain steps need some 30,000 rounds here; the limit is 0.2 and 0.8."""
    rows = spark.createDataFrame([(1, 10, 0), (2, 40, 1), (3, 100_000, 0), (3, 100_000, 1)], "class long, n long, leaf long").coalesce(1)
    lengths = spark.createDataFrame([(0, 1000), (1, 1000)], "leaf long, size long").coalesce(1)
    near = {r["tid"]: r["abundance"] for r in abundance.abundances(rows, lengths).collect()}
    monkeypatch.setattr(abundance, "MOST_ROWS", 1)
    far = {r["tid"]: r["abundance"] for r in abundance.abundances(rows, lengths).collect()}
    assert all(abs(far[i] - near[i]) < 1e-6 and abs(far[i] - x) < 1e-4 for i, x in enumerate((0.2, 0.8)))
    with pytest.warns(RuntimeWarning, match="did not converge"):
        abundance.abundances(rows, lengths, steps_beyond=1)


def test_common_ancestors_and_unknown_taxa(spark):
    parent = {1: 1, 2: 1, 3: 2, 4: 2, 5: 1, 6: 3}
    nodes = spark.createDataFrame([(t, t, p, "no rank", False) for t, p in parent.items()], "line_no long, tid long, parent_tid long, tax_rank string, leaf boolean")
    resolved = hierarchy.resolve(hierarchy.links(hierarchy.valid_lines(nodes)))
    rows = spark.createDataFrame([(1, 6), (1, 4), (2, 6), (2, 3), (3, 6), (3, 5), (4, 6), (4, 99), (5, 6), (5, 0), (5, None), (6, 6), (6, 6)], "g long, tid long")
    got = {r["g"]: r["lca"] for r in taxonomy.common_ancestors(rows, ["g"], "tid", resolved).collect()}
    assert got == {1: 2, 2: 3, 3: 1, 4: 1, 5: 6, 6: 6}


def test_merge_order_and_complexity(spark):
    pairs = spark.createDataFrame([(1, 2, 100), (1, 3, 40), (2, 3, 5)], "a long, b long, n long")
    lengths = spark.createDataFrame([(1, 1000), (2, 900), (3, 800)], "ref_id long, length long")
    assert redundancy.merge_order(pairs, lengths) == [(1, 2, 100), (1, 3, 45)]
    assert redundancy.merge_order(pairs.limit(0), lengths) == []
    c = spark.createDataFrame([("A" * 40,), ("ACGTTGCATCGATTAGCCAT",), ("",)], "s string").select(redundancy.complexity(F.col("s")).alias("c")).collect()
    assert c[0]["c"] < 0.1 < 0.7 < c[1]["c"] and c[2]["c"] == 0


def test_seed_runs_find_planted_matches(spark):
    rng = random.Random(4)
    g = _dna(rng, 300)
    refs = spark.createDataFrame([(1, g), (2, None), (3, "")], "ref_id long, bases string")
    reads = spark.createDataFrame([(10, g[20:80]), (11, g[100:130] + "T" + g[131:170]), (12, None)], "read_id long, seq string")
    runs = seeds.maximal_matches(seeds.seed_matches(seeds.read_kmers(reads, "read_id", "seq"), seeds.index(refs, "ref_id", "bases"))).collect()
    got = {(r["read_id"], r["fw"], r["off"], r["ref_pos"], r["length"]) for r in runs}
    assert (10, True, 0, 20, 60) in got and all(r["ref_id"] == 1 for r in runs)


@pytest.mark.parametrize("name", ["hit_score", "one_strand", "seed_runs", "occurrence_cap", "seed_join"])
def test_seed_queries_send_no_kmers_through_the_driver(spark, data, name):
    """Spark takes the k-mers for as large as the compressed file, and broadcast them below its usual 10 MB."""
    plan = catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["seed_runs", "occurrence_cap"])
def test_seed_queries_that_ran_sent_no_kmers_through_the_driver(spark, data, name):
    """Nor once the sizes are known: all sides are far below 10 MB here."""
    df = catalog.queries()[name](spark, data)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("k, cap, strands", [(5, None, ("fw", "rc")), (6, None, ("fw", "rc")), (5, None, ("rc",)), (6, 3, ("fw", "rc")), (5, 2, ("fw",)), (7, 1, ("rc",))])
def test_runs_by_their_ends_are_the_merged_matches(spark, monkeypatch, k, cap, strands):
    """Every run of single matches: repeats, other letters, texts cut into pieces, k-mers that are their own complement."""
    monkeypatch.setattr(dna, "LETTERS_AT_ONCE", 16)
    monkeypatch.setattr(seeds, "SPAN", 8)
    rng = random.Random(21)
    own = "ACGCGT" * 4 + "N" + "GAATTC" * 2 + "AAAAAAAAAAAAAAA"
    refs = [(i, t) for i, t in enumerate([own, _dna(rng, 300), "ACG", "", None, own[3:40].lower() + "R" + _dna(rng, 60), "N" * 20, _dna(rng, 16), _dna(rng, 22)])]
    reads = [(2**40 + i, t) for i, t in enumerate([refs[1][1][40:140], own[5:], "TTTTTTTTT", None, "", "ACNGT" * 9, refs[5][1][::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca")), _dna(rng, 90), refs[1][1][100:160] + "N" + refs[1][1][161:180]])]
    g, r = spark.createDataFrame(refs, "g long, t string").coalesce(1), spark.createDataFrame(reads, "r long, s string").coalesce(1)
    got = [tuple(x) for x in seeds.runs(r, "r", "s", g, "g", "t", k, cap, strands).collect()]
    want = [tuple(x) for x in seeds.maximal_matches(seeds.seed_matches(seeds.read_kmers(r, "r", "s", k, strands), seeds.index(g, "g", "t", k, cap)), k).collect()]
    assert sorted(got) == sorted(want) and len(want) > 10


@pytest.mark.parametrize("n", [0, 40])
def test_correlations(spark, n):
    rng = random.Random(5)
    rows = [("x", rng.randint(0, 6) / 2, rng.randint(0, 6) / 2) for _ in range(n)]
    df = spark.createDataFrame(rows, "r string, a double, b double")
    got = report.correlations(df, "r").collect()
    assert len(got) == (n > 0)
    if n:
        a, b = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
        assert abs(got[0]["pearson"] - np.corrcoef(a, b)[0, 1]) < 1e-9
        assert abs(got[0]["spearman"] - np.corrcoef(rank(a), rank(b))[0, 1]) < 1e-9
        t = report.kendall(df, "r").first()["tau_b"]
        s = sum(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i in range(n) for j in range(i))
        ta, tb = (sum(v[i] != v[j] for i in range(n) for j in range(i)) for v in (a, b))
        assert abs(t - s / np.sqrt(ta * tb)) < 1e-9


def test_whole_kmers_are_encoded(spark, tmp_path):
    """Letters behind the 31st tell k-mers apart and make them none."""
    rng = random.Random(15)
    k = _dna(rng, 53)
    rows = [(1, k), (1, k), (1, k[:40] + ("A" if k[40] != "A" else "C") + k[41:]), (1, k[:52] + "N"), (1, k.lower()), (2, k[:31]), (2, k[:20]), (2, None), (2, "")]
    spark.createDataFrame(rows, "genome_id long, kmer string").write.parquet(f"{tmp_path}/local_kmer.parquet")
    number = lambda s: int("".join(str("ACGT".index(c)) for c in s.upper()), 4)
    want = {(g, t, *((number(t[:31]), number(t[31:]) if len(t) > 31 else None) if t and set(t.upper()) <= set("ACGT") else (None, None))) for g, t in rows}
    got = [tuple(r) for r in catalog.kmer_encode(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)


def test_whole_reads_are_whole(spark, tmp_path):
    """Every letter of every record is in one read, also of short records, and ids never meet."""
    rng = random.Random(16)
    texts = {1: _dna(rng, 250), 2: _dna(rng, 40), 3: _dna(rng, 100), 5: _dna(rng, 100_250), 6: _dna(rng, 99)}
    rows = [(i, f"u{i}", i, len(t), t) for i, t in texts.items()]
    spark.createDataFrame(rows, "seq_id long, uid string, tid long, seq_length long, bases string").write.parquet(f"{tmp_path}/genome_seq.parquet")
    reads = catalog.reads(spark, str(tmp_path)).collect()
    assert len({r["read_id"] for r in reads}) == len(reads)
    for i, t in texts.items():
        assert "".join(r["seq"] for r in sorted(reads, key=lambda r: r["read_id"]) if r["ref_id"] == i) == t
    own = {r["ref_id"]: r["read_id"] for r in reads}  # the last read of each record
    got = {(r["read_id"], r["ref_id"]): r["hit_len"] for r in catalog.exact_classification(spark, str(tmp_path)).collect()}
    scored = {(r["read_id"], r["ref_id"]): r["hit_len"] for r in catalog.hit_score(spark, str(tmp_path)).collect()}
    for i, t in texts.items():
        assert got[own[i], i] == scored[own[i], i] == (len(t) % 100 or 100)

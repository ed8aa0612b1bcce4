"""Overlap registers, distinct-count bit matrices and ranking, against exact sets."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxonflow.llm import bitsketch, overlap, registry, topn


def _sets(seed=1):
    rng = random.Random(seed)
    pool = list(range(10**6))
    big = set(rng.sample(pool, 20_000))
    small = set(rng.sample(sorted(big), 150)) | set(rng.sample(range(10**6, 2 * 10**6), 850))
    return {1: big, 2: small, 3: set(rng.sample(range(3 * 10**6, 4 * 10**6), 1000)), 4: set(rng.sample(sorted(small), 40)), 5: set(big)}


def _frame(spark, sets):
    rows = [(g, str(x)) for g, s in sets.items() for x in s] + [(1, None), (None, "7"), (4, str(min(sets[4])))]
    return spark.createDataFrame(rows, "g long, x string").withColumn("regs", F.lit(0)).withColumn("h", F.lit("z"))


def test_estimates_are_near_the_truth(spark):
    sets = _sets()
    est = overlap.overlaps(overlap.sketches(overlap.members(_frame(spark, sets), "g", F.col("x"))), block=2).collect()
    assert {(r["a"], r["b"]) for r in est} == set(itertools.combinations(sets, 2))
    for r in est:
        true = len(sets[r["a"]] & sets[r["b"]])
        assert abs(r["shared"] - true) <= 5 * r["std_error"] + 3, (r, true)
        assert abs(r["n_a"] - len(sets[r["a"]])) < 0.03 * len(sets[r["a"]]) + 3


@pytest.mark.parametrize("m", [1024, 65536])
def test_sharing_pairs_equal_exact_pairs(spark, m):
    """The line is crossed by exact look-up where the sketch leaves it open, so a small sketch gives the same pairs."""
    sets = _sets(2)
    want = {p for p in itertools.combinations(sets, 2) if len(sets[p[0]] & sets[p[1]]) >= 0.08 * min(len(sets[p[0]]), len(sets[p[1]]))}
    got = overlap.sharing_pairs(_frame(spark, sets), "g", F.col("x"), 0.08, m=m).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted(want)


def test_overlap_of_empty_and_single(spark):
    none = spark.createDataFrame([], "g long, x string")
    assert overlap.overlaps(overlap.sketches(overlap.members(none, "g", F.col("x")))).count() == 0
    one = spark.createDataFrame([(1, "a"), (1, "a")], "g long, x string")
    assert overlap.overlaps(overlap.sketches(overlap.members(one, "g", F.col("x")))).count() == 0
    assert overlap.sharing_pairs(one, "g", F.col("x"), 0.5).count() == 0


def test_joint_estimate_is_unbiased():
    rng = np.random.default_rng(4)
    m, n_a, n_b, x = 65536, 60_000, 2_000, 500
    got = []
    for _ in range(6):
        n = n_a + n_b - x
        reg, v = rng.integers(0, m, n), np.floor(-np.log2(rng.random(n)) * overlap.STEPS).astype(int) + 1
        a, b = np.zeros(m, int), np.zeros(m, int)
        np.maximum.at(a, reg[:n_a], v[:n_a])
        np.maximum.at(b, reg[n_a - x :], v[n_a - x :])
        one = lambda z: np.array([z])
        got.append(overlap.joint_estimate(one((a > b).sum()), one((a < b).sum()), one(((a == b) & (a > 0)).sum()), one(float(n_a)), one(float(n_b)))[0])
    assert abs(np.mean(got) - x) < 30


@pytest.mark.parametrize("n", [0, 1, 150, 2000, 60_000])
def test_distinct_counts_within_bounds(spark, n):
    ids = list(range(n)) * 2 + [None, None]
    df = spark.createDataFrame([(x, "g") for x in ids], "x long, row string").withColumn("_seen", F.lit(1))
    r = bitsketch.estimate(bitsketch.build(df, ["row"], "x"), ["row"]).first()
    assert r["row"] == "g" and abs(r["n_distinct"] - n) <= 5 * r["std_error"] + 1
    assert r["lower"] <= r["n_distinct"] <= r["upper"]


def test_merged_sketches_equal_direct_ones(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.choice([1, 2, None]), rng.choice("ab"), rng.randint(0, 900)) for _ in range(4000)], "d long, t string, x long")
    merged = bitsketch.merge(bitsketch.build(df, ["d", "t"], "x"), ["d"])
    direct = bitsketch.build(df, ["d"], "x")
    key = lambda r: (str(r["d"]), r["_row"], r["_bits"])
    assert sorted(map(key, merged.collect())) == sorted(map(key, direct.collect()))
    assert bitsketch.estimate(bitsketch.build(df.limit(0), ["d"], "x"), ["d"]).count() == 0
    with pytest.raises(ValueError):
        bitsketch.build(df, ["d"], "x", m=1000)


@pytest.mark.parametrize("salts", [1, 4, 64])
def test_top_n_equals_brute_force(spark, salts):
    rng = random.Random(salts)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice(["x", None]), rng.choice([None, *range(40)]), rng.choice([None, *range(6)])) for _ in range(1500)]
    df = spark.createDataFrame(rows + rows[:50], "g long, h string, item long, score long").withColumn("rank", F.lit(1)).withColumn("_item", F.lit(2))
    got = {}
    for r in topn.top_n(df, ["g", "h"], "item", "score", 5, salts).collect():
        got.setdefault((r["g"], r["h"]), {})[r["rank"]] = (r["item"], r["score"])
    best = {}
    for g, h, i, s in rows:
        if i is not None and s is not None:
            d = best.setdefault((g, h), {})
            d[i] = max(s, d.get(i, s))
    want = {k: dict(enumerate(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:5], 1)) for k, d in best.items()}
    assert got == want
    assert topn.top_n(df.limit(0), ["g", "h"], "item", "score", 5).count() == 0


def test_all_combinations_and_named_sets_are_counted(spark, tmp_path):
    rng = random.Random(9)
    rows = [(f"2024-01-0{rng.randint(1, 3)}", rng.choice([1, 2, 3, None]), rng.choice([5, 6, 7]), rng.randint(0, 60)) for _ in range(900)]
    df = spark.createDataFrame(rows, "seen_day string, tax_id long, sample_id long, kmer_hash long").withColumn("seen_day", F.to_date("seen_day"))
    df.write.parquet(f"{tmp_path}/species_kmer.parquet")
    taxa = spark.createDataFrame([("low", 1), ("low", 2), ("low", 2), ("both", 2), ("both", 3), ("none", 99)], "set_id string, member long")
    samples = spark.createDataFrame([("ends", 5), ("ends", 7)], "set_id string, member long")
    got = {tuple(r)[:4]: r["n_distinct"] for r in registry.p7_combinations(spark, str(tmp_path), taxa, samples).collect()}
    want = {}
    for day, t, s, k in rows:
        text = lambda x: None if x is None else str(x)
        for n in range(4):
            for g in itertools.combinations(range(3), n):
                key = ("+".join(("seen_day", "tax_id", "sample_id")[i] for i in g) or "all", *(text((day, t, s)[i]) if i in g else None for i in range(3)))
                want.setdefault(key, set()).add(k)
        for name, members in (("low", (1, 2)), ("both", (2, 3))):
            if t in members:
                want.setdefault(("tax_id set", None, name, None), set()).add(k)
        if s in (5, 7):
            want.setdefault(("sample_id set", None, None, "ends"), set()).add(k)
    assert set(got) == set(want) and all(abs(got[key] - len(x)) < 2 for key, x in want.items())

"""Skewed keys, orphan references and hierarchies against brute force, and their edge cases."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from taxonflow.operators import hierarchy, integrity, skew


def test_profile_with_hot_key_nulls_and_repeats(spark):
    rng = random.Random(3)
    rows = [(1, rng.randint(-50, 10**6)) for _ in range(600)] + [(rng.choice([2, 3, None]), rng.choice([None, -4, 0, 7, 7, 9])) for _ in range(300)]
    df = spark.createDataFrame(rows, "k long, v long").withColumn("weight", F.lit(9)).withColumn("key", F.lit("x"))
    got = {r["key"]: r for r in skew.profile(df, "k", "v", {"p50": 0.5, "p90": 0.9, "p0": 0.0, "p100": 1.0}).collect()}
    assert set(got) == {r[0] for r in rows}
    for key in got:
        all_ = [v for k, v in rows if k == key]
        vals = sorted(v for v in all_ if v is not None)
        disc = lambda s: vals[max(1, -(-int(s * len(vals) * 1000) // 1000)) - 1]
        assert got[key]["n_rows"] == len(all_) and got[key]["value_sum"] == sum(vals) and got[key]["n_distinct"] == len(set(vals))
        c = Counter(vals)
        assert got[key]["mode"] == min(v for v in c if c[v] == max(c.values()))
        assert (got[key]["p50"], got[key]["p90"], got[key]["p0"], got[key]["p100"]) == (disc(0.5), disc(0.9), vals[0], vals[-1])


def test_profile_of_empty_and_valueless(spark):
    assert skew.profile(spark.createDataFrame([], "k long, v long"), "k", "v", {"p": 0.5}).count() == 0
    r = skew.profile(spark.createDataFrame([(1, None)], "k long, v long"), "k", "v", {"p": 0.5}).first()
    assert (r["n_rows"], r["n_distinct"], r["mode"], r["p"]) == (1, 0, None, None)


def test_hot_keys_count_null_rows_in_the_whole(spark):
    df = spark.createDataFrame([(0, 1)] * 2 + [(None, 1)] * 97 + [(5, None)], "k long, v long")
    assert sorted(r[0] for r in skew.hot_keys(df, "k", "v", 0.01).collect()) == [0, 5]
    assert [r[0] for r in skew.hot_keys(df, "k", "v", 0.02).collect()] == [0]


def test_bucket_never_falls(spark):
    r = spark.range(-3000, 3000).select(skew.bucket_of(F.col("id")).alias("b")).collect()
    assert all(a["b"] <= b["b"] for a, b in zip(r, r[1:]))


@pytest.mark.parametrize("tasks", [1, 8, 10**6])
def test_orphans_in_time_equal_brute_force(spark, tasks):
    """No key, a few keys and all keys are heavy."""
    rng = random.Random(5)
    t0 = datetime(2024, 1, 30)
    at = lambda: None if rng.random() < 0.05 else t0 + timedelta(hours=rng.randint(0, 100))
    keys = ["HOT"] * 6 + [f"K{i}" for i in range(12)]
    spell = lambda k: rng.choice([k, k.lower(), f" {k}\t"])
    refs = [(i, spell(rng.choice(keys)) if rng.random() > 0.05 else None, at()) for i in range(300)]
    targets = [(spell(rng.choice(keys)), at(), at() if rng.random() < 0.5 else None) for _ in range(60)]
    r = spark.createDataFrame(refs, "id long, k string, t timestamp").withColumn("delta", F.lit(1))
    t = spark.createDataFrame(targets, "k string, s timestamp, e timestamp")
    key = integrity.normalised(F.col("k"))
    got = integrity.not_alive(integrity.references(r, key, "id", "t"), integrity.lifetimes(t, key, "s", "e"), tasks)
    norm = lambda x: x.strip().upper()
    want = {i for i, k, a in refs if k is not None and not any(x is not None and norm(x) == norm(k) and a is not None and s is not None and s <= a and (e is None or e > a) for x, s, e in targets)}
    assert sorted(x["row_id"] for x in got.collect()) == sorted(want)
    have = {norm(x) for x, _, _ in targets}
    plain = integrity.without_target(integrity.references(r, key, "id", "t"), t.select(key.alias("key")), tasks)
    assert sorted(x["row_id"] for x in plain.collect()) == sorted(i for i, k, _ in refs if k is not None and norm(k) not in have)
    counts = integrity.orphan_counts(integrity.references(r, key, "id", "t"), t.select(key.alias("key")), tasks)
    assert sum(x["n_refs"] for x in counts.collect()) == plain.count()


def test_orphans_of_empty_tables(spark):
    r = spark.createDataFrame([(1, "a", datetime(2024, 1, 1))], "id long, k string, t timestamp")
    none = spark.createDataFrame([], "k string, s timestamp, e timestamp")
    refs = integrity.references(r, F.col("k"), "id", "t")
    assert integrity.not_alive(refs, integrity.lifetimes(none, F.col("k"), "s", "e")).count() == 1
    assert integrity.without_target(refs, none.select(F.col("k").alias("key"))).count() == 1
    empty = refs.limit(0)
    assert integrity.without_target(empty, r.select(F.col("k").alias("key"))).count() == 0
    assert integrity.named(refs, "x").first()["ref_month"] == "2024-01"


def _walk(lines):
    """root, path, cycle of each node by plain walking."""
    parent = {}
    for no, tid, p in sorted(lines, key=lambda x: (x[0] is None, x[0] or 0)):
        if tid is not None:
            parent.setdefault(tid, p)
    out = {}
    for t in parent:
        path, seen = [t], {t}
        while True:
            p = parent[path[-1]]
            if p in (None, 0, path[-1]) or p not in parent:
                out[t] = (path[-1], path[::-1], None)
                break
            if p in seen:
                i = path.index(p)
                out[t] = (None, None, min(path[i:]))
                break
            path.append(p)
            seen.add(p)
    return out


@pytest.mark.parametrize("size,at_once", [(3, 10**6), (20, 10**6), (10**6, 10**6), (8, 5)])
def test_hierarchy_equals_walking(spark, size, at_once):
    rng = random.Random(size)
    lines = [(i, rng.randint(1, 150), rng.choice([None, 0, 999, *[rng.randint(1, 150)] * 7])) for i in range(260)]
    lines += [(1000 + i, 200 + i, 200 + i + 1) for i in range(90)]  # a deep chain
    lines += [(2000, 300, 301), (2001, 301, 302), (2002, 302, 300), (2003, 303, 301), (2004, 304, 304), (None, 305, 304), (2005, None, 3), (2006, 2**40 + 7, 304)]
    df = spark.createDataFrame([(n, t, p, " Species", None) for n, t, p in lines], "line_no long, tid long, parent_tid long, tax_rank string, leaf boolean").withColumn("ptr", F.lit(1)).withColumn("depth", F.lit("x"))
    got = {r["tid"]: r for r in hierarchy.resolve(hierarchy.links(hierarchy.valid_lines(df)), links_a_partition=size, most_at_once=at_once).collect()}
    want = _walk(lines)
    assert set(got) == set(want)
    for t, (root, path, cycle) in want.items():
        g = got[t]
        assert (g["root"], g["path"], g["cycle_tid"]) == (root, path, cycle), t
        assert g["depth"] == (len(path) - 1 if path else None)
    ends = {(r["cycle_tid"], r["tid"]) for r in hierarchy.endless(df, links_a_partition=size, most_at_once=at_once).collect()}
    assert ends == {(c, t) for t, (_, _, c) in want.items() if c is not None}


@pytest.mark.parametrize("size", [5, 40])
def test_cycles_found_early_have_followers_elsewhere(spark, size):
    lines = [(i, 2 * i, 2 * i + 1) for i in range(1, 60)] + [(100 + i, 2 * i + 1, 2 * i) for i in range(1, 60)]  # 59 cycles of two
    lines += [(1000 + i, 1000 + i, 2 + i % 118) for i in range(300)] + [(2000 + i, 2000 + i, 1000 + i) for i in range(300)]
    df = spark.createDataFrame([(n, t, p, None, None) for n, t, p in lines], "line_no long, tid long, parent_tid long, tax_rank string, leaf boolean")
    got = hierarchy.hierarchy(df, links_a_partition=size).collect()
    want = _walk(lines)
    assert {r["tid"]: (r["root"], r["path"], r["cycle_tid"]) for r in got} == want


def test_hierarchy_counts_descendants_and_empty(spark):
    df = spark.createDataFrame([(1, 1, 1, "a", True), (2, 2, 1, None, None), (3, 3, 2, "c", None), (3, 3, 2, "c", None)], "line_no long, tid long, parent_tid long, tax_rank string, leaf boolean")
    assert {r["tid"]: r["n_descendants"] for r in hierarchy.hierarchy(df).collect()} == {1: 2, 2: 1, 3: 0}
    assert hierarchy.hierarchy(df.limit(0)).count() == 0
    assert hierarchy.endless(df.limit(0)).count() == 0

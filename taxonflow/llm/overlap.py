"""How many identifiers each pair of many large sets shares, without forming any intersection.

Each set is kept as ``m`` logarithmic registers: an identifier's hash picks a register and a uniform number u, and the
register holds the largest -log_b(u) seen, rounded down. The base b is 2^(1/512), so two sets' registers are equal almost
only when one shared identifier decides both. For a pair, the registers where the first is larger, the second is larger,
and both are equal (empty ones aside) are counted; with Poisson arrivals these three outcomes have the odds of |A only|,
|B only| and |A and B|, and chance ties are corrected for the base. The joint likelihood of both differences and the
intersection, given both cardinalities (each the maximum-likelihood estimate from its own registers), is maximised.

Sketches are compared block against block of sets, so each sketch is sent to as many tasks as there are blocks and no
record of any set leaves its own group. The standard error of each estimate joins the error of the share s of the union,
sqrt(s (1 - s) / registers in use), and the error of the union's own size.

Defined results: null sets and null or invalid identifiers are no members; repeated rows change nothing; a set without
members does not appear; an empty table gives no pair.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxonflow.session import cut_lineage

REGISTERS = 65_536
STEPS = 512  #: registers' values for each halving of u
BLOCK = 128  #: sets in a block


def members(df: DataFrame, group: str, identifier: Column) -> DataFrame:
    """(grp, h): 64-bit hashes of the members; rows without group or identifier are no members."""
    return df.select(F.col(group).alias("grp"), identifier.alias("_id")).where("grp is not null and _id is not null").select("grp", F.xxhash64("_id").alias("h"))


def sketches(hashed: DataFrame, m: int = REGISTERS) -> DataFrame:
    """(grp, regs): the non-empty registers of each set as an array of register * 65536 + value, at most m entries."""
    bits = m.bit_length() - 1
    width = 63 - bits
    u = (F.shiftrightunsigned("h", bits + 1).cast("double") + 0.5) / float(2**width)
    value = F.floor(-F.log2(u) * STEPS) + 1
    code = F.col("h").bitwiseAND(m - 1) * 65536 + value
    best = hashed.select("grp", F.col("h").bitwiseAND(m - 1).cast("int").alias("r"), code.alias("code")).groupBy("grp", "r").agg(F.max("code").alias("code"))
    return best.groupBy("grp").agg(F.collect_list("code").alias("regs"))


def cardinality(value: np.ndarray, m: int) -> float:
    """Maximum likelihood from the non-empty registers' values: first arrivals on [0, 1], censored at 1."""
    if not len(value):
        return 0.0
    u = 2.0 ** (-(value - 0.5) / STEPS)
    return m * len(value) / (u.sum() + m - len(value))


def joint_estimate(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The shared number x that maximises D+ log(a) + D- log(b) + D0 log(x), with a = n_a - x, b = n_b - x over their sum.

    Ties by chance (the values of two different identifiers fall into the same step) come to 2 c a b / (a + b + x)^2 of
    the registers with c = ln(2) / 512 / 2, half of them taken from either side.
    """
    c = np.log(2) / STEPS / 2
    top = np.minimum(n_a, n_b)

    def log_likelihood(x: np.ndarray) -> np.ndarray:
        a, b = np.maximum(n_a - x, 1e-9), np.maximum(n_b - x, 1e-9)
        u = a + b + x
        tie = c * a * b / (u * u)
        return larger * np.log(np.maximum(a / u - tie, 1e-300)) + smaller * np.log(np.maximum(b / u - tie, 1e-300)) + equal * np.log(np.maximum(x / u + 2 * tie, 1e-300))

    lo, hi, g = np.zeros_like(top), top.copy(), (np.sqrt(5) - 1) / 2
    for _ in range(60):  # golden section: the likelihood has one peak
        x1, x2 = hi - g * (hi - lo), lo + g * (hi - lo)
        left = log_likelihood(x1) >= log_likelihood(x2)
        lo, hi = np.where(left, lo, x1), np.where(left, x2, hi)
    return (lo + hi) / 2


def _dense(regs: list, m: int) -> np.ndarray:
    out = np.zeros((len(regs), m), np.uint16)
    for i, r in enumerate(regs):
        r = np.asarray(r, np.int64)
        out[i, r >> 16] = r & 65535
    return out


def _compare(m: int):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        i, j = int(key[0]), int(key[1])
        part = part.sort_values("grp", ignore_index=True)
        left, right = part.index[part.block == i].to_numpy(), part.index[part.block == j].to_numpy()
        regs = _dense(part.regs.tolist(), m)
        n = np.array([cardinality(r[r > 0].astype(float), m) for r in regs])
        grp = part.grp.to_numpy()
        out = []
        for x in left:
            others = right[grp[right] > grp[x]] if i == j else right
            if not len(others):
                continue
            larger, smaller, equal = (np.zeros(len(others), np.int64) for _ in range(3))
            for s in range(0, m, 4096):  # a slice of registers stays in the cache
                a, b = regs[x, s : s + 4096], regs[others, s : s + 4096]
                larger += np.count_nonzero(a > b, axis=1)
                smaller += np.count_nonzero(a < b, axis=1)
                equal += np.count_nonzero((a == b) & (a > 0), axis=1)
            shared = joint_estimate(larger, smaller, equal, np.full(len(others), n[x]), n[others])
            union = n[x] + n[others] - shared
            s = np.clip(shared / union, 0, 1)
            load = np.minimum(union / m, 50)
            size_err = np.minimum(np.sqrt(m * (np.expm1(load) - load)), union / np.sqrt(m))  # of the union's own estimate
            split = union * np.sqrt(np.maximum(s * (1 - s), 1.0 / m) / np.maximum(larger + smaller + equal, 1))
            err = np.sqrt(split**2 + (s * size_err) ** 2)
            out.append(pd.DataFrame({"a": grp[x], "b": grp[others], "n_a": n[x], "n_b": n[others], "shared": shared, "std_error": err}))
        if not out:
            return pd.DataFrame({c: [] for c in ("a", "b", "n_a", "n_b", "shared", "std_error")})
        o = pd.concat(out, ignore_index=True)
        swap = (o.a > o.b).to_numpy()
        o.loc[swap, ["a", "b", "n_a", "n_b"]] = o.loc[swap, ["b", "a", "n_b", "n_a"]].to_numpy()
        return o.astype({"a": "int64", "b": "int64"})

    return run


def overlaps(sketched: DataFrame, m: int = REGISTERS, block: int = BLOCK) -> DataFrame:
    """(a, b, n_a, n_b, shared, std_error) of every pair a < b of sets; only_a = n_a - shared, only_b = n_b - shared.

    A sketch is copied once for each block, so blocks are as large as a task can hold: about ``block`` sets each.
    """
    sketched = cut_lineage(sketched)
    blocks = max(1, -(-sketched.count() // block))
    numbered = sketched.withColumn("block", F.pmod(F.xxhash64("grp"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = numbered.withColumn("o", other).select(F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "grp", "regs")
    return sent.groupBy("i", "j").applyInPandas(_compare(m), "a long, b long, n_a double, n_b double, shared double, std_error double")


def exact_shared(hashed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, shared, n_small): exact numbers for given pairs, by looking the smaller set's members up in the larger.

    The smaller sets' rows are repeated once for each of their pairs; the larger sets' rows are not. Rows are spread by
    set and member, so no set is one task.
    """
    first_small = F.col("n_a") <= F.col("n_b")
    p = pairs.select("a", "b", F.when(first_small, F.col("a")).otherwise(F.col("b")).alias("small"), F.when(first_small, F.col("b")).otherwise(F.col("a")).alias("big"))
    small = hashed.join(p, F.col("grp") == F.col("small")).select("a", "b", "big", "h").distinct()
    big = hashed.join(p.select("big").distinct(), F.col("grp") == F.col("big"), "left_semi").select(F.col("grp").alias("g"), F.col("h").alias("k")).distinct()
    hit = small.join(big, (F.col("big") == F.col("g")) & (F.col("h") == F.col("k")), "left")
    return hit.groupBy("a", "b").agg(F.count("k").alias("shared"), F.count(F.lit(1)).alias("n_small"))


def sharing_pairs(df: DataFrame, group: str, identifier: Column, share: float, m: int = REGISTERS, sigmas: float = 4.0) -> DataFrame:
    """(a, b) of pairs that share at least ``share`` of the smaller set.

    The joint estimate decides. A set far smaller than the other fills too few of the shared registers for that, so pairs
    whose estimate lies within ``sigmas`` of its standard errors of the line are checked exactly afterwards; where there
    are none the members are read once.
    """
    hashed = members(df, group, identifier)
    est = cut_lineage(overlaps(sketches(hashed, m), m))
    over = F.col("shared") - F.lit(share) * F.least("n_a", "n_b")
    undecided = est.where(F.abs(over) < sigmas * F.col("std_error"))
    sure = est.where(over >= sigmas * F.col("std_error")).select("a", "b")
    if undecided.isEmpty():
        return sure
    return sure.unionByName(exact_shared(hashed, undecided).where(F.col("shared") >= F.lit(share) * F.col("n_small")).select("a", "b"))

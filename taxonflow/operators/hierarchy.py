"""Parent-child links to full hierarchies: weighted disjoint-set forests, merged level by level.

Every partition of links builds its own forest: each node learns the root of its partition-local tree, the weight (the
number of links up to that root) and the path. A local root either ends there, or points into another partition. Only
the nodes that others point at go on to the next, eight times coarser level, as one weighted link each; leaves stay
behind. When one partition holds what is left, all roots and cycles are known, and one join for each level carries root,
depth and path back down. If what is left never fits one partition (``most_at_once``), the remaining links are doubled
by distributed self-joins instead, which needs no bound.

Defined results: of several lines of a node the one with the smallest line number counts; a line without node number is
ignored; a walk ends at a node that is its own parent or whose parent is null, 0 or no node of the table (that node is
the root, depth 0); a node whose walk never ends has no root, depth or path and carries the smallest node of its cycle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxonflow.session import cut_lineage

LINKS_A_PARTITION = 524_288
FAN_IN = 8
MOST_AT_ONCE = 2_000_000
STATE = "tid long, ptr long, off long, least long, root long, cycle_tid long"
SEGMENT = ", seg array<long>"  #: only where paths are wanted


def valid_lines(nodes: DataFrame) -> DataFrame:
    """One line for each tid, the one with the smallest line_no; columns tid, parent_tid, tax_rank, leaf."""
    line = F.struct(F.coalesce("line_no", F.lit(2**63 - 1)).alias("n"), "parent_tid", "tax_rank", "leaf")
    kept = nodes.where("tid is not null").groupBy("tid").agg(F.min(line).alias("v"))
    return kept.select("tid", "v.parent_tid", "v.tax_rank", "v.leaf")


def links(lines: DataFrame) -> DataFrame:
    """(tid, parent_tid) with a null parent where the walk ends."""
    wanted = lines.select("tid", F.when((F.col("parent_tid") != 0) & (F.col("parent_tid") != F.col("tid")), F.col("parent_tid")).alias("parent_tid"))
    known = lines.select(F.col("tid").alias("known"))
    return wanted.join(known, F.col("parent_tid") == F.col("known"), "left").select("tid", F.col("known").alias("parent_tid"))


class WeightedForest:
    """A disjoint-set forest over arrays: find with path doubling, weights summed up to the root."""

    def __init__(self, tid: np.ndarray, ptr: np.ndarray, is_end: np.ndarray, off: np.ndarray, least: np.ndarray):
        n = len(tid)
        order = np.argsort(tid, kind="stable")
        at = np.searchsorted(tid, ptr, sorter=order)
        at = order[np.minimum(at, n - 1)] if n else at
        here = np.arange(n)
        inside = ~is_end & (tid[at] == ptr) if n else np.zeros(0, bool)
        self.parent = np.where(inside, at, here)
        self.is_root = ~inside
        root, weight, low, hops = self.parent.copy(), np.where(inside, off, 0), least.copy(), inside.astype(np.int64)
        for _ in range(max(1, int(n).bit_length() + 1)):
            weight = weight + weight[root]
            low = np.minimum(low, low[root])
            hops = hops + hops[root]
            root = root[root]
        self.root, self.weight, self.least, self.hops = root, weight, low, hops
        self.endless = ~self.is_root[root]

    def paths(self, seg: list[list[int]]) -> list[list[int] | None]:
        """Each node's segments joined up to and with its root, by a walk over the parent index, near nodes first."""
        out: list = [None] * len(seg)
        parent = self.parent.tolist()
        is_root = self.is_root.tolist()
        for i in np.argsort(self.hops, kind="stable")[: len(seg)].tolist():
            if self.endless[i]:
                continue
            above = [] if is_root[i] else out[parent[i]]
            # a root that an earlier level found to lead into a cycle has no path
            out[i] = None if seg[i] is None or above is None else seg[i] + above
        return out


def _resolve(with_paths: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        num = lambda c: t[c].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
        null = lambda c: t[c].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        tid, ptr, off, least = num("tid"), num("ptr"), num("off"), num("least")
        f = WeightedForest(tid, ptr, null("ptr"), off, least)
        r, bad = f.root, f.endless
        total = f.weight + off[r]  # the root's own link, or its known depth
        cycle = np.where(bad, f.least[r], num("cycle_tid")[r])
        no_cycle = ~bad & null("cycle_tid")[r]
        seg = f.paths(t["seg"].to_pylist()) if with_paths else None
        to, no_ptr, root, no_root = ptr[r], null("ptr")[r] | bad, num("root")[r], null("root")[r] | bad
        step = 50_000
        for a in range(0, len(tid), step):
            s = slice(a, a + step)
            cols = [
                pa.array(tid[s]), pa.array(to[s], mask=no_ptr[s]), pa.array(total[s]), pa.array(f.least[s]),
                pa.array(root[s], mask=no_root[s]), pa.array(cycle[s], mask=no_cycle[s]),
            ]
            if with_paths:
                cols.append(pa.array(seg[s], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=t.column_names)

    return run


def _join_up(low: DataFrame, up: DataFrame) -> DataFrame:
    """What the nodes' pointers know, added to what the nodes know."""
    u = up.select(*[F.col(c).alias(f"u_{c}") for c in up.columns])
    j = low.join(u, F.col("ptr") == F.col("u_tid"), "left")
    found = F.col("u_tid").isNotNull()
    pick = lambda c: F.when(found, F.col(f"u_{c}")).otherwise(F.col(c)).alias(c)
    return j.select(
        "tid", pick("ptr"), (F.col("off") + F.coalesce("u_off", F.lit(0))).alias("off"), F.least("least", "u_least").alias("least"),
        pick("root"), pick("cycle_tid"), *([F.when(found, F.concat("seg", "u_seg")).otherwise(F.col("seg")).alias("seg")] if "seg" in low.columns else []),
    )


def _doubled(state: DataFrame, n: int) -> DataFrame:
    """Distributed pointer doubling, for what no single partition may hold."""
    for _ in range(max(1, n.bit_length() + 1)):
        if not state.where("ptr is not null").limit(1).count():
            return state
        state = cut_lineage(_join_up(state, state))
    tail = state.select(F.col("tid").alias("on_cycle"), F.col("least").alias("cycle_least"))
    return state.join(tail, F.col("ptr") == F.col("on_cycle"), "left").select(
        "tid", F.lit(None).cast("long").alias("ptr"), "off", "least", "root", F.coalesce("cycle_least", "cycle_tid").alias("cycle_tid"), *(["seg"] if "seg" in state.columns else [])
    )


def resolve(links_df: DataFrame, with_paths: bool = True, links_a_partition: int = LINKS_A_PARTITION, most_at_once: int = MOST_AT_ONCE) -> DataFrame:
    """(tid, root, depth, path, cycle_tid) of each node of (tid, parent_tid); path, left out without ``with_paths``, runs from the
    root to the node."""
    end = F.col("parent_tid").isNull()
    seg = [F.array("tid").alias("seg")] if with_paths else []
    schema = STATE + SEGMENT * with_paths
    state = links_df.select(
        "tid", F.col("parent_tid").alias("ptr"), F.when(end, 0).otherwise(1).cast("long").alias("off"), F.col("tid").alias("least"),
        F.when(end, F.col("tid")).alias("root"), F.lit(None).cast("long").alias("cycle_tid"), *seg,
    )
    state = cut_lineage(state)
    n = state.count()
    groups = 1
    while groups * links_a_partition < n:
        groups *= FAN_IN
    levels: list[DataFrame] = []
    while True:
        if groups == 1 and n > most_at_once:
            up = _doubled(state, n)
            break
        up = cut_lineage(state.repartition(groups, "tid").mapInArrow(_resolve(with_paths), schema))
        open_ = up.where("ptr is not null").select(F.col("ptr").alias("entry")).distinct()
        if groups == 1:
            break
        levels.append(up)
        state = cut_lineage(up.join(open_, F.col("tid") == F.col("entry"), "left_semi"))
        n = state.count()
        if not n:
            levels.pop()
            break
        groups //= FAN_IN
        while groups > 1 and groups // FAN_IN * links_a_partition >= n:
            groups //= FAN_IN
    for low in reversed(levels):
        up = _join_up(low, up)
        up = cut_lineage(up) if low is not levels[0] else up
    done = F.col("root").isNotNull()
    path = [F.when(done, F.reverse("seg")).alias("path")] if with_paths else []
    return up.select("tid", "root", F.when(done, F.col("off")).alias("depth"), *path, F.when(~done, F.col("cycle_tid")).alias("cycle_tid"))


def descendants(resolved: DataFrame) -> DataFrame:
    """(anc_tid, tid, distance), distance 0 for the node itself: each path unfolded."""
    return resolved.where("path is not null").select("tid", "depth", F.posexplode("path").alias("at", "anc_tid")).select("anc_tid", "tid", (F.col("depth") - F.col("at")).alias("distance"))


def hierarchy(nodes: DataFrame, **options) -> DataFrame:
    """Each tid with parent, rank, root, depth, path and number of descendants, or with its cycle."""
    lines = cut_lineage(valid_lines(nodes))
    done = cut_lineage(resolve(links(lines), **options))
    below = descendants(done).groupBy(F.col("anc_tid").alias("tid")).agg((F.count(F.lit(1)) - 1).alias("n_descendants"))
    return lines.join(done, "tid").join(below, "tid", "left").withColumn("n_descendants", F.when(F.col("root").isNotNull(), F.coalesce("n_descendants", F.lit(0))))


def endless(nodes: DataFrame, **options) -> DataFrame:
    """(cycle_tid, tid) of every tid from which the walk never ends."""
    done = resolve(links(valid_lines(nodes)), with_paths=False, **options)
    return done.where("cycle_tid is not null").select("cycle_tid", "tid")

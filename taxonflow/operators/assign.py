"""Per-read accumulation, selection and per-taxon counting of hits.

A read is (sample_id, read_no). Whole rows delivered twice count once; rows without score are no hits; a missing taxon
is 0, "unclassified". A read's entries are at most one for each taxon (or sequence) of the tree, so that is the most any
task holds of one read, however many hits it has: hits are summed before a read's entries meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

READ = ["sample_id", "read_no"]
BASE = 15  #: fixed value: letters that do not count in a score
PRIME = 2_147_483_647


def hits(raw: DataFrame) -> DataFrame:
    """(read, unique_id, tid, mate, fw, score, hit_len, query_length), repeated rows dropped."""
    once = raw.where("score is not null").distinct()
    return once.select(*READ, "unique_id", F.coalesce("tax_id", F.lit(0)).alias("tid"), "mate", "fw", "score", F.coalesce("summed_hit_len", F.lit(0.0)).alias("hit_len"), "query_length")


def finalised(h: DataFrame, *key: str) -> DataFrame:
    """(read, key, score, hit_len): sums by mate and strand, the better strand of each mate, mates added; one aggregate.

    The key is the taxon, or with a sequence's id the sequence. Mate 2 is the second mate, any other the first; a hit
    that is not forward is reverse.
    """
    key = key or ("tid",)
    second, forward = F.coalesce(F.col("mate") == 2, F.lit(False)), F.coalesce("fw", F.lit(False))
    parts = {f"_{c}{m}{s}": F.sum(F.when((second if m else ~second) & (forward if s else ~forward), F.col(c))) for c in ("score", "hit_len") for m in (0, 1) for s in (0, 1)}
    summed = h.groupBy(*READ, *key).agg(*[v.alias(k) for k, v in parts.items()])
    better = lambda c, zero: F.coalesce(F.greatest(f"_{c}00", f"_{c}01"), zero) + F.coalesce(F.greatest(f"_{c}10", f"_{c}11"), zero)
    return summed.select(*READ, *key, better("score", F.lit(0).cast("long")).alias("score"), better("hit_len", F.lit(0.0)).alias("hit_len"))


def best_only(entries: DataFrame) -> DataFrame:
    """The entries with their read's best score."""
    return entries.withColumn("_best", F.max("score").over(Window.partitionBy(*READ))).where("score = _best").drop("_best")


def without(entries: DataFrame, excluded: DataFrame) -> DataFrame:
    """Entries whose taxon is not in the excluded set (a column tid)."""
    return entries.join(excluded.select("tid").distinct(), "tid", "left_anti")


def _marked(rows: DataFrame, host: DataFrame) -> DataFrame:
    return rows.join(host.select(F.col("tid").alias("_h")).distinct(), F.col("tid") == F.col("_h"), "left").withColumn("is_host", F.col("_h").isNotNull()).drop("_h")


def host_first(best: DataFrame, host: DataFrame) -> DataFrame:
    """Where a read's best entries hold a host taxon, only its host entries stay; others are kept as they are."""
    any_ = _marked(best, host).withColumn("_any", F.max("is_host").over(Window.partitionBy(*READ)))
    return any_.where("is_host or not _any").drop("_any")


def mixed_order(*columns: str, seed: int = 0) -> Column:
    """A seeded order number of id columns, by arithmetic any SQL engine can repeat."""
    x = F.lit(seed % PRIME).cast("long")
    for c in columns:
        x = (x * 48_271 + F.pmod(F.col(c), F.lit(PRIME))) % PRIME
        x = (x * x + 12_345) % PRIME
    return x


def selected(entries: DataFrame, k: int | None = 5, paths: DataFrame | None = None, host: DataFrame | None = None, traverse: bool = True, seed: int = 0) -> DataFrame:
    """(read, tid, score, hit_len, second, n_matches, moved): each read's best entries, brought to at most k.

    Reads with more than k entries keep the best ones; if these are still more than k they are rolled up the taxonomy
    along ``paths`` (tid, slots), or without traversal, or if the rollup ends above k, are unclassified: one row with
    taxon, scores and length 0. ``moved`` says that the taxon is no longer the entry's own. Where a best entry is of a
    host taxon nothing is rolled up: only host entries are kept, at most k of them in a seeded order. ``second`` is the
    second best score of the entries that are left; with k None all best entries are kept.
    """
    if k is not None and traverse and paths is None:
        raise ValueError("a rollup needs the taxa's paths")
    w = Window.partitionBy(*READ)
    e = _marked(entries, host) if host is not None else entries.withColumn("is_host", F.lit(False))
    e = e.withColumn("_best", F.max("score").over(w))
    top = F.col("score") == F.col("_best")
    e = e.withColumn("_all", F.count(F.lit(1)).over(w)).withColumn("_top", F.sum(top.cast("long")).over(w)).withColumn("_below", F.max(F.when(~top, F.col("score"))).over(w))
    of_host = F.col("is_host")
    e = e.withColumn("_host", F.sum((top & of_host).cast("long")).over(w)).withColumn("_hbelow", F.max(F.when(~top & of_host, F.col("score"))).over(w)).where("score = _best")
    if "unique_id" not in e.columns:
        e = e.withColumn("unique_id", F.lit(None).cast("long"))
    own = [*READ, "unique_id", "tid", "score", "hit_len"]
    zero = F.lit(0).cast("long")
    # entries below the best are left only where all entries are no more than k, or of a host
    below = F.coalesce("_below", zero) if k is None else F.when(F.col("_all") <= k, F.coalesce("_below", zero)).otherwise(zero)
    next_ = F.when(F.col("_host") > 1, F.col("_best")).when(F.col("_host") == 1, F.coalesce("_hbelow", zero)).when(F.col("_top") > 1, F.col("_best")).otherwise(below).cast("long")
    finish = lambda df, n, second: df.select(*own, second.alias("second"), n.cast("long").alias("n_matches"), F.lit(False).alias("moved"))
    if k is None:
        return finish(e.where("_host = 0 or is_host"), F.when(F.col("_host") > 0, F.col("_host")).otherwise(F.col("_top")), next_)
    many = (F.col("_host") == 0) & (F.col("_top") > k)
    out = finish(e.where(~many & (F.col("_host") == 0)), F.col("_top"), next_)
    if host is not None:
        ranked = e.where("is_host").withColumn("_n", F.row_number().over(w.orderBy(mixed_order(*READ, "tid", seed=seed), "tid", "unique_id"))).where(F.col("_n") <= k)
        out = out.unionByName(finish(ranked, F.least("_host", F.lit(k)), next_))
    if not traverse:
        none = e.where(many).select(*READ).distinct()
        return out.unionByName(none.select(*READ, F.lit(None).cast("long").alias("unique_id"), zero.alias("tid"), zero.alias("score"), F.lit(0.0).alias("hit_len"), zero.alias("second"), F.lit(1).cast("long").alias("n_matches"), F.lit(True).alias("moved")))
    return out.unionByName(rolled_up(e.where(many).select(*own), paths, k))


def random_selection(entries: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k entries of each read without regard to score, in a seeded order."""
    w = Window.partitionBy(*READ).orderBy(mixed_order(*READ, "tid", seed=seed), "tid")
    return entries.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def second_best(entries: DataFrame) -> DataFrame:
    """(read, best, second): the two best entry scores of each read, equal on ties, 0 if there is one entry."""
    counts = entries.groupBy(*READ, "score").agg(F.count(F.lit(1)).alias("c"))
    two = Window.partitionBy(*READ).orderBy(F.col("score").desc())
    ranked = counts.withColumn("_n", F.row_number().over(two)).where("_n <= 2")
    per = ranked.groupBy(*READ).agg(F.max("score").alias("best"), F.max_by("c", "score").alias("c"), F.max(F.when(F.col("_n") == 2, F.col("score"))).alias("next"))
    return per.select(*READ, "best", F.when(F.col("c") > 1, F.col("best")).otherwise(F.coalesce("next", F.lit(0))).alias("second"))


def taxon_counts(assigned: DataFrame) -> DataFrame:
    """(tid, n_reads, n_unique_reads, weighted_reads, sum_score, summed_hit_len) of selected rows with n_matches.

    ``sum_score`` grows by one a row, as the counter of that name always has.
    """
    n = F.col("n_matches")
    return assigned.groupBy("tid").agg(
        F.count(F.lit(1)).alias("n_reads"), F.sum(F.when(n == 1, 1).otherwise(0)).alias("n_unique_reads"), F.sum(1 / n).alias("weighted_reads"),
        F.count(F.lit(1)).alias("sum_score"), F.sum("hit_len").alias("summed_hit_len"),
    )


def greatest_scores(raw: DataFrame) -> DataFrame:
    """(read, max_score) of hit rows: what a read would score if it matched from end to end. A read with a second mate
    is a pair of mates of equal length that share its query length."""
    per = raw.groupBy(*READ).agg(F.max("query_length").alias("n"), F.max("mate").alias("m"))
    mates = F.when(F.col("m") == 2, 2).otherwise(1)
    each = F.col("n") / mates - BASE
    return per.select(*READ, F.coalesce(F.when(each > 0, mates * each * each), F.lit(0.0)).alias("max_score"))


def full_matches(assigned: DataFrame, max_scores: DataFrame) -> DataFrame:
    """Rows of reads whose score reaches the greatest possible one: only these take part in abundances. An unclassified
    row has nothing to reach."""
    return assigned.join(max_scores, READ).where((F.col("score") >= F.col("max_score")) | ((F.col("tid") == 0) & F.col("moved"))).drop("max_score")


def equivalence_classes(assigned: DataFrame) -> DataFrame:
    """(ids, n): sorted id list of a read -> number of reads. A read has at most k rows here."""
    per = assigned.groupBy(*READ).agg(F.sort_array(F.collect_list("tid")).alias("ids"))
    return per.groupBy("ids").agg(F.count(F.lit(1)).alias("n"))


def unclassified(reads: DataFrame, assigned: DataFrame) -> DataFrame:
    """All reads: their assignments, or one unclassified row."""
    j = reads.select(*READ).distinct().join(assigned, READ, "left")
    return j.select(*READ, F.coalesce("tid", F.lit(0)).alias("tid"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("n_matches", F.lit(1)).alias("n_matches"))


def classified_reads(reads: DataFrame, assigned: DataFrame) -> DataFrame:
    return reads.join(assigned.where("tid <> 0").select(*READ).distinct(), READ, "left_semi")


def unclassified_reads(reads: DataFrame, assigned: DataFrame) -> DataFrame:
    return reads.join(assigned.where("tid <> 0").select(*READ).distinct(), READ, "left_anti")


# --- bounded rollup


def merged(tids: list[int], paths: list[list[int]], k: int, root: int = 1) -> list[tuple[int, int, bool]] | None:
    """The rollup of one read's best entries, given in order, to at most k: (taxon, place of the entry it stands for,
    whether the taxon is no longer that entry's own), or None if they stay more.

    Slot by slot all entries are lifted to the slot, an empty slot giving taxon 0; those whose next slot is filled (past
    the path's end the root is next) are counted by it, and the largest parents' entries, the larger taxon first among
    equal counts, become one that stands for the first of them. Entries without a next slot wait for the next turn.
    The first entry's path says how many turns there are.
    """
    tid, at = list(tids), [0] * len(tids)
    live = dict.fromkeys(range(len(tids)))
    moved = [False] * len(tids)
    for r in range(len(paths[0]) + 1 if tids else 0):
        if len(live) <= k:
            break
        waiting: dict[int, list[int]] = {}
        for i in live:
            if at[i] < r:
                at[i] = r if r < len(paths[i]) else len(paths[i]) + 256
                if at[i] == r:
                    tid[i], moved[i] = paths[i][r], True
            if at[i] == r:
                above = paths[i][r + 1] if r + 1 < len(paths[i]) else root
                if above:
                    waiting.setdefault(above, []).append(i)
        named: dict[int, list[int]] = {}
        for i in live:
            if tid[i] in waiting:
                named.setdefault(tid[i], []).append(i)
        for parent in sorted(waiting, key=lambda p: (-len(waiting[p]), -p)):
            for i in waiting[parent]:
                if i in live and at[i] == r:
                    at[i], tid[i], moved[i] = r + 1, parent, True
            one = sorted({i for i in (*waiting[parent], *named.get(parent, ())) if i in live and tid[i] == parent})
            for i in one[1:]:
                del live[i]
            if len(live) <= k:
                break
    return [(tid[i], i, moved[i]) for i in live] if len(live) <= k else None


def roll_up(slots: dict[int, list[int]], entries: list[tuple[int, float]], k: int, root: int = 1) -> list[tuple[int, float]] | None:
    """``merged`` for entries (tid, hit length) in taxon order: (tid, hit length of the first entry merged), or None."""
    e = sorted(entries)
    got = merged([t for t, _ in e], [slots.get(t, []) for t, _ in e], k, root)
    return None if got is None else [(t, e[i][1]) for t, i, _ in got]


ROLLED = "sample_id long, read_no long, unique_id long, tid long, score long, hit_len double, second long, n_matches long, moved boolean"


def rolled_up(many: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """``merged`` for the best entries (read, unique_id, tid, score, hit_len) of many reads, in taxon, then sequence order.

    Reads stand together in sorted partitions, and one call works on all reads of a batch. A read has at most one entry
    for each taxon or sequence of the tree.
    """
    j = many.join(paths.select("tid", "slots"), "tid", "left").select(*READ, "unique_id", "tid", "score", "hit_len", "slots")
    sorted_ = j.repartition(*READ).sortWithinPartitions(*READ, "tid", "unique_id")

    def rows(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        begin = [0, *(i for i in range(1, len(p)) if p.sample_id.iat[i] != p.sample_id.iat[i - 1] or p.read_no.iat[i] != p.read_no.iat[i - 1]), len(p)]
        sample, read, uid, tid, score, size = (p[c].tolist() for c in ("sample_id", "read_no", "unique_id", "tid", "score", "hit_len"))
        slots = [[] if s is None else [int(x) for x in s] for s in p.slots]
        for a, b in zip(begin, begin[1:]):
            got = merged(tid[a:b], slots[a:b], k)
            if got is None:
                out.append((sample[a], read[a], None, 0, 0, 0.0, 0, 1, True))
                continue
            second = score[a] if len(got) > 1 else 0
            out += [(sample[a], read[a], None if gone or uid[a + i] != uid[a + i] else uid[a + i], t, score[a + i], float(size[a + i]), second, len(got), gone) for t, i, gone in got]
        made = pd.DataFrame(out, columns=[c.split()[0] for c in ROLLED.split(", ")])
        return made.astype({"unique_id": "Int64"})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the rows of the read that may go on in the next batch
        for p in parts:
            if not len(p):
                continue
            last = (p.sample_id == p.sample_id.iat[-1]) & (p.read_no == p.read_no.iat[-1])
            if held and last.all() and held[-1].sample_id.iat[-1] == p.sample_id.iat[0] and held[-1].read_no.iat[-1] == p.read_no.iat[0]:
                held.append(p)
                continue
            whole = pd.concat([*held, p[~last]], ignore_index=True) if held else p[~last].reset_index(drop=True)
            if held and last.all():  # the held read is complete, this batch's one read is not
                yield rows(pd.concat(held, ignore_index=True))
                held = [p]
                continue
            if len(whole):
                yield rows(whole)
            held = [p[last]]
        if held:
            yield rows(pd.concat(held, ignore_index=True))

    return sorted_.mapInPandas(run, ROLLED)


def bounded_rollup(best: DataFrame, paths: DataFrame, k: int = 5) -> DataFrame:
    """(read, tid, hit_len): the best entries of reads with more than k rolled up the taxonomy, the others kept."""
    out = selected(best, k, paths)
    return out.select(*READ, "tid", "hit_len")

"""Long exact spans shared between records, through one FM-index for each shard.

Every window of ``span`` letters holds a minimizer: the smallest hash among its k-mers. Records that share the window
share the minimizer at the same place in it. Minimizers of a single record are dropped; around every other one the
record is cut ``span - k`` letters before to ``span`` letters after it, and the segments of one minimizer meet in one
shard. So all copies of a window are in some common shard, and each shard streams only its own segments. In a shard an
FM-index is built and backward search computes, for each letter, the longest match with a segment of another record;
matches of at least ``span`` letters are reported and united for each record.

Minimizers with more than ``hot`` segments would overfill a shard. Their windows (at most ``span - k + 1`` for each
segment) are packed, two bits a letter, and grouped letter for letter instead, with partial aggregation, which gives the
same rows and is linear for any number of copies.

Long records are worked on in pieces of ``RECORD_LETTERS`` letters that overlap by a window less one letter, so no task
holds a whole one.

Defined results: null ids and texts are no records; letters other than A, C, G, T (case ignored) match nothing; rows
with the same id are one record (if their texts differ, the largest text in string order); an empty table or records
shorter than ``span`` give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxonflow.llm.fmindex import FMIndex
from taxonflow.session import cut_lineage

SPAN = 100
K = 31
SHARD_LETTERS = 600_000
HOT = 2_000
PIECE = 512
RECORD_LETTERS = 1_000_000
_CODE = np.zeros(256, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i + 1


def codes(text: str) -> np.ndarray:
    """1 to 4 for A, C, G, T in either case, 0 for every other character (one place for each character)."""
    raw = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    return _CODE[raw]


def kmer_hashes(code: np.ndarray, k: int) -> np.ndarray:
    """Positive 63-bit hashes of the k-mers; -1 for those with another letter."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h, width, out, done = code.astype(np.uint64), 1, np.zeros(n, np.uint64), 0
    rest = k
    while rest:  # binary method: the hash of k letters from hashes of 1, 2, 4, ... letters
        if rest & 1:
            out = out * np.uint64(pow(5, width, 2**64)) + h[done : done + n]
            done += width
        rest >>= 1
        if rest:
            h = h[:-width] * np.uint64(pow(5, width, 2**64)) + h[width:]
            width *= 2
    out = (out ^ (out >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    out = ((out ^ (out >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(code == 0)])
    return np.where(bad[k:] - bad[:-k] > 0, -1, out)


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each w neighbours."""
    size = 1
    while size * 2 <= w:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def minimizers(code: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-mers that are smallest in some window of span letters."""
    h = kmer_hashes(code, k)
    w = span - k + 1
    if len(h) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _sliding(h, w, np.minimum)  # -1 where the window has another letter
    padded = np.concatenate([np.full(w - 1, -2, np.int64), low, np.full(w - 1, -2, np.int64)])
    at = np.flatnonzero((_sliding(padded, w, np.maximum) == h) & (h >= 0))
    return at, h[at]


def _find_minimizers(span: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [], [], [], []
            for i, base, t in zip(*(b.column(c).to_pylist() for c in range(3))):
                p, h = minimizers(codes(t), span, k)
                for c, x in zip(cols, (np.full(len(p), i, np.int64), np.full(len(p), base, np.int64), p, h)):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in cols], names=["rec", "base", "at", "h"])

    return run


def _cut(span: int, k: int, shards: int):
    """A record with its minimizers -> segments, those of one shard that overlap joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            ats, hs = _lists(b, 3), _lists(b, 4)
            for rec, base, text, at, h in zip(*(b.column(c).to_pylist() for c in range(3)), ats, hs):
                shard = h % shards
                order = np.lexsort((at, shard))
                shard, lo, hi = shard[order], np.maximum(0, at[order] - span + k), np.minimum(len(text), at[order] + span)
                # places rise within a shard, and all segments have about one length, so each reaches furthest yet
                fresh = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (lo[1:] > hi[:-1])))
                last = np.append(fresh[1:], len(order)) - 1
                out += [(int(shard[i]), rec, base + int(lo[i]), text[lo[i] : hi[j]]) for i, j in zip(fresh, last)]
            if out:
                cols = [pa.array([o[c] for o in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "rec", "start", "seg"])

    return run


def _lists(b: pa.RecordBatch, column: int) -> list[np.ndarray]:
    """The rows of a list column as arrays."""
    c = b.column(column)
    flat, at = c.flatten().to_numpy(zero_copy_only=False), c.offsets.to_numpy() - c.offsets[0].as_py()
    return [flat[i:j] for i, j in zip(at, at[1:])]


def packed_windows(code: np.ndarray, at: np.ndarray, span: int) -> list[bytes]:
    """The windows that start at the given places, two bits a letter; they hold A, C, G, T only."""
    bits = np.empty((len(code), 2), np.uint8)
    bits[:, 0], bits[:, 1] = (code - 1) >> 1 & 1, (code - 1) & 1
    every = np.lib.stride_tricks.sliding_window_view(bits.ravel(), 2 * span)[::2]
    out: list[bytes] = []
    for a in range(0, len(at), 20_000):
        rows = np.packbits(every[at[a : a + 20_000]], axis=1)
        out += [r.tobytes() for r in rows]
    return out


def _windows(span: int, k: int):
    """All windows around hot minimizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rec, base, text, anchors in zip(*(b.column(c).to_pylist() for c in range(3)), _lists(b, 3)):
                code = codes(text)
                n = len(code) - span + 1
                near = np.zeros(n + 1, np.int64)
                np.add.at(near, np.maximum(0, anchors - span + k), 1)
                np.add.at(near, np.minimum(n, anchors + 1), -1)
                bad = np.concatenate([[0], np.cumsum(code == 0)])
                p = np.flatnonzero((np.cumsum(near)[:-1] > 0) & (bad[span:] == bad[:-span]))
                for a in range(0, len(p), 50_000):
                    q = p[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), rec, np.int64)), pa.array(base + q), pa.array(packed_windows(code, q, span), pa.binary())], names=["rec", "at", "w"])

    return run


def _search(span: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["rec", "start"], ignore_index=True)
        segs = [codes(s) for s in part.seg]
        size = np.array([len(s) for s in segs])
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        text = np.zeros(int((size + 1).sum()), np.uint8)
        owner = np.empty(len(text), np.int64)
        number = np.unique(part.rec, return_inverse=True)[1]
        for b, n, s, o in zip(begin, size, segs, number):
            text[b : b + n] = s
            owner[b : b + n + 1] = o
        index = FMIndex(text, owner)
        hits = []
        # long segments are streamed in pieces that overlap by a window less one letter, even pieces first
        head, of = [], []
        for j, (b, n) in enumerate(zip(begin, size)):
            p = np.arange(0, max(1, n - span + 1), PIECE)
            head.append(b + p)
            of.append(np.full(len(p), j))
        head, of = np.concatenate(head), np.concatenate(of)
        tail = np.minimum(head + PIECE + span - 1, begin[of] + size[of])
        odd = (head - begin[of]) // PIECE % 2
        for side in (0, 1):
            m = odd == side
            if m.any():
                length = index.matching_statistics(head[m], tail[m])
                at = np.flatnonzero(length >= span)
                j = np.searchsorted(begin, at, side="right") - 1
                start = part.start.to_numpy()[j] + at - begin[j]
                hits.append(pd.DataFrame({"rec": part.rec.to_numpy()[j], "s": start, "e": start + length[at]}))
        found = pd.concat(hits, ignore_index=True).sort_values(["rec", "s"], ignore_index=True)
        return united(found)

    return run


def united(found: pd.DataFrame) -> pd.DataFrame:
    """Overlapping or touching intervals of one record joined; found is ordered by rec and s."""
    if not len(found):
        return found.astype({"rec": "int64", "s": "int64", "e": "int64"})
    reach = found.groupby("rec").e.cummax()
    new = (found.rec != found.rec.shift()) | (found.s > reach.shift())
    return found.groupby(new.cumsum()).agg(rec=("rec", "first"), s=("s", "min"), e=("e", "max")).reset_index(drop=True)


def shared_runs(records: DataFrame, rec: str, text: str, span: int = SPAN, k: int = K, shard_letters: int = SHARD_LETTERS, hot: int = HOT) -> DataFrame:
    """(rec, start, length): the maximal runs of letters that lie in a span shared with another record."""
    if not 0 < k <= span:
        raise ValueError("k must be between 1 and span")
    one = records.select(F.col(rec).cast("long").alias("rec"), F.col(text).alias("text")).where("rec is not null and text is not null").groupBy("rec").agg(F.max("text").alias("text"))
    base = F.explode(F.sequence(F.lit(0), F.length("text") - span, F.lit(RECORD_LETTERS)))
    one = one.where(F.length("text") >= span).select("rec", base.alias("base"), "text")
    one = one.select("rec", F.col("base").cast("long").alias("base"), F.substring("text", F.col("base") + 1, F.lit(RECORD_LETTERS + span - 1)).alias("text"))
    anchors = cut_lineage(one.mapInArrow(_find_minimizers(span, k), "rec long, base long, at long, h long"))
    per = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("rec").alias("a"), F.max("rec").alias("b")).where("a <> b").select(F.col("h").alias("kept"), "n")
    kept = cut_lineage(anchors.join(per, F.col("h") == F.col("kept")).select("rec", "base", "at", "h", (F.col("n") > hot).alias("is_hot")))
    n = kept.where("not is_hot").count()
    shards = max(1, -(-n * (2 * span - k) // shard_letters))

    def with_text(hits: DataFrame) -> DataFrame:
        # two lists from one pass, in one order; they are no longer than the piece
        per_piece = hits.groupBy("rec", "base").agg(F.collect_list(F.struct("at", "h")).alias("x"))
        return one.join(per_piece, ["rec", "base"]).select("rec", "base", "text", F.col("x.at").alias("at"), F.col("x.h").alias("h"))

    segments = with_text(kept.where("not is_hot")).mapInArrow(_cut(span, k, shards), "shard long, rec long, start long, seg string")
    found = segments.groupBy("shard").applyInPandas(_search(span), "rec long, s long, e long")
    if kept.where("is_hot").limit(1).count():
        w = with_text(kept.where("is_hot")).mapInArrow(_windows(span, k), "rec long, at long, w binary")
        again = w.groupBy("w").agg(F.min("rec").alias("a"), F.max("rec").alias("b")).where("a <> b").select("w")
        found = found.unionByName(w.join(again, "w", "left_semi").select("rec", F.col("at").alias("s"), (F.col("at") + span).alias("e")))
    order = Window.partitionBy("rec").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("fresh", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    numbered = marked.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("rec", "run").agg(F.min("s").alias("start"), F.max("e").alias("stop"))
    return runs.select("rec", "start", (F.col("stop") - F.col("start")).alias("length"))


def shared_share(records: DataFrame, rec: str, text: str, **options) -> DataFrame:
    """(rec, n_letters, n_shared, share) of every record; 0 where nothing is shared."""
    runs = shared_runs(records, rec, text, **options).groupBy("rec").agg(F.sum("length").alias("n_shared"))
    sizes = records.select(F.col(rec).cast("long").alias("rec"), F.col(text).alias("t")).where("rec is not null and t is not null").groupBy("rec").agg(F.length(F.max("t")).cast("long").alias("n_letters"))
    out = sizes.join(runs, "rec", "left").select("rec", "n_letters", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
    return out.withColumn("share", F.when(F.col("n_letters") > 0, F.col("n_shared") / F.col("n_letters")).otherwise(0.0))

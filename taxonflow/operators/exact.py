"""Exact per-read classification: greedy seed cover on both strands against a suffix array of the references.

Up to ``MOST_LETTERS`` letters one index is sent to each task. Beyond that the references are cut into shards of bounded
letters, whose indexes are built in tasks, written to the shared folder and read there through memory maps; each step
takes the longest match over all shards and the sum of its places, so the rows are the same for any size. Time grows with
reads times shards. Sequences are kept apart by separators, so no match crosses a junction.
The per-read steps are sequential by nature and run in one Arrow-batched call.
"""

from __future__ import annotations

import atexit
import mmap
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxonflow.session import cut_lineage, shared_folder

MOST_LETTERS = 10_000_000
SHARD_LETTERS = 4_000_000
FIRST = 10  #: letters looked up at once before a match is extended
BASE = 15  #: letters that do not count in a score


@dataclass
class Reference:
    """Suffix array over the reversed references, so that a match grows to the left of a read by prefix search."""

    ids: list[int]
    texts: list[str]
    text: bytes = field(init=False)

    def __post_init__(self):
        self.text = b"\x00".join(t.upper()[::-1].encode("ascii", "replace") for t in self.texts) + b"\x00"
        data = np.frombuffer(self.text, np.uint8)
        n = len(data)
        rank = data.astype(np.int64)
        step = 1
        sa = np.argsort(rank, kind="stable")
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[: n - step] = rank[step:] + 1 if step < n else 0
            sa = np.lexsort((nxt, rank))
            new = np.ones(n, np.int64)
            new[1:] = (rank[sa][1:] != rank[sa][:-1]) | (nxt[sa][1:] != nxt[sa][:-1])
            rank2 = np.empty(n, np.int64)
            rank2[sa] = np.cumsum(new) - 1
            rank, step = rank2, step * 2
            if rank.max() == n - 1 or step >= n:
                break
        ends = np.cumsum([len(t) + 1 for t in self.texts])
        self.sa, self.owner = sa.astype(np.int32), np.searchsorted(ends, sa, side="right").astype(np.int32)
        self.texts = []

    def _bound(self, p: bytes, upper: bool) -> int:
        lo, hi, m = 0, len(self.sa), len(p)
        while lo < hi:
            mid = (lo + hi) // 2
            s = int(self.sa[mid])
            t = self.text[s : s + m]
            if t < p or (upper and t == p):
                lo = mid + 1
            else:
                hi = mid
        return lo

    def longest(self, p: bytes) -> tuple[int, int, int]:
        """Length and suffix interval of the longest prefix of p that stands in the text."""
        at = self._bound(p, False)
        best = 0
        for i in (at - 1, at):
            if 0 <= i < len(self.sa):
                s = int(self.sa[i])
                t = self.text[s : s + len(p)]
                k = 0
                while k < len(t) and t[k] == p[k]:
                    k += 1
                best = max(best, k)
        if not best:
            return 0, 0, 0
        return best, self._bound(p[:best], False), self._bound(p[:best], True)


    def owners(self, h: Hit) -> np.ndarray:
        """The reference of each place of a hit."""
        return self.owner[h.lo : h.hi]


_CODE = np.zeros(256, np.int64)
_CODE[list(b"ACGT")] = range(4)
_DIGITS = bytes.maketrans(b"ACGT", b"0123")


def _code(p: bytes) -> int:
    """Letters as a number that sorts as they do."""
    return int(p.translate(_DIGITS), 4)


def shard_bytes(pieces: list[tuple[int, str, int]]) -> bytes:
    """The index of (reference, piece, letters of its own): only matches whose right end lies in the own letters, which
    are the last of the piece, have a place here; the letters before them let those matches grow to the left."""
    ref = Reference([], [t for _, t, _ in pieces])
    begin = np.cumsum([0, *[len(t) + 1 for _, t, _ in pieces]])[:-1]
    own, ids = np.array([c for _, _, c in pieces]), np.array([i for i, _, _ in pieces], np.int64)
    data = np.frombuffer(ref.text, np.uint8)
    good = np.zeros(256, bool)
    good[list(b"ACGT")] = True
    run = np.concatenate([[0], np.cumsum(good[data], dtype=np.int32)])
    whole = np.zeros(len(data), bool)  # starts of FIRST good letters
    if len(data) >= FIRST:
        whole[: len(data) - FIRST + 1] = run[FIRST:] - run[:-FIRST] == FIRST
    keep = whole[ref.sa] & (ref.sa - begin[ref.owner] < own[ref.owner])
    sa, owner = ref.sa[keep], ref.owner[keep]
    width = min(FIRST, max(1, len(sa).bit_length() // 2))  # letters of the bucket table, which follows the shard's size
    code = np.zeros(len(sa), np.int64)
    for i in range(width):
        code = code * 4 + _CODE[data[sa + i]]
    bucket = np.searchsorted(code, np.arange(4**width + 1)).astype(np.int32)
    return b"".join([np.array([len(sa), width, len(ids)], np.int64).tobytes(), ids.tobytes(), bucket.tobytes(), sa.tobytes(), owner.tobytes(), ref.text])


class Shard:
    """One shard's index over a memory map of its file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, self.width, pieces = (int(x) for x in np.frombuffer(self.raw, np.int64, 3))
        self.ids = np.frombuffer(self.raw, np.int64, pieces, 24)
        self.bucket = np.frombuffer(self.raw, np.int32, 4**self.width + 1, at := 24 + 8 * pieces)
        self.sa = np.frombuffer(self.raw, np.int32, n, at := at + 4 * len(self.bucket))
        self.owner = np.frombuffer(self.raw, np.int32, n, at := at + 4 * n)
        self.text = at + 4 * n

    def _bound(self, p: bytes, upper: bool, lo: int, hi: int) -> int:
        m = len(p)
        while lo < hi:
            mid = (lo + hi) // 2
            s = self.text + int(self.sa[mid])
            t = self.raw[s : s + m]
            if t < p or (upper and t == p):
                lo = mid + 1
            else:
                hi = mid
        return lo

    def longest(self, p: bytes, lo: int, hi: int) -> int:
        """Length of the longest prefix of p among the suffixes lo to hi."""
        at, best = self._bound(p, False, lo, hi), 0
        for i in (at - 1, at):
            if lo <= i < hi:
                s = self.text + int(self.sa[i])
                t = self.raw[s : s + len(p)]
                k = len(p) if t == p else len(os.path.commonprefix([t, p]))
                best = max(best, k)
        return best


class Shards:
    """All shards as one reference; a match is looked for in each and its places are added up."""

    def __init__(self, paths: list[str]):
        self.shards = [Shard(p) for p in paths]
        self.widths = {s.width for s in self.shards}

    def longest(self, p: bytes) -> tuple[int, int, int, list[tuple[Shard, int, int]]]:
        """Length of the longest prefix of p (of at least FIRST letters), 0, its number of places and their shards' intervals."""
        best, among, codes = 0, [], {w: _code(p[:w]) for w in self.widths}
        for s in self.shards:
            code = codes[s.width]
            lo, hi = int(s.bucket[code]), int(s.bucket[code + 1])
            if lo < hi:
                k = s.longest(p, lo, hi)
                if k > best:
                    best, among = k, []
                if k == best:
                    among.append((s, lo, hi))
        parts = [(s, s._bound(p[:best], False, lo, hi), s._bound(p[:best], True, lo, hi)) for s, lo, hi in among]
        return best, 0, sum(hi - lo for _, lo, hi in parts), parts

    def owners(self, h: Hit) -> np.ndarray:
        return np.concatenate([s.ids[s.owner[lo:hi]] for s, lo, hi in h.parts]) if h.parts else np.zeros(0, np.int64)


@lru_cache(1)
def _opened(paths: tuple[str, ...]) -> Shards:
    return Shards([*paths])


@dataclass
class Hit:
    off: int  #: from the right end of the strand
    length: int
    lo: int = 0
    hi: int = 0
    parts: list = field(default_factory=list)  #: (shard, lo, hi) where the references are sharded

    @property
    def size(self) -> int:
        return self.hi - self.lo


def match_at(ref: Reference | Shards, rev: bytes, d: int) -> tuple[Hit, int, bool]:
    """The match that starts d letters from the right end: hit, next cursor, whether the read is finished."""
    n = len(rev)
    if n - d < FIRST:
        return Hit(d, n - d), n, True
    bad = next((i for i in range(FIRST) if rev[d + i : d + i + 1] not in (b"A", b"C", b"G", b"T")), None)
    if bad is not None:
        return Hit(d, bad + 1), d + bad + 1, d + bad + 1 >= n
    stop = d + FIRST
    while stop < n and rev[stop : stop + 1] in (b"A", b"C", b"G", b"T"):
        stop += 1
    length, lo, hi, *parts = ref.longest(rev[d:stop])
    if length < FIRST:
        return Hit(d, FIRST), d + FIRST, d + FIRST >= n
    return Hit(d, length, lo, hi, *parts), d + length, d + length >= n


def cover(ref: Reference | Shards, rev: bytes, m: int) -> list[Hit]:
    """Greedy cover of one strand."""
    n, skip = len(rev), (FIRST if 2 * m <= 33 else 2 * m - 33)
    out, cursor, done = [], 0, False
    while not done:
        hit, cursor, done = match_at(ref, rev, cursor)
        out.append(hit)
        if not done and hit.length > skip:
            cursor += 1
        if not done and cursor + m >= n and hit.length > 3:
            break
        if cursor >= n:
            break
    return out


def corrected(ref: Reference | Shards, strands: list[list[Hit]], revs: list[bytes], m: int, cap: int) -> None:
    """Overlapping, non-nested hits of the two strands are searched again from the other's edge and taken if the match is
    their union; the same span on both strands with too many places is dropped."""
    n = len(revs[0])
    # spans in forward coordinates
    span = lambda h, s: (n - h.off - h.length, n - h.off) if s == 0 else (h.off, h.off + h.length)
    for i, f in enumerate(strands[0]):
        for j, r in enumerate(strands[1]):
            if f.length < m or r.length < m:
                continue
            (a, b), (c, e) = span(f, 0), span(r, 1)
            if max(a, c) >= min(b, e) or (a <= c and e <= b) or (c <= a and b <= e):
                continue
            whole = max(b, e) - min(a, c)
            for s, off in ((0, n - max(b, e)), (1, min(a, c))):
                hit, _, _ = match_at(ref, revs[s], off)
                if hit.length == whole:
                    strands[s][i if s == 0 else j] = hit
    for f in strands[0]:
        for r in strands[1]:
            if f.length and r.length and f.length >= m and span(f, 0) == span(r, 1) and f.size + r.size > cap:
                f.length = r.length = 0


def untangled(hits: list[Hit]) -> None:
    """Overlaps within a strand: the longer hit keeps the overlap."""
    for a, b in zip(hits, hits[1:]):
        over = a.off + a.length - b.off
        if over > 0 and a.length and b.length:
            if a.length >= b.length:
                b.off, b.length = b.off + over, max(0, b.length - over)
            else:
                a.length = max(0, a.length - over)


def classify_read(ref: Reference | Shards, mates: list[str], m: int = 22, k: int = 5, cap: int | None = None, excluded: frozenset = frozenset()) -> tuple[dict[int, tuple[int, int]], int]:
    """({ref number: (score, hit length)}, greatest possible score) of a read or pair."""
    cap = cap or max(k, 5) * 40
    score = lambda n: (n - BASE) ** 2 if n > BASE else 0
    comp = str.maketrans("ACGTN", "TGCAN")
    sums: dict[tuple[int, int, int], list[int]] = {}
    budget = k
    for mate, seq in enumerate(mates):
        fw = seq.upper()
        revs = [fw[::-1].encode("ascii", "replace"), fw.translate(comp).encode("ascii", "replace")]
        strands = [cover(ref, r, m) for r in revs]
        if all(sum(h.length for h in s if h.length >= m) >= m for s in strands):
            corrected(ref, strands, revs, m, cap)
        for s in strands:
            untangled(s)
        total = [sum(score(h.length) for h in s if h.length >= m) for s in strands]
        most = [max((h.length for h in s if h.length >= m), default=0) for s in strands]
        order = sorted((0, 1), key=lambda s: (-total[s], -most[s]))
        use = order if total[0] == total[1] and most[0] == most[1] else order[:1]
        for s in use:
            hits = [h for h in strands[s] if h.length > m and h.size > 0]
            largest = max((h.size for h in strands[s] if h.length >= m), default=0)
            if largest > budget:
                budget = largest + k if largest > k else largest
            hits.sort(key=lambda h: (h.size, -h.length, h.off))
            seen = 0
            for h in hits:
                if h.size > cap:
                    continue
                places = ref.owners(h)[: max(0, budget)]
                for r in sorted({int(x) for x in places} - excluded):
                    got = sums.setdefault((r, mate, s), [0, 0])
                    got[0] += score(h.length)
                    got[1] += h.length
                seen += len(places)
                if seen >= budget:
                    break
    out: dict[int, tuple[int, int]] = {}
    for r in {key[0] for key in sums}:
        sc = ln = 0
        for mate in range(len(mates)):
            sc += max(sums.get((r, mate, 0), [0, 0])[0], sums.get((r, mate, 1), [0, 0])[0])
            ln += max(sums.get((r, mate, 0), [0, 0])[1], sums.get((r, mate, 1), [0, 0])[1])
        out[r] = (sc, ln)
    return out, sum(score(len(s)) for s in mates)


def classify(reads: DataFrame, refs: DataFrame, m: int = 22, k: int = 5, exclude: list[int] | None = None) -> DataFrame:
    """(read_id, ref_id, tid, score, hit_len, max_score) of every entry of every read.

    ``reads`` has read_id, seq and optionally seq2; ``refs`` has ref_id, tid, bases. Null reads match nothing.
    """
    refs = refs.where("bases is not null")
    letters = refs.agg(F.coalesce(F.sum(F.length("bases")), F.lit(0))).first()[0]
    if letters > MOST_LETTERS:
        return _sharded(reads, refs, m, k, exclude or [])
    rows = refs.select("ref_id", "tid", "bases").orderBy("ref_id").collect()  # at most MOST_LETTERS letters
    ids, tids = [r[0] for r in rows], [r[1] for r in rows]
    index = reads.sparkSession.sparkContext.broadcast(Reference(ids, [r[2] for r in rows]) if rows else None)  # about ten bytes a letter
    out_of = frozenset(i for i, t in enumerate(tids) if t in set(exclude or []))
    return _classified(reads, lambda: index.value, m, k, out_of, lambda r: (ids[r], tids[r]), "read_id long, ref_id long, tid long, score long, hit_len long, max_score long")


def _classified(reads: DataFrame, opened, m: int, k: int, out_of: frozenset, named, schema: str) -> DataFrame:
    paired = "seq2" in reads.columns
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref = opened()
        for p in parts:
            out = []
            for x in p.itertuples(index=False):
                mates = [s for s in ([x.seq, x.seq2] if paired else [x.seq]) if isinstance(s, str) and s]
                if ref is None or not mates:
                    continue
                got, top = classify_read(ref, mates, m, k, None, out_of)
                out += [(x.read_id, *named(r), s, n, top) for r, (s, n) in sorted(got.items())]
            yield pd.DataFrame(out, columns=columns)

    return reads.select("read_id", "seq", *(["seq2"] if paired else [])).mapInPandas(run, schema)


def _sharded(reads: DataFrame, refs: DataFrame, m: int, k: int, exclude: list[int]) -> DataFrame:
    """The same rows for references of any size."""
    spark = reads.sparkSession
    longest = reads.agg(*[F.coalesce(F.max(F.length(c)), F.lit(0)) for c in ("seq", "seq2") if c in reads.columns]).first()
    reach, own, shard_letters = max(longest), max(1, SHARD_LETTERS // 8), SHARD_LETTERS  # a match is no longer than its read
    start = F.col("i") * own
    cut = refs.where("bases <> ''").withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.length("bases") - 1) / own).cast("int"))))
    piece = F.substring("bases", F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach)) + own)
    pieces = cut.select("ref_id", piece.alias("piece"), F.least(F.lit(own), F.length("bases") - start).cast("long").alias("own"), "i")
    shards = max(1, -(-refs.agg(F.sum(F.length("bases"))).first()[0] // (SHARD_LETTERS * 9 // 10)))

    def build(p: pd.DataFrame) -> pd.DataFrame:
        out, some, letters = [], [], 0
        for x in p.itertuples(index=False):
            if some and letters + len(x.piece) > shard_letters:
                out, some, letters = [*out, shard_bytes(some)], [], 0
            some.append((x.ref_id, x.piece, x.own))
            letters += len(x.piece)
        return pd.DataFrame({"index": [*out, shard_bytes(some)]})

    by = pieces.withColumn("shard", F.pmod(F.xxhash64("ref_id", "i"), F.lit(shards)))
    built = cut_lineage(by.groupBy("shard").applyInPandas(build, "index binary"))
    shared = shared_folder(spark).removeprefix("file:")
    if "://" in shared.lstrip("/"):
        raise ValueError(f"references beyond {MOST_LETTERS} letters need a spark.checkpoint.dir that is mounted on every machine, not {shared}")
    folder, paths = os.path.join("/", shared.lstrip("/"), f"shards-{uuid.uuid4().hex}"), []
    os.makedirs(folder)
    atexit.register(shutil.rmtree, folder, True)  # executors open the files when the plan runs
    for row in built.toLocalIterator():  # one partition's shards at a time
        paths.append(os.path.join(folder, f"shard-{len(paths)}"))
        with open(paths[-1], "wb") as f:
            f.write(row["index"])
    known, out_of = tuple(paths), frozenset(r[0] for r in refs.where(F.col("tid").isin(exclude)).select("ref_id").collect()) if exclude else frozenset()
    got = _classified(reads, lambda: _opened(known), m, k, out_of, lambda r: (r,), "read_id long, ref_id long, score long, hit_len long, max_score long")
    return got.join(refs.select("ref_id", "tid"), "ref_id").select("read_id", "ref_id", F.col("tid").cast("long").alias("tid"), "score", "hit_len", "max_score")

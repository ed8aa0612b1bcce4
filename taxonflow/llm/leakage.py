"""Evaluation passages inside a corpus, by a prefix-filtered set join.

Items are cut into windows of ``span`` words, each a set of five-word shingles. A document that holds the window holds
all its shingles, so with the shingles ordered by rarity the necessary prefix is the single rarest one. First pass: the
number of documents with each item shingle. Second pass: only the windows' rarest shingles are looked up in the
documents; the length bound (both sides must reach ``span`` words around the match) and the position of the shingle in
its window leave one place to look at, where all words are compared.

The items are the stated query set. They are read in blocks of about ``BLOCK_BYTES`` of text. A block's texts, and the
number of documents of each of its shingles, are what is sent to the tasks: about three times the text, so some 12 MB;
each task builds the look-up tables from them (some fourteen times the text) for itself. The corpus is read twice for
each block. Each document is worked on whole by one task; text is never cut.

Words are the maximal runs of ASCII letters and digits after lower-casing. Defined results: null texts and ids match
nothing; items or documents of fewer than ``span`` words match nothing; copies of a document each match; an item whose
passage other items share is listed too; repeated rows change nothing; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
SPAN = 25
BLOCK_BYTES = 4_000_000
CHUNK = 4_000_000
BASE, STEP = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F)
_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 2**64))
        for k, b in enumerate((BASE, inverse)):
            p = np.full(max(n, CHUNK), b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts in one buffer: each word's start, end, hash and text number."""
    mask = _WORD[data]
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, mask
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    left = before[:-1].copy()
    left[cuts] = False  # a text's first byte follows nothing
    right = np.zeros(len(data), bool)
    right[:-1] = mask[1:]
    right[cuts - 1] = False
    start, end = np.flatnonzero(mask & ~left), np.flatnonzero(mask & ~right) + 1
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return start, end, _mixed((total[end] - total[start]) * inverse[start]), np.searchsorted(offsets, start, side="right") - 1


def shingles(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The hash of the SHINGLE words from each word on; 0 where the text ends before."""
    n = len(hashes) - SHINGLE + 1
    out = np.zeros(len(hashes), np.uint64)
    if n > 0:
        h = hashes[:n].copy()
        for j in range(1, SHINGLE):
            h = h * STEP + hashes[j : n + j]
        h = _mixed(h) | np.uint64(1)
        h[text[:n] != text[SHINGLE - 1 :]] = 0
        out[:n] = h
    return out


def _buffers(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of whole texts: first row, bytes, offsets (as long as the texts plus one)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Lookup:
    """A set of hashes with a bit table in front."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys[keys != 0])
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.keys >> np.uint64(40)) & np.uint64((1 << 22) - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes that are members, and which member each is."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[(hashes >> np.uint64(40)) & np.uint64((1 << 22) - 1)])
        k = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[k] == hashes[at]
        return at[hit], k[hit]


class Items:
    """One block of items: their words, shingles and windows."""

    def __init__(self, ids: list[int], texts: list[bytes], span: int):
        self.given = (ids, texts, span)
        self._build(*self.given)

    def __getstate__(self):
        return self.given

    def __setstate__(self, given):
        self.given = given
        self._build(*given)

    def _build(self, ids: list[int], texts: list[bytes], span: int) -> None:
        self.ids, self.span = np.array(ids, np.int64), span
        offsets = np.cumsum([0, *map(len, texts)])
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.start, self.end, self.hash, self.item = words(self.data, offsets)
        self.shingle = shingles(self.hash, self.item)
        self.lookup = Lookup(self.shingle)
        n = len(self.hash)
        first = np.arange(max(0, n - span + 1))
        self.window = first[self.item[first] == self.item[first + span - 1]] if len(first) else first

    def prefixes(self, documents: np.ndarray) -> tuple[Lookup, np.ndarray, np.ndarray, np.ndarray]:
        """The rarest shingle of each window: look-up, and by member the windows' first words and offsets of the shingle."""
        at = self.window[:, None] + np.arange(self.span - SHINGLE + 1)
        key = np.searchsorted(self.lookup.keys, self.shingle[at]) if len(self.window) else at
        rank = documents[key].astype(np.int64) * np.int64(len(self.lookup.keys) + 1) + key  # rarity, then one fixed order
        best = rank.argmin(1) if len(self.window) else np.zeros(0, np.int64)
        chosen = self.shingle[self.window + best]
        table = Lookup(chosen)
        k = np.searchsorted(table.keys, chosen)
        order = np.argsort(k, kind="stable")
        return table, np.searchsorted(k[order], np.arange(len(table.keys) + 1)), self.window[order], best[order]


def _rarity(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(items.lookup.keys), np.int64)
        for b in batches:
            for _, data, offsets in _buffers(b.column(0)):
                _, _, h, text = words(data, offsets)
                at, k = items.lookup.find(shingles(h, text))
                pair = np.unique(text[at] * len(seen) + k) if len(at) else at
                seen += np.bincount(pair % max(1, len(seen)), minlength=len(seen)) if len(pair) else 0
        k = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(seen[k])], names=["k", "n"])

    return run


def _matches(items: Items, documents: np.ndarray):
    def one(tables: tuple, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> dict[tuple[int, int], int]:
        table, first, window, offset = tables
        start, end, h, text = words(data, offsets)
        at, k = table.find(shingles(h, text))
        if not len(at):
            return {}
        many = first[k + 1] - first[k]
        at = np.repeat(at, many)
        w = np.repeat(first[k], many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        begin, q = at - offset[w], window[w]
        fits = (begin >= 0) & (begin + items.span <= len(h))
        fits[fits] = (text[begin[fits]] == text[at[fits]]) & (text[begin[fits] + items.span - 1] == text[at[fits]])
        begin, q = begin[fits], q[fits]
        for j in range(items.span):
            same = h[begin + j] == items.hash[q + j]
            begin, q = begin[same], q[same]
        found: dict[tuple[int, int], int] = {}
        runs: dict[tuple[int, int, int], int] = {}
        for d, p in sorted(zip(begin.tolist(), q.tolist())):
            if data[start[d] : end[d + items.span - 1]].tobytes() != items.data[items.start[p] : items.end[p + items.span - 1]].tobytes() and any(
                data[start[d + j] : end[d + j]].tobytes() != items.data[items.start[p + j] : items.end[p + j]].tobytes() for j in range(items.span)
            ):
                continue
            key = (int(ids[text[d]]), int(items.ids[items.item[p]]))
            line = (text[d], items.item[p], d - p)  # consecutive windows on one diagonal make one run
            last = runs.get((*line, d - 1), 0)
            runs[(*line, d)] = length = last + 1 if last else items.span
            found[key] = max(found.get(key, 0), length)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = items.prefixes(documents)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for a, data, offsets in _buffers(b.column(1)):
                found = one(tables, data, offsets, ids[a:])
                if found:
                    doc, item = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array([*found.values()], pa.int64())], names=["doc_id", "item_id", "n_words"])

    return run


def leaks(docs: DataFrame, items: DataFrame, span: int = SPAN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_words): documents holding at least ``span`` consecutive words of an item, with the longest run.

    ``docs`` has doc_id and text, ``items`` item_id and text. span is at least the shingle length.
    """
    if span < SHINGLE:
        raise ValueError(f"span must be at least {SHINGLE}")
    corpus = docs.where("doc_id is not null and text is not null").select("doc_id", F.lower("text").alias("text"))
    known = items.where("item_id is not null and text is not null").select("item_id", F.lower("text").alias("text"))
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for k in range(blocks):
        rows = (known if blocks == 1 else known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)).collect()  # about block_bytes of text
        block = Items([r[0] for r in rows], [r[1].encode() for r in rows], span)
        documents = np.zeros(len(block.lookup.keys) + 1, np.int32)
        if len(block.window):
            counted = corpus.select("text").mapInArrow(_rarity(block), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
            for r in counted.collect():  # at most one row for each item shingle of the block
                documents[r[0]] = r[1]
        part = corpus.mapInArrow(_matches(block, documents), "doc_id long, item_id long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))

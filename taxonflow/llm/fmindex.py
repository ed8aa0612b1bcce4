"""A compressed FM-index over a shard of sequence segments: wavelet bit vectors, backward search, matching statistics.

Beside the wavelet bits, about 24 bytes a letter in 32-bit arrays say which record a suffix is of and how an interval
widens. The text is the shard's segments, each followed by a separator of its own. Letters are 1 to 4 (A, C, G, T); separators
and all other letters are 0 and match nothing. The Burrows-Wheeler transform is kept in a wavelet matrix of packed bit
vectors with running counts. All operations work on arrays of queries at once.
"""

from __future__ import annotations

import numpy as np

LETTERS = 3  #: bits of a letter


class BitVector:
    """Packed bits with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))]).astype(np.int32)
        self.zeros = n - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        below = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(below)


class WaveletMatrix:
    def __init__(self, codes: np.ndarray):
        self.levels = []
        for b in range(LETTERS - 1, -1, -1):
            bits = (codes >> b) & 1
            self.levels.append(BitVector(bits))
            codes = np.concatenate([codes[bits == 0], codes[bits == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i codes come after c's place in the last level: rank plus the code's own offset."""
        for b, level in zip(range(LETTERS - 1, -1, -1), self.levels):
            one = level.ones(i)
            i = np.where((c >> b) & 1 == 1, level.zeros + one, i - one)
        return i


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes in order, every 0 of the text being a separator of its own (earlier ones are smaller), by prefix doubling
    from packed letters; and the packed keys of 1, 2, 4, ... letters used to compare suffixes."""
    n = len(text)
    tail = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, n), x.dtype)])[:n]
    key, ended, keys = text.astype(np.int64), text == 0, []
    width = 1
    while True:
        keys.append((width, key))
        if width == 16:
            break
        key, ended, width = key * 5**width + np.where(ended, 0, tail(key, width)), ended | tail(ended, width), width * 2
    if n:
        ended[max(0, n - 16) :] = True  # the text ends with a separator
    second = np.where(ended, np.arange(n), -1)
    sa = np.lexsort((second, key))
    new = np.ones(n, bool)
    new[1:] = (key[sa][1:] != key[sa][:-1]) | (second[sa][1:] != second[sa][:-1])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 16
    while True:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            return sa, keys
        s = sa[tied]
        group, nxt = rank[s], rank[np.minimum(s + step, n - 1)]
        order = np.lexsort((nxt, group))
        s, group, nxt = s[order], group[order], nxt[order]
        sa[tied] = s
        fresh = np.ones(len(s), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])
        new[tied] = fresh
        rank[s] = np.maximum.accumulate(np.where(fresh, tied, 0))
        step *= 2


def common_prefixes(sa: np.ndarray, text: np.ndarray, keys: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """lcp[i]: letters that suffixes i - 1 and i share before any separator; -1 at both ends."""
    n = len(sa)
    lcp = np.full(n + 1, -1, np.int64)
    if n < 2:
        return lcp
    a, b = sa[:-1].copy(), sa[1:].copy()
    size, live = np.zeros(n - 1, np.int64), np.arange(n - 1)
    after = np.append(np.flatnonzero(text == 0), n)
    end = after[np.searchsorted(after, np.arange(n))]  # the next separator
    width, key = keys[-1]
    while len(live):
        x, y = a[live] + size[live], b[live] + size[live]
        ok = (x < n) & (y < n)
        ok[ok] = (key[x[ok]] == key[y[ok]]) & (end[x[ok]] - x[ok] >= width) & (end[y[ok]] - y[ok] >= width)
        live = live[ok]
        size[live] += width
    for width, key in reversed(keys[:-1]):
        x, y = np.minimum(a + size, n - 1), np.minimum(b + size, n - 1)
        ok = (key[x] == key[y]) & (end[x] - x >= width) & (end[y] - y >= width)
        size[ok] += width
    lcp[1:n] = size
    return lcp


def nearest_smaller(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the nearest one before and after it with a smaller value (itself at the ends)."""

    def before(v: np.ndarray) -> np.ndarray:
        p = np.maximum(np.arange(len(v)) - 1, 0)
        live = np.flatnonzero(v[p] >= v)
        live = live[live > 0]
        while len(live):
            p[live] = p[p[live]]
            live = live[(v[p[live]] >= v[live]) & (p[live] > 0)]
        return p

    last = len(lcp) - 1
    return before(lcp), last - before(lcp[::-1])[::-1]


class FMIndex:
    """Index of one shard. ``owner`` is the record number of each letter of the text."""

    def __init__(self, text: np.ndarray, owner: np.ndarray):
        self.text, self.owner, self.n = text, owner.astype(np.int32), len(text)
        sa, keys = suffix_array(text)
        lcp = common_prefixes(sa, text, keys)
        self.up, self.down = (x.astype(np.int32) for x in nearest_smaller(lcp))
        self.lcp = lcp.astype(np.int32)
        before = text[sa - 1]
        before[sa == 0] = 0
        self.wavelet = WaveletMatrix(before)
        counts = np.bincount(text, minlength=5)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        # places of the wavelet matrix's last level where each code starts
        self.base = self.wavelet.rank(np.arange(5), np.zeros(5, np.int64))
        self.doc = self.owner[sa]
        change = np.append(np.flatnonzero(np.diff(self.doc)) + 1, self.n)
        self.run_end = change[np.searchsorted(change, np.arange(self.n), side="right")].astype(np.int32)

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Backward step of an interval's border."""
        return self.first[c] + self.wavelet.rank(c, i) - self.base[c]

    def matching_statistics(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For the text's pieces [begin, end), for each of their letters: the longest match from there on, inside the piece,
        with a record of another owner. Returned as one array over the text (0 outside); pieces must not overlap."""
        out = np.zeros(self.n, np.int64)
        i, stop = end - 1, begin
        lo, hi, size = np.zeros(len(i), np.int64), np.full(len(i), self.n, np.int64), np.zeros(len(i), np.int64)
        live = np.flatnonzero(i >= stop)
        i, stop, lo, hi, size = i[live], stop[live], lo[live], hi[live], size[live]
        me = self.owner[np.minimum(i, self.n - 1)]
        while len(i):
            c = self.text[i]
            a, b = self.step(c, lo), self.step(c, hi)
            at = np.minimum(a, self.n - 1)
            ok = (c > 0) & (b > a) & ((self.doc[at] != me) | (self.run_end[at] < b))
            # letters that match nothing, and pieces that start afresh, go on by one
            none = ~ok & ((c == 0) | (size == 0))
            shrink = ~ok & ~none
            x, y = self.lcp[lo], self.lcp[hi]
            k = np.maximum(x, y)
            wide_lo, wide_hi = np.where(x == k, self.up[lo], lo), np.where(y == k, self.down[hi], hi)
            root = none | (shrink & (k <= 0))
            lo = np.where(ok, a, np.where(root, 0, np.where(shrink, wide_lo, lo)))
            hi = np.where(ok, b, np.where(root, self.n, np.where(shrink, wide_hi, hi)))
            size = np.where(ok, size + 1, np.where(root, 0, np.where(shrink, k, size)))
            out[i[ok]] = size[ok]
            i = i - (ok | none)
            live = i >= stop
            if not live.all():
                i, stop, lo, hi, size, me = i[live], stop[live], lo[live], hi[live], size[live], me[live]
        return out

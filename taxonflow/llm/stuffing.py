"""Keyword-stuffed and link-list documents, from the gaps at which terms recur.

A text is read as a sequence of terms. Stuffing strings a small vocabulary together again and again, so nearly every
term recurs within a short gap, at any place of the passage, and no function words hold it together; lists that a
program or a reader needs hardly repeat a term, and code carries punctuation. The text is cut into blocks of ``BLOCK``
terms. A block is stuffing if

- at least ``RECURRING`` of its terms occur again within ``LAG`` terms before or after, or, if at most ``NUMBERS`` numbers and
  tabs a term mark it as no table, within the text's own lag: ``REACH`` times the median gap between equal terms,
- at most ``FUNCTION`` of its terms are function words, and
- it has at most ``PUNCTUATION`` code punctuation marks a term.

The blocks found must, taken together, show a positional autocorrelation of at least ``CORRELATION`` over the lags 1 to
``LAG`` (the mean chance that two terms so far apart are the same; about the inverse of the number of terms in use; over
a longer lag it counts in proportion to that lag) and make up more than half of the text. A block of at least ``TAGS`` of
its words in hash tags counts as well, and so does a list of distinct nouns whose phrases are offers: at least ``OFFERS``
of its terms are words of trade, and hardly any quotes, colons or tabs mark it as data. Distinct keywords that neither
repeat nor are tagged, linked or offered can't be told from a word list and are no case. Of a link only the words of its path are terms, markup
tags are none, and disguises (zero-width characters, letters set apart by dots or hyphens, digits for letters) are undone
first.

Lines that hold nothing but bare links, or links titled with a few words none of which is a function word, are stuffing
by themselves where there are at least ``LINKS`` links and, before links are reduced, ``LEAST`` terms: bare hosts and
numbered paths leave no words to recur. Links in quotes or with other words beside them are no such lines.

Each document is worked on by itself and whole. Defined results: null ids and texts are never cases; texts of fewer than
``LEAST`` terms are none; repeated rows give their id once; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxonflow.llm.leakage import _buffers, _mixed, _powers

BLOCK = 32
LAG = 48
RECURRING = 0.8
FUNCTION = 0.06
PUNCTUATION = 0.25
CORRELATION = 0.02
TAGS = 0.6
REACH = 3
NUMBERS = 0.1
OFFERS = 0.12
FIELDS = 0.1
LINKS = 6
TITLE = 6
LEAST = 8

#: Words that hold sentences together, in the languages of the corpus.
FUNCTION_WORDS = """a an the of to is are was were be been and or but if then than that this these those it its we you they he she
in on at by for from with without into over not must can may should would will so as when where which who while after before until
because only each every any all some there here does do did has have had
de la le les des du el los las del der die das den und oder nicht mit von zu ist sind y o et ou est sont une un una por para con que
i z na do nie jest dla od po w""".split()

#: Words that make an offer of a noun, in the languages of the corpus.
TRADE_WORDS = """buy cheap cheapest discount discounted sale sales deal deals price prices priced offer offers shop shopping store coupon coupons
wholesale bargain bargains clearance affordable outlet shipping order online promo voucher bestseller
kaufen billig angebot angebote rabatt preis preise acheter soldes prix promotion comprar barato barata precio precios oferta ofertas descuento
tani tanie kup sklep cena ceny promocja""".split()

_TERM = np.zeros(256, bool)
_TERM[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_TERM[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"(){}[];=<>&\\$+!%^~")] = True

_FIELD = np.zeros(256, bool)
_FIELD[list(b"\"'`:\t")] = True

_LINK = re.compile(rb"https?://[^\s\"'<>()\[\]]*")
_TAG = re.compile(rb"</?[a-z][a-z0-9]*|[a-z-]+=(?=\")|/?>")
_MD_LINK = re.compile(rb"\[([^\]\n]*)\]\((https?://[^)\s]*)\)")
_ANCHOR = re.compile(rb"<a\b[^>]*href=[\"']?https?://[^>\"']*[\"']?[^>]*>([^<]*)</a>")
_BARE = re.compile(rb"(?<![\w\"'=`(\[\x80-\xff])<?https?://[^\s\"'<>()\[\]`]+>?")
_LIST_TAG = re.compile(rb"</?(?:ul|ol|li|p|br|div|td|tr|nav|h[1-6])\b[^>]*>")
_BULLET = re.compile(rb"[\s\-*+#/|>]*(?:\d+[.)])?(?:[\s\-*+#/|,;.>]|\xe2\x80[\xa2\xa3]|\xc2\xb7)*")
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_HIDDEN = re.compile("[​-‏⁠﻿­]")
_APART = re.compile(r"(?<![^\W_])(?:[^\W_][.\-]){2,}[^\W_](?![^\W_])")
_MIXED = re.compile(r"[^\W_]*[0-9][^\W_]*")
_LEET = str.maketrans("013457", "oieast")


def _plain_link(m: re.Match) -> bytes:
    """The words of a link's path, at the same length."""
    raw = m.group()
    path = raw.find(b"/", 8)
    kept = raw[path:] if path > 0 else b""
    return b" " * (len(raw) - len(kept)) + kept


def undisguised(text: str) -> str:
    """Zero-width characters removed, s.p.e.l.l.e.d words joined, digits inside words read as letters."""
    text = _APART.sub(lambda m: re.sub(r"[.\-]", "", m.group()), _HIDDEN.sub("", text))

    def letters(m: re.Match) -> str:
        w = m.group()
        digits = sum(c.isdigit() for c in w)
        return w.translate(_LEET) if digits < len(w) else w

    return _MIXED.sub(letters, text)


def prepared(raw: bytes) -> bytes:
    """A lower-cased text with its disguises undone, links and markup reduced to their words."""
    if b"\xe2\x80" in raw or b"\xef\xbb\xbf" in raw or b"\xc2\xad" in raw or re.search(rb"\b\w[.\-]\w[.\-]\w[.\-]", raw):
        text = raw.decode("utf-8", "replace")
        if len(_HIDDEN.findall(text)) + len(_APART.findall(text)) > 3:
            raw = undisguised(text).encode()
    if b"://" in raw:
        raw = _LINK.sub(_plain_link, _MD_LINK.sub(rb" \1  \2 ", raw))
    if b"</" in raw:
        raw = _TAG.sub(lambda m: b" " * len(m.group()), raw)
    return raw


def link_lines(raw: bytes) -> tuple[int, bytes]:
    """Bytes of the lines of a lower-cased text that are nothing but links, and the rest of the text."""
    known, size, links, words, rest = _function_bytes(), 0, 0, 0, []
    for line in raw.split(b"\n"):
        if b"://" in line:
            titles: list[bytes] = []
            left = _ANCHOR.sub(lambda m: titles.append(m[1]) or b" ", line)
            left, bare = _BARE.subn(b" ", _MD_LINK.sub(lambda m: titles.append(m[1]) or b" ", left))
            n = len(titles) + bare
            title = _WORD.findall(b" ".join(titles))
            if n and len(title) <= TITLE * n and known.isdisjoint(title) and _BULLET.fullmatch(_LIST_TAG.sub(b" ", left)):
                size, links, words = size + len(line) + 1, links + n, words + len(_WORD.findall(line))
                continue
        rest.append(line)
    return (min(size, len(raw)), b"\n".join(rest)) if links >= LINKS and words >= LEAST else (0, raw)


@cache
def _function_bytes() -> frozenset[bytes]:
    return frozenset(w.encode() for w in FUNCTION_WORDS)


def with_links(raw: bytes, found: tuple[float, float, bool]) -> tuple[float, float, bool]:
    """What ``shares`` found for a lower-cased text, or more if lines of links are counted besides the rest."""
    size, rest = link_lines(raw) if raw.count(b"://") >= LINKS else (0, raw)
    if not size:
        return found
    data = np.frombuffer(prepared(rest), np.uint8)
    share, correlation, listed = shares(data, np.array([0, len(data)]))[0]
    other = share * len(rest)
    return max(found, ((size + other) / len(raw), correlation, listed or size >= other))


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, hash and text number of the terms: runs of letters and digits that are not all digits."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z
    mask = _TERM[data]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    left, right = np.zeros(len(data), bool), np.zeros(len(data), bool)
    left[1:], right[:-1] = mask[:-1], mask[1:]
    left[cuts], right[cuts - 1] = False, False
    start, end = np.flatnonzero(mask & ~left), np.flatnonzero(mask & ~right) + 1
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int32)])
    keep = digits[end] - digits[start] < end - start
    start, end = start[keep], end[keep]
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return start, end, _mixed((total[end] - total[start]) * inverse[start]), np.searchsorted(offsets, start, side="right") - 1


@cache
def _hashes(words: tuple[str, ...]) -> np.ndarray:
    raw = [w.encode() for w in words]
    return np.unique(terms(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))[2])


def _among(h: np.ndarray, words: list[str]) -> np.ndarray:
    known = _hashes(tuple(words))
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def own_lags(h: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The lag of each of n texts: ``REACH`` times the median gap between equal terms, at least ``LAG``, at most half the text."""
    order = np.argsort(h, kind="stable")
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    gap, owner = np.diff(order)[same], text[order][1:][same]
    by = np.lexsort((gap, owner))
    gap, first = gap[by], np.searchsorted(owner[by], np.arange(n + 1))
    many = np.diff(first)
    out = np.full(n, LAG)
    some = many > 0
    out[some] = REACH * gap[first[:-1][some] + many[some] // 2]
    return np.maximum(LAG, np.minimum(out, np.bincount(text, minlength=n) // 2))


def recurring(h: np.ndarray, text: np.ndarray, lag: int | np.ndarray = LAG) -> np.ndarray:
    """Whether each term stands again within ``lag`` terms (one number, or one of each text) before or after, in the same text."""
    order = np.argsort(h, kind="stable")  # by term, then place
    most = lag[text[order][1:]] if isinstance(lag, np.ndarray) else lag
    near = (h[order][1:] == h[order][:-1]) & (np.diff(order) <= most) & (text[order][1:] == text[order][:-1])
    out = np.zeros(len(h), bool)
    out[order[1:][near]] = True
    out[order[:-1][near]] = True
    return out


def autocorrelation(h: np.ndarray, lag: int = LAG) -> float:
    """Mean over the lags of the share of equal terms so far apart."""
    top = min(lag, len(h) - 1)
    return float(np.mean([np.mean(h[k:] == h[:-k]) for k in range(1, top + 1)])) if top > 0 else 0.0


def shares(data: np.ndarray, offsets: np.ndarray) -> list[tuple[float, float, bool]]:
    """(share of the text that is stuffing, its autocorrelation over ``LAG`` lags, whether most of it is tags or offers,
    which need no regular repetition) of each text."""
    start, end, h, text = terms(data, offsets)
    n = len(offsets) - 1
    out = [(0.0, 0.0, False)] * n
    if not len(h):
        return out
    first = np.searchsorted(text, np.arange(n + 1))
    many = np.diff(first)
    is_function, is_trade = _among(h, FUNCTION_WORDS), _among(h, TRADE_WORDS)
    lag = own_lags(h, text, n)
    again, far = recurring(h, text), recurring(h, text, lag)
    tagged = np.zeros(len(h), bool)
    tagged[start > 0] = data[start[start > 0] - 1] == ord("#")
    tagged |= np.concatenate([[False], tagged[:-1] & (data[np.minimum(end[:-1], len(data) - 1)] == ord("_")) & (start[1:] == end[:-1] + 1)])
    for _ in range(4):  # later words of one tag
        tagged[1:] |= tagged[:-1] & (start[1:] == end[:-1] + 1) & (data[np.minimum(end[:-1], len(data) - 1)] == ord("_"))
    # blocks of BLOCK terms; a rest of less than half a block belongs to the block before
    place = np.arange(len(h)) - first[text]
    number = np.minimum(place // BLOCK, np.maximum(0, (many[text] + BLOCK // 2) // BLOCK - 1))
    fresh = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (np.diff(number) != 0)))
    size = np.diff(np.append(fresh, len(h)))
    owner = text[fresh]
    stop = np.append(start[fresh[1:]], 0)
    last = np.append(owner[1:] != owner[:-1], True)
    stop[last] = offsets[owner[last] + 1]
    add = lambda x: np.add.reduceat(x.astype(np.int64), fresh)
    marks = np.concatenate([[0], np.cumsum(_MARKS[data], dtype=np.int64)])
    punctuation = marks[stop] - marks[start[fresh]]
    inside = lambda x: (c := np.concatenate([[0], np.cumsum(x, dtype=np.int64)]))[stop] - c[start[fresh]]
    digit = _DIGIT[data]
    word = _TERM[data] & ~digit
    alone = digit & ~np.append(False, digit[:-1]) & ~np.append(False, word[:-1])  # starts of numbers
    numbers, fields = inside(alone | (data == ord("\t"))), inside(_FIELD[data])
    mixed = (add(again) >= RECURRING * size) | (add(tagged) >= TAGS * size)
    wide = (add(far) >= RECURRING * size) & (numbers <= NUMBERS * size)
    offered = (add(is_trade) >= OFFERS * size) & (fields <= FIELDS * size)
    stuffed = (add(is_function) <= FUNCTION * size) & (punctuation <= PUNCTUATION * size) & (mixed | wide | offered)
    span = np.bincount(owner, weights=np.where(stuffed, stop - start[fresh], 0), minlength=n)
    length = np.diff(offsets)
    in_stuffed, is_wide = np.repeat(stuffed, size), np.repeat(stuffed & ~mixed & ~offered, size)
    sure = tagged | np.repeat(offered & ~mixed, size)
    for d in np.flatnonzero((span > 0) & (many >= LEAST)):
        s = slice(first[d], first[d + 1])
        part = h[s][in_stuffed[s]]
        over = int(lag[d]) if is_wide[s].any() else LAG
        out[d] = (span[d] / max(1, length[d]), autocorrelation(part, over) * over / LAG, bool(np.mean(sure[s][in_stuffed[s]]) >= TAGS))
    return out


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, share, correlation, listed) of the documents with any stuffing; ``listed``: most of it is tags, offers or lines
    of links."""
    corpus = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.lower("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            raw = b.column(1).cast(pa.large_binary()).to_pylist()
            texts = pa.array([prepared(t) for t in raw], pa.large_binary())
            for a, data, offsets in _buffers(texts):
                s = [with_links(t, x) for t, x in zip(raw[a:], shares(data, offsets))]
                hit = [i for i, x in enumerate(s) if x[0] > 0]
                if hit:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:][hit]), pa.array([s[i][0] for i in hit]), pa.array([s[i][1] for i in hit]), pa.array([s[i][2] for i in hit])], names=["doc_id", "share", "correlation", "listed"])

    return corpus.mapInArrow(run, "doc_id long, share double, correlation double, listed boolean")


def stuffed(docs: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id) of the documents of which more than ``share`` is stuffing."""
    return scores(docs).where((F.col("share") > share) & ((F.col("correlation") >= CORRELATION) | F.col("listed"))).select("doc_id").distinct()

"""Sequence and identifier functions as column expressions, and packed k-mers for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Complements of the nucleotide letters.
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTN", "TGCAN"
# Rank names and the slots of the canonical path.
SLOTS = {"strain": 0, "subspecies": 0, "species": 1, "genus": 2, "family": 3, "order": 4, "class": 5, "phylum": 6, "kingdom": 7, "superkingdom": 8, "domain": 9}
RANK_CODES = {"species": "S", "genus": "G", "family": "F", "order": "O", "class": "C", "phylum": "P", "kingdom": "K", "superkingdom": "D"}
SLOT_COUNT = 10


def cleaned(seq: Column) -> Column:
    """Upper case; every letter other than A, C, G, T is N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), COMPLEMENT_FROM, COMPLEMENT_TO))


def trimmed(seq: Column, five: int, three: int) -> Column:
    """Bases dropped from both ends; empty when nothing is left."""
    return F.substring(seq, F.lit(five + 1), F.greatest(F.length(seq) - five - three, F.lit(0)))


def n_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.regexp_replace(F.upper(seq), "[^ACGT]", ""))


def bounded_function(kind: str, constant: float, coefficient: float, x: Column) -> Column:
    """C constant, L linear, S square root, G natural logarithm."""
    x = x.cast("double")
    term = {"C": F.lit(0.0), "L": x, "S": F.sqrt(x), "G": F.log(x)}[kind]
    return F.lit(float(constant)) + F.lit(float(coefficient)) * term


def passes_n_filter(seq: Column, kind: str = "L", constant: float = 0.0, coefficient: float = 0.15) -> Column:
    return n_count(seq) <= F.floor(bounded_function(kind, constant, coefficient, F.length(seq)))


def read_name(name: Column) -> Column:
    """Cut at white space, mate suffix dropped."""
    return F.regexp_replace(F.regexp_extract(name, r"^(\S*)", 1), r"/[123]$", "")


def header_uid(header: Column) -> Column:
    """The header up to the first blank or the second pipe, without '>'."""
    return F.regexp_extract(F.regexp_replace(header, "^>", ""), r"^([^\s|]*(?:\|[^\s|]*)?)", 1)


def packed_taxid(text: Column) -> Column:
    """'a' or 'a.b' as a + b * 2^32."""
    low, high = F.regexp_extract(text, r"^(\d+)", 1), F.regexp_extract(text, r"^\d+\.(\d+)", 1)
    return F.when(low != "", low.cast("bigint") + F.when(high != "", high.cast("bigint")).otherwise(0) * (1 << 32))


def taxid_text(tid: Column) -> Column:
    high = F.shiftright(tid, 32)
    return F.when(high == 0, tid.cast("string")).otherwise(F.concat_ws(".", tid.bitwiseAND((1 << 32) - 1).cast("string"), high.cast("string")))


def rank_name(raw: Column) -> Column:
    """Spellings of a rank brought together; unknown and missing ranks are 'no rank'."""
    r = F.regexp_replace(F.lower(F.btrim(raw, F.lit(" \t"))), "_", " ")
    return F.when(r.isNull() | (r == ""), "no rank").otherwise(r)


def slot(rank: Column) -> Column:
    """The canonical path slot of a normalised rank, null for all others."""
    table = F.create_map(*[F.lit(x) for pair in SLOTS.items() for x in pair])
    return table[rank]


def rank_code(rank: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in RANK_CODES.items() for x in pair])
    return F.coalesce(table[rank], F.lit("-"))


def hit_score(length: Column) -> Column:
    """(length - 15)^2, 0 up to 15."""
    n = length.cast("bigint")
    return F.when(n > 15, (n - 15) * (n - 15)).otherwise(F.lit(0).cast("bigint"))


def phred33(qual: Column, encoding: str = "phred33") -> Column:
    """Qualities as Phred+33 text from phred33, phred64, solexa or blank-separated integers."""
    if encoding == "phred33":
        return qual
    if encoding == "int":
        return F.array_join(F.transform(F.split(F.btrim(qual), r"\s+"), lambda q: F.chr(q.cast("int") + 33)), "")
    if encoding == "phred64":
        return F.array_join(F.transform(F.split(qual, ""), lambda c: F.when(c == "", "").otherwise(F.chr(F.ascii(c) - 31))), "")
    if encoding == "solexa":
        to = lambda c: F.round(10 * F.log10(F.pow(F.lit(10.0), (F.ascii(c) - 64) / 10) + 1)).cast("int")
        return F.array_join(F.transform(F.split(qual, ""), lambda c: F.when(c == "", "").otherwise(F.chr(to(c) + 33))), "")
    raise ValueError(f"unknown quality encoding {encoding}")


_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def packed_kmers(text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and 2-bit codes of the k-mers (k <= 31) without other letters."""
    code = _CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two, out = (code & 3).astype(np.int64), np.zeros(n, np.int64)
    for j in range(k):
        out = (out << 2) | two[j : j + n]
    bad = np.concatenate([[0], np.cumsum(code == 4)])
    at = np.flatnonzero(bad[k:] == bad[:-k])
    return at, out[at]


def kmers(df: DataFrame, ident: str, seq: str, k: int) -> DataFrame:
    """(ident BIGINT, pos BIGINT, kmer BIGINT), one row for each valid k-mer of each sequence."""
    if not 0 < k <= 31:
        raise ValueError("k must be between 1 and 31")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [(i, *packed_kmers(t, k)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t]
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.full(len(p), i, np.int64) for i, p, _ in parts])), pa.array(np.concatenate([p for _, p, _ in parts])), pa.array(np.concatenate([c for _, _, c in parts]))],
                    names=["ident", "pos", "kmer"],
                )

    return df.select(F.col(ident).cast("bigint"), seq).where(F.col(ident).isNotNull() & F.col(seq).isNotNull()).mapInArrow(run, "ident long, pos long, kmer long")


LETTERS_AT_ONCE = 2**18  # letters placed_kmers turns into rows at a time


def _both_strands(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """2-bit codes of the k letters from each place on, as they stand and reverse complemented; words of 1, 2, 4, ... letters are put together."""
    word = ((code & 3).astype(np.int64), (3 - (code & 3)).astype(np.int64))
    done, out, w = 0, None, 1
    while True:
        if k & w:
            n = len(code) - done - w + 1
            out = word if out is None else ((out[0][:n] << 2 * w) | word[0][done : done + n], (word[1][done : done + n] << 2 * done) | out[1][:n])
            done += w
        if done == k:
            return out
        n = len(code) - 2 * w + 1
        word = ((word[0][:n] << 2 * w) | word[0][w : w + n], (word[1][w : w + n] << 2 * w) | word[1][:n])
        w *= 2


def _pieces(idents: list, texts: list[str | None], k: int, at_once: int) -> Iterator[list[tuple]]:
    """Groups of (ident, first place wanted, last, place of the first letter, length of the text, letters) of about ``at_once`` letters;
    a longer text comes in several pieces, each with the letter before and after its k-mers."""
    group, letters = [], 0
    for i, text in zip(idents, texts):
        raw = text.encode("ascii", "replace") if text else b""
        for start in range(0, len(raw) - k + 1, at_once):
            at = max(0, start - 1)
            part = raw[at : start + at_once + k]
            group.append((i, start, start + at_once - 1, at, len(raw), part))
            letters += len(part)
            if letters >= at_once:
                yield group
                group, letters = [], 0
    if group:
        yield group


def placed_kmers(df: DataFrame, ident: str, seq: str, k: int, form: str = "canonical", twice: bool = False) -> DataFrame:
    """(ident, at, rest, kmer), one row for each valid k-mer. ``at`` holds its place, whether it is flipped, and the codes of
    the letters beside it (4 where none of A, C, G, T is), see place(); ``rest`` is the number of letters behind it. The
    k-mer is given as it stands (``forward``), reverse complemented (``reverse``, flipped) or as the lesser of both
    (``canonical``, flipped where that is the reverse complement); with ``twice`` one that is its own reverse complement
    has a row for either."""
    if not 0 < k <= 31:
        raise ValueError("k must be between 1 and 31")
    if form not in ("canonical", "forward", "reverse"):
        raise ValueError("form is canonical, forward or reverse")

    at_once = LETTERS_AT_ONCE

    def rows(group: list[tuple]) -> list[np.ndarray]:
        code = _CODE[np.frombuffer(b"|" + b"|".join(g[5] for g in group) + b"|", np.uint8)]
        lengths = np.array([len(g[5]) + 1 for g in group])
        own = np.repeat(np.arange(len(group)), lengths)  # the piece of each place from the first letter on
        begins = np.cumsum(lengths) - lengths + 1
        i, first, last, at0, whole = (np.array([g[c] for g in group], np.int64) for c in range(5))
        bad = np.concatenate([[0], np.cumsum(code == 4)])
        x = np.flatnonzero(bad[k:] == bad[:-k])
        g = own[x - 1]
        pos = x - begins[g] + at0[g]
        wanted = (pos >= first[g]) & (pos <= last[g])
        x, g, pos = x[wanted], g[wanted], pos[wanted]
        there, back = (w[x] for w in _both_strands(code, k))
        flip = back < there if form == "canonical" else np.full(len(x), form == "reverse")
        at = (pos << 7) | (flip.astype(np.int64) << 6) | (code[x - 1].astype(np.int64) << 3) | code[x + k]
        out = [i[g], at, whole[g] - k - pos, np.where(flip, back, there)]
        if twice and form == "canonical" and (own_rc := there == back).any():
            out = [np.concatenate([c, c[own_rc] | bit]) for c, bit in zip(out, (0, 1 << 6, 0, 0))]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group in _pieces(b.column(0).to_pylist(), b.column(1).to_pylist(), k, at_once):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows(group)], names=["ident", "at", "rest", "kmer"])

    return df.select(F.col(ident).cast("bigint"), seq).where(F.col(ident).isNotNull() & F.col(seq).isNotNull()).mapInArrow(run, "ident long, at long, rest long, kmer long")


def place(at: Column) -> tuple[Column, Column, Column, Column]:
    """pos, flip, before, after of a row of placed_kmers."""
    return F.shiftright(at, 7), F.shiftright(at, 6).bitwiseAND(F.lit(1)), F.shiftright(at, 3).bitwiseAND(F.lit(7)), at.bitwiseAND(F.lit(7))


def kmer_code(kmer: Column) -> Column:
    """2-bit code of a k-mer column (k <= 31); null if another letter stands in it."""
    return F.when(F.upper(kmer).rlike("^[ACGT]+$"), F.conv(F.translate(F.upper(kmer), "ACGT", "0123"), 4, 10).cast("bigint"))

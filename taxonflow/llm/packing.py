"""Filling sequences of permitted lengths with documents: variable-capacity best fit.

Documents are measured in tokens of a public tokenizer and spread over shards by a hash of their id; each shard is packed
by itself. Within a shard the items go in falling order into the open sequence with the least room that still takes
them, whatever its length; if none does, a new sequence is opened. Of the permitted lengths that hold the item the one is
opened whose cost a token is least, filled with what is still to be placed: a sequence of length L costs
``PER_SEQUENCE`` + L + L^2 / ``ATTENTION``, a fixed part, one for each place, and one for the pairs of places. Long items so
open long sequences, short ones the length that is cheapest for them, and the last ones no more than they need. At the end
every sequence is downsized to the shortest permitted length that holds its contents. A document is cut only if it alone exceeds the longest
length, into full sequences and one rest. A shard leaves few part-filled sequences, so with ``SHARD_ROWS`` documents to
a shard the loss from sharding is far below one part in a thousand.

Defined results: null and empty texts have 0 tokens and one row without sequence; repeated rows are packed as often as
they stand there; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTHS = (512, 1024, 2048, 4096)
SHARD_ROWS = 50_000
PER_SEQUENCE, ATTENTION = 128, 8192
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-split pattern published with this vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer, loaded once for each Python worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def cost(length: int) -> float:
    return PER_SEQUENCE + length + length * length / ATTENTION


def best_fit(sizes: list[int], lengths: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """The bin of each of ``sizes`` (which fall), and each bin's contents. A bit mask of the rooms in use finds the least
    one that fits."""
    by_room: dict[int, list[int]] = {}
    rooms, where, used, rest = 0, [], [], sum(sizes)
    price = [(c, cost(c)) for c in lengths]
    for s in sizes:
        fitting = rooms >> s
        if fitting:
            room = s + (fitting & -fitting).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, b = min((p / min(c, rest), c) for c, p in price if c >= s)[1], len(used)
            used.append(0)
        used[b] += s
        rest -= s
        where.append(b)
        left = room - s
        if left:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return where, used


def pack(sizes: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each size (none above the longest length): bin, start within the bin, final length of the bin."""
    order = np.argsort(-sizes, kind="stable")
    permitted = np.array(lengths)
    where, used = best_fit(sizes[order].tolist(), lengths)
    where, final = np.array(where, np.int64), permitted[np.searchsorted(permitted, used)]
    group = np.argsort(where, kind="stable")
    upto = np.cumsum(sizes[order][group])
    head = np.flatnonzero(np.diff(where[group], prepend=-1))
    begin = upto - sizes[order][group]
    starts = begin - np.repeat(begin[head], np.diff(np.append(head, len(group))))
    bins, start = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    bins[order] = where
    start[order[group]] = starts
    return bins, start, final[bins]


def _pack_shard(lengths: tuple[int, ...]):
    top = lengths[-1]
    names = ["doc_id", "piece", "n_tokens", "token_from", "sequence", "seq_length", "seq_start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("n_tokens", "descending"), ("doc_id", "ascending")]).combine_chunks()
        shard = int(t["shard"][0].as_py())
        n = t["n_tokens"].to_numpy()
        row = np.repeat(np.arange(len(n)), np.maximum(1, -(-n // top)))
        piece = np.arange(len(row)) - np.searchsorted(row, row)
        size = np.minimum(n[row] - piece * top, top)
        full = size > 0
        bins, start, length = (np.zeros(len(row), np.int64) for _ in range(3))
        if full.any():
            bins[full], start[full], length[full] = pack(size[full], lengths)
        cols = [t["doc_id"].combine_chunks().take(pa.array(row)), piece, size, piece * top, bins + (shard << 32), length, start]
        for a in range(0, len(row), 50_000):
            s = slice(a, a + 50_000)
            arrays = [cols[0][a : a + 50_000], *(pa.array(c[s]) for c in cols[1:4]), *(pa.array(c[s], mask=~full[s]) for c in cols[4:])]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def packed(counts: DataFrame, n_rows: int, lengths: tuple[int, ...] = LENGTHS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, n_tokens, token_from, sequence, seq_length, seq_start) from (doc_id, n_tokens).

    n_rows only sets the number of shards. Each shard number is packed by one task, which holds ids and counts alone.
    """
    lengths = tuple(sorted(lengths))
    shards = max(1, -(-n_rows // shard_rows))
    spread = counts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)).cast("long"))
    apart = spread.repartitionById(shards, F.col("shard").cast("int"))
    schema = "doc_id long, piece long, n_tokens long, token_from long, sequence long, seq_length long, seq_start long"
    return apart.mapInArrow(_pack_shard(lengths), schema)


def fill(assignment: DataFrame) -> DataFrame:
    """(seq_length, n_sequences, n_tokens, fill) of a packing."""
    per = assignment.where("sequence is not null").groupBy("sequence", "seq_length").agg(F.sum("n_tokens").alias("t"))
    return per.groupBy("seq_length").agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("t").alias("n_tokens")).withColumn("fill", F.col("n_tokens") / (F.col("seq_length") * F.col("n_sequences")))


def validity(counts: DataFrame, assignment: DataFrame, longest: int = LENGTHS[-1]) -> DataFrame:
    """(n_documents, n_wrong_tokens, n_cut_early, n_overfull, n_gaps): one row that counts documents, those of which not
    every token is placed once, those cut though they fit, sequences that hold more than their length, and sequences whose
    parts leave gaps or overlap. All but the first must be 0."""
    per = assignment.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.max(F.col("token_from") + F.col("n_tokens")).alias("upto"), F.count(F.lit(1)).alias("parts"))
    j = counts.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).join(per, "doc_id", "full")
    docs = j.agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum((~F.col("n").eqNullSafe(F.col("placed")) | ~F.col("n").eqNullSafe(F.col("upto"))).cast("long")).alias("n_wrong_tokens"),
        F.sum((F.col("parts") > F.greatest(F.lit(1), F.ceil(F.col("n") / longest))).cast("long")).alias("n_cut_early"),
    )
    seq = assignment.where("sequence is not null").groupBy("sequence").agg(F.sum("n_tokens").alias("t"), F.max("seq_length").alias("l"), F.max(F.col("seq_start") + F.col("n_tokens")).alias("stop"))
    full = seq.agg(F.coalesce(F.sum((F.col("t") > F.col("l")).cast("long")), F.lit(0)).alias("n_overfull"), F.coalesce(F.sum((F.col("t") != F.col("stop")).cast("long")), F.lit(0)).alias("n_gaps"))
    return docs.na.fill(0).join(F.broadcast(full))

"""Operator 3: vector best-fit packing of documents into training sequences.

Documents become pieces of at most ``tokens`` ids (only longer documents are
cut; the first piece may be shorter).  A full piece is a sequence by itself.
The other pieces are dealt at random to groups of about ``GROUP`` pieces; each
group is packed in one task by best fit over three capacities, tokens,
documents and attention cost (the sum of squared lengths).  Items go in order
of falling length to the bin that scores best among those where every capacity
suffices: by least weighted norm of what would remain, or by largest weighted
dot product of demand and residual.  Only (id, piece, length) rows are grouped;
the last bins of a group cost less than 0.1 % of its sequences.

Defined results.  A null or empty text is the end mark alone (one token).
The string of an added token of the vocabulary is that token.  Repeated rows are
packed each.  Empty tables give an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batches, materialise
from .tokens import encoder

TOKENS = 2048
#: Documents of a sequence: by default as many as it has tokens, so no limit.
DOCUMENTS = TOKENS
END = 0
#: Pieces packed together in one task.
GROUP = 1 << 15


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes the remainder."""
    head = n % size if n > size else n
    starts = ([0] if head else []) + list(range(head, n, size))
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], n])]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = TOKENS,
           end: int = END, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every row."""
    def run(batches):
        encode = encoder(vocabulary, added=True)
        for b in as_batches()(batches):
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                rows += [(i, k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), size))]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: int,
             score: str = "norm", weights: tuple[float, float, float] = (1.0, 0.25, 0.25)) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item.  Items of one length are placed together:
    the best bin takes them until one of its capacities is used up (it only
    gets better with each), then the next best; what fits nowhere opens bins."""
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    cap = np.array([tokens, documents, attention], np.float64)
    w = np.asarray(weights)
    free = np.empty((n, 3), np.int64)
    made = 0
    alive = np.empty(0, np.int64)  # bins that can still take the shortest item
    order = np.argsort(-lengths, kind="stable")
    sizes, firsts = np.unique(-lengths[order], return_index=True)
    least = int(lengths.min()) if n else 0
    for size, first, last in zip(-sizes, firsts, [*firsts[1:], n]):
        need = np.array([size, 1, size * size], np.int64)
        todo = order[first:last]
        room = (free[alive] // need).min(axis=1) if len(alive) else np.empty(0, np.int64)
        fit = room > 0
        if fit.any():
            cand, room = alive[fit], room[fit]
            r, x = free[cand] / cap, need / cap
            rank = np.argsort(((r - x) ** 2 * w).sum(axis=1) if score == "norm" else -(r * x * w).sum(axis=1), kind="stable")
            cand, room = cand[rank], room[rank]
            ends = np.cumsum(room)
            k = min(int(np.searchsorted(ends, len(todo))) + 1, len(cand))
            cand, room = cand[:k], room[:k]
            room[-1] -= max(0, int(ends[k - 1]) - len(todo))
            done = _place(todo, cand, room, size, need, free, tokens, bins, offsets)
            todo = todo[done:]
        if len(todo):
            per = int((cap // need).min())
            new = np.arange(made, made - (-len(todo) // per))
            free[new] = cap.astype(np.int64)
            room = np.full(len(new), per)
            room[-1] = len(todo) - per * (len(new) - 1)
            _place(todo, new, room, size, need, free, tokens, bins, offsets)
            made += len(new)
            alive = np.concatenate([alive, new])
        alive = alive[(free[alive] >= [least, 1, least * least]).all(axis=1)]
    return bins, offsets


def _place(todo, cand, room, size, need, free, tokens, bins, offsets) -> int:
    """Put room[i] items into bin cand[i] one after the other."""
    total = int(room.sum())
    at = np.repeat(cand, room)
    nth = np.arange(total) - np.repeat(np.cumsum(room) - room, room)
    bins[todo[:total]] = at
    offsets[todo[:total]] = tokens - free[at, 0] + nth * size
    free[cand] -= room[:, None] * need
    return total


def pack(parts: DataFrame, tokens: int = TOKENS, documents: int | None = None, attention: int | None = None,
         score: str = "norm", group: int = GROUP) -> DataFrame:
    """``parts`` (as made by :func:`pieces`) with ``sequence_id`` and ``offset``.
    ``documents`` is by default ``tokens``, ``attention`` tokens ** 2: neither
    binds unless set lower."""
    documents = tokens if documents is None else documents
    attention = tokens * tokens if attention is None else attention
    if isqrt(attention) < tokens or documents < 1:
        raise ValueError("a full piece must fit a sequence: attention >= tokens ** 2 and documents >= 1")
    parts = materialise(parts.withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = parts.filter(F.col("length") == tokens).withColumn("sequence_id", F.col("row") * 2 + 1).withColumn("offset", F.lit(0).cast("bigint"))
    short = parts.filter(F.col("length") < tokens)
    groups = max(1, -(-short.count() // group))

    def run(t: pa.Table) -> pa.Table:  # Arrow throughout: ids beside a null stay whole
        t = t.sort_by("row")
        b, o = best_fit(t.column("length").to_numpy(), tokens, documents, attention, score)
        # a group has fewer bins than pieces, far below 2 ** 31
        ids = ((t.column("group").to_numpy() << 31) + b) * 2
        return pa.table([*[t.column(c) for c in names[:5]], pa.array(ids), pa.array(o)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    dealt = short.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    packed = dealt.groupBy("group").applyInArrow(run, kinds)
    return packed.unionByName(full.select(*names))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in sequences of at most 2048 tokens."""
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage (the last): the packed pieces of the documents it gets."""
    return pack(pieces(docs))

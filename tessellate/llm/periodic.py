"""Operator 11: periodic runs of words, by enumeration of maximal pairs.

A run is a stretch of words with smallest period q that no neighbouring word
extends.  Its first period against the rest is a maximal pair: two equal word
strings at distance q whose left and whose right neighbours differ.  So the runs
of at least e periods are the maximal pairs (i, i + p) of common length l with
p <= l / (e - 1), and nothing needs to be extended: a pair at a multiple of the
period covers the same stretch, and the least distance names the period.

Per Arrow batch: words become numbers, documents without any repeated stretch
of the least depth are set aside, the others get a suffix array (prefix doubling
on the groups not yet told apart) and its LCP values (only the irreducible ones
are compared, the rest follow).  The LCP-interval tree is walked bottom-up; a
node holds its positions by stretch of text and by left word, the smaller child
is looked up in the larger one, and positions with the same left word are passed
over as one list.  Work is O(n log n) per text beside its runs, and nothing is
limited: texts, periods and numbers of runs are taken whole.

Defined results.  A null or empty text has no words, no runs and the empty
collapsed text.  Repeated rows get the same result each; a null id stays null.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, let

#: Least number of periods and of words of a run.
PERIODS, WORDS = 4, 6
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text worked on together (a longer text alone).
TOGETHER = 2 << 20
#: Nodes up to this size keep a plain list of positions.
FEW = 12


def least_depth(periods: int = PERIODS, words: int = WORDS) -> int:
    """The least common length l of a pair that can be a run: l words and a
    distance of at most l / (periods - 1) make ``words`` words."""
    depth = max(1, periods - 1)
    while depth + depth // (periods - 1) < words:
        depth += 1
    return depth


def suffix_array(codes: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by document and then by words.  ``owner`` is the
    document number of each word (rising), ``ends`` the end of its document."""
    n = len(codes)
    key = owner * (int(codes.max()) + 1) + codes
    sa = np.argsort(key, kind="stable")
    slots = np.arange(n)
    head = np.ones(n, bool)
    head[1:] = key[sa[1:]] != key[sa[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, slots, 0))
    h = 1
    while True:
        # groups of one suffix are in their place
        alone = head & np.append(head[1:], True)
        slots = slots[~alone]
        if not len(slots):
            return sa
        at = sa[slots]
        after = at + h
        second = np.where(after < ends[at], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[slots] = at
        head = np.ones(len(slots), bool)
        head[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(head, slots, 0))
        h *= 2


def common_lengths(codes: np.ndarray, owner: np.ndarray, ends: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """LCP of each suffix of ``sa`` with the one before it (0 across documents)."""
    n = len(codes)
    before = np.full(n, -1)
    before[sa[1:]] = np.where(owner[sa[1:]] == owner[sa[:-1]], sa[:-1], -1)
    first = np.ones(n, bool)
    first[1:] = owner[1:] != owner[:-1]
    at = np.arange(n)
    # a suffix whose left word equals that of its predecessor takes one less than its left neighbour
    own = (before < 0) | first | first[before] | (codes[at - 1] != codes[before - 1])
    lcp = np.zeros(n, np.int64)
    i = np.flatnonzero(own & (before >= 0))
    j, done, step = before[i], np.zeros(len(i), np.int64), 8
    while len(i):
        span = np.arange(step)
        room = np.minimum(ends[i] - i, ends[j] - j) - done
        x = codes[np.minimum((i + done)[:, None] + span, n - 1)]
        y = codes[np.minimum((j + done)[:, None] + span, n - 1)]
        differ = (x != y) | (span >= room[:, None])
        stop = differ.any(axis=1)
        lcp[i] = done + np.where(stop, differ.argmax(axis=1), step)
        i, j, done = i[~stop], j[~stop], done[~stop] + step
        step = max(8, min(4 * step, (1 << 20) // max(1, len(i))))
    source = np.maximum.accumulate(np.where(own, at, 0))
    return (lcp[source] - (at - source))[sa]


class Node:
    """Positions below a node of the tree.  Few are a list; more are kept by
    stretch of text (as wide as the greatest distance asked for, rounded up to a
    power of two) and in it by left word."""

    __slots__ = ("few", "many", "size", "shift")

    def __init__(self, position: int):
        self.few, self.many, self.size, self.shift = [position], None, 1, 0

    def positions(self):
        return self.few if self.many is None else [p for s in self.many.values() for c in s.values() for p in c]

    def spread(self, shift: int, left: list[int]) -> None:
        if self.many is not None and self.shift == shift:
            return
        held = self.positions()
        self.few, self.many, self.shift = None, {}, shift
        for p in held:
            self.many.setdefault(p >> shift, {}).setdefault(left[p], []).append(p)


def join(a: Node, b: Node, depth: int, reach: int, left: list[int], emit) -> Node:
    """The node of both children of depth ``depth``; ``emit(start, length,
    period)`` is called for each maximal pair within ``reach``."""
    if a.size < b.size:
        a, b = b, a
    if a.size + b.size <= FEW:
        for p in b.few:
            for q in a.few:
                d = p - q if p > q else q - p
                if d <= reach and left[p] != left[q]:
                    emit(min(p, q), depth + d, d)
        a.few = a.few + b.few
        a.size += b.size
        return a
    shift = max(0, int(reach - 1).bit_length())
    a.spread(shift, left)
    many = a.many
    for p in (fresh := b.positions()):
        c, s = left[p], p >> shift
        for near in (s - 1, s, s + 1):
            for other, held in many.get(near, {}).items():
                if other != c:
                    for q in held:
                        d = p - q if p > q else q - p
                        if d <= reach:
                            emit(min(p, q), depth + d, d)
    for p in fresh:
        many.setdefault(p >> shift, {}).setdefault(left[p], []).append(p)
    a.size += b.size
    return a


def walk(sa: list[int], lcp: list[int], left: list[int], periods: int, emit) -> None:
    """Bottom-up over the LCP-interval tree of neighbouring suffixes ``sa`` that
    all share the least depth; ``lcp[k]`` belongs to sa[k - 1] and sa[k]."""
    stack: list[tuple[int, Node]] = []
    for k in range(1, len(sa) + 1):
        depth = lcp[k] if k < len(sa) else 0
        node = Node(sa[k - 1])
        while stack and stack[-1][0] > depth:
            d, top = stack.pop()
            node = join(top, node, d, d // (periods - 1), left, emit)
        if stack and stack[-1][0] == depth:
            stack[-1] = (depth, join(stack[-1][1], node, depth, depth // (periods - 1), left, emit))
        else:
            stack.append((depth, node))


def find_runs(codes: np.ndarray, sizes: np.ndarray, periods: int = PERIODS, words: int = WORDS) -> list[list[tuple[int, int, int]]]:
    """For documents of ``sizes`` words, laid end to end in ``codes`` (positive
    numbers), their runs (start, length, period) by start and period."""
    if periods < 2:
        raise ValueError("a run has at least two periods")
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    depth = least_depth(periods, words)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    repeats = _with_repeats(codes, owner, depth)
    if not len(repeats):
        return out
    pick = np.zeros(len(sizes), bool)
    pick[repeats] = True
    codes, sizes, which = codes[pick[owner]], sizes[pick], np.flatnonzero(pick)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    stop = np.cumsum(sizes)
    ends, starts = stop[owner], stop - sizes
    sa = suffix_array(codes, owner, ends)
    lcp = common_lengths(codes, owner, ends, sa)
    left = np.where(np.arange(len(codes)) > starts[owner], np.roll(codes, 1), 0).tolist()
    found: dict[tuple[int, int], int] = {}

    def emit(start, length, period):
        if length >= words and period < found.get((start, length), period + 1):
            found[start, length] = period

    for first, last in _subtrees(sa, lcp, depth, periods):
        walk(sa[first:last].tolist(), lcp[first:last].tolist(), left, periods, emit)
    for (start, length), period in found.items():
        d = int(owner[start])
        out[which[d]].append((start - int(starts[d]), length, period))
    for d in which:
        out[d].sort(key=lambda r: (r[0], r[2]))
    return out


def _with_repeats(codes: np.ndarray, owner: np.ndarray, depth: int) -> np.ndarray:
    """Documents in which a stretch of ``depth`` words may occur twice (by a
    hash, so a document more at worst)."""
    n = len(codes) - depth + 1
    if n < 2:
        return np.empty(0, np.int64)
    h = owner[:n].astype(np.uint64)
    for k in range(depth):
        h = (h ^ codes[k:n + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    return np.unique(owner[order[1:][same]])


def _subtrees(sa, lcp, depth, periods):
    """(first, last) in ``sa`` of the subtrees of at least ``depth`` words that
    hold two positions as near as their deepest node allows."""
    deep = np.flatnonzero(lcp >= depth)
    if not len(deep):
        return
    cut = np.flatnonzero(np.diff(deep) > 1) + 1
    first, last = deep[np.append(0, cut)] - 1, deep[np.append(cut - 1, len(deep) - 1)] + 1
    deepest = np.maximum.reduceat(lcp[deep], np.append(0, cut))
    size = last - first
    tree = np.repeat(np.arange(len(first)), size)
    slot = np.arange(len(tree)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    at = sa[slot]
    at = at[np.lexsort((at, tree))]
    gap = np.append(np.diff(at), 1 << 60)
    gap[np.cumsum(size) - 1] = 1 << 60
    near = np.minimum.reduceat(gap, np.cumsum(size) - size)
    for k in np.flatnonzero(near <= deepest // (periods - 1)):
        yield int(first[k]), int(last[k])


def _collapse(words: list[bytes], runs) -> bytes:
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def repetitions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", periods: int = PERIODS, words: int = WORDS) -> DataFrame:
    """``doc_id, n_words, runs (array of start, length, period), collapsed`` (the
    words outside the repeats of any run, joined by a space) of every row."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in by_bytes(batches, 1, TOGETHER):
            texts = [(t or b"").split() for t in b.column(1).to_pylist()]  # bytes are split at just these blanks
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            numbers = defaultdict(count(1).__next__)
            codes = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
            runs = find_runs(codes, sizes, periods, words)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(sizes),
                pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], spans),
                pa.array([_collapse(t, r) for t, r in zip(texts, runs)], pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = d.mapInArrow(run, "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def looped(doc_id: Column, text: Column) -> Column:
    """The text, or for a tenth of the ids (by crc32) its words from a place on
    repeated with a period, both derived from the id."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def loop(ws):
        n = F.size(ws).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
        picked = F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int"))))
        return F.when(n > 0, F.array_join(picked, " ")).otherwise(text)

    return F.when(h % 10 == 0, let(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), loop)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of which are made periodic first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    r = repetitions(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")))
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    # runs come by start and period, so the first of equal exponents stays
    first = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)),
                        lambda best, x: F.when(better(x, best), x).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return r.withColumn("best", first).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))

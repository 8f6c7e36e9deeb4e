"""Operator 12: alignment of the tokens of two tokenizers by merge-path partitioning.

Both tokenizers cut the same bytes, so a text gives two rising lists of token
ends.  Merging them walks a path; the path is cut into pieces of equal length by
diagonals, and where a diagonal meets the path is found by binary search for all
diagonals at once.  A batch of texts is one merge problem, so many short texts
share a piece and a long one is cut into many.  Each piece is worked on alone: it
emits the overlaps of its tokens and the offsets at which both sides end.  A
group that runs over a cut, or a common end whose two tokens fall on both sides
of it, is stitched with one value from each neighbour.

A document's links become its distinct id pairs with their number, one row a
document is written, and the pairs are counted over the corpus with map-side
combining.  The counts come back by pair: those of the heaviest pairs, of which
there are at most ``HEAVY`` by counting, are broadcast, so that a document's
links are summed in the task that reads them; the others meet in a shuffle.

Defined results.  A text that is null or empty, or that one of the tokenizers
does not give back byte for byte (after the space put in front), has no tokens:
zeros, and the empty text of groups.  Strings of special tokens are plain text.
Repeated rows each count as a document.  A null id stays null.  Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, join_on_hot_key, materialise
from .tokens import _byte_letters, encoder, vocabulary_path

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Steps of the merge path in a piece.
STEPS = 1 << 16
#: Bytes of text aligned together (a longer text alone).
TOGETHER = 2 << 20
#: At most so many id pairs and their counts are broadcast.
HEAVY = 1 << 18


class Pair:
    """Both tokenizers: ids of texts and the bytes of each id."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        import sentencepiece

        a_path = a_path or vocabulary_path(BYTES)
        with open(a_path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        letters = _byte_letters()
        held = vocabulary["model"]["vocab"]
        self.a_bytes = [b""] * (max(held.values()) + 1)
        for piece, i in held.items():
            self.a_bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.a = encoder(a_path)
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path or vocabulary_path(PIECES))
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # an id of either side as text, followed by what stands between it and the next
        marks = [(self.a_bytes, (",", "|")), (self.b_bytes, (",", ";"))]
        self.words = [f"{i}{mark}" for table, both in marks for i in range(len(table)) for mark in both]

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none where a side does not give the text back."""
        none = np.empty(0, np.int64)
        a, b = [], []
        for text, ids in zip(texts, self.model.encode([t or "" for t in texts], num_threads=1)):
            x, y = none, none
            if text:
                whole = b" " + text.encode()
                if b"".join(map(self.b_bytes.__getitem__, ids)) == whole:
                    first = self.a(" " + text)
                    if b"".join(map(self.a_bytes.__getitem__, first.tolist())) == whole:
                        x, y = first.astype(np.int64), np.array(ids, np.int64)
            a.append(x)
            b.append(y)
        return a, b


@lru_cache(maxsize=2)
def pair_of(a_path: str | None = None, b_path: str | None = None) -> Pair:
    return Pair(a_path, b_path)


def diagonals(a: np.ndarray, b: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of the merge path of the rising lists a and b (a first where equal)
    every ``steps``: how many of a and of b lie before each, ends included."""
    d = np.append(np.arange(0, len(a) + len(b), steps), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        # a[mid] comes before the last of b taken: more of a belongs to this side
        more = (low < high) & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(d - mid - 1, 0, len(b) - 1)])
        low, high = np.where(more, mid + 1, low), np.where(more | (low >= high), high, mid)
    return low, d - low


def piece_overlaps(a: np.ndarray, b: np.ndarray, last_a: int, next_b: int):
    """One piece: of its ends a and b, for each a how many b end before it in the
    piece, for each b how many a do, and which a and b end together with one of
    the other side.  ``last_a`` is the last end of a before the piece, ``next_b``
    the first end of b after it; they stitch an equal pair that a cut parts."""
    before_a = np.searchsorted(b, a)
    before_b = np.searchsorted(a, b)
    both_a = np.append(b, next_b)[before_a] == a
    both_b = np.append(a, -1)[before_b] == b
    if len(b) and b[0] == last_a:
        both_b[0] = True
    return before_a, before_b, both_a, both_b


def overlaps(a: np.ndarray, b: np.ndarray, steps: int = STEPS):
    """For the token ends a and b of the same bytes: (tokens of a, tokens of b)
    of every overlap, and flags of the a and the b that end a group."""
    i, j = diagonals(a, b, steps)
    left, right, both_a, both_b = [], [], np.zeros(len(a), bool), np.zeros(len(b), bool)
    for k in range(len(i) - 1):
        (a0, a1), (b0, b1) = i[k:k + 2], j[k:k + 2]
        at_a, at_b, both_a[a0:a1], both_b[b0:b1] = piece_overlaps(
            a[a0:a1], b[b0:b1], a[a0 - 1] if a0 else -1, b[b1] if b1 < len(b) else -1)
        # an end that both sides share is one stretch of bytes: its overlap is that of a
        alone = np.flatnonzero(~both_b[b0:b1])
        left += [np.arange(a0, a1), a0 + at_b[alone]]
        right += [b0 + at_a, b0 + alone]
    return np.concatenate(left), np.concatenate(right), both_a, both_b


def align_batch(pair: Pair, texts: list[str | None], steps: int = STEPS):
    """Per text (n_a, n_b, n_groups, n_links), its groups as text, and the
    distinct links of all texts as (text number, a, b, number of links)."""
    a_ids, b_ids = pair.encode(texts)
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
    zero = np.zeros(len(texts), np.int64)
    if not n_a.sum():
        return n_a, n_b, zero, zero, [""] * len(texts), zero[:0], zero[:0], zero[:0], zero[:0]
    a, b = np.concatenate(a_ids), np.concatenate(b_ids)
    # both sides of a text have the same bytes, so running sums keep texts apart
    left, right, both_a, both_b = overlaps(np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b]), steps)
    of = np.repeat(np.arange(len(texts)), n_a)
    n_groups = np.bincount(of[both_a], minlength=len(texts))
    n_links = np.bincount(of[left], minlength=len(texts))
    # place of each token when groups are written one after the other, a before b
    end_a, end_b = np.flatnonzero(both_a) + 1, np.flatnonzero(both_b) + 1
    group_a, group_b = np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b
    word = np.empty(len(a) + len(b), np.int64)
    word[np.arange(len(a)) + np.append(0, end_b)[group_a]] = 2 * a + both_a
    word[np.arange(len(b)) + end_a[group_b]] = 2 * (len(pair.a_bytes) + b) + both_b
    stop = np.cumsum(n_a + n_b)
    groups = ["".join(map(pair.words.__getitem__, word[e - n:e].tolist()))[:-1] for e, n in zip(stop.tolist(), (n_a + n_b).tolist())]
    wide = int(len(pair.b_bytes)).bit_length()
    high = wide + int(len(pair.a_bytes)).bit_length()
    key, times = np.unique((of[left] << high) | (a[left] << wide) | b[right], return_counts=True)
    return n_a, n_b, n_groups, n_links, groups, key >> high, (key >> wide) & ((1 << (high - wide)) - 1), key & ((1 << wide) - 1), times


_LINKS = "array<struct<a:int,b:int,n:int>>"


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None,
          b_path: str | None = None, steps: int = STEPS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups`` (ids as
    ``a1,a2|b1;a3|b2,b3``) and ``links`` (distinct id pairs and how many links
    each has) of every row."""
    def run(batches):
        pair = pair_of(a_path, b_path)
        for b in by_bytes(batches, 1, TOGETHER):
            texts = b.column(1).to_pylist()
            n_a, n_b, n_groups, n_links, groups, doc, x, y, times = align_batch(pair, texts, steps)
            ends = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            links = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in (x, y, times)], names=["a", "b", "n"])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c) for c in (n_a, n_b, n_groups, n_links)], pa.array(groups, pa.string()),
                 pa.ListArray.from_arrays(pa.array(ends), links)],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, f"doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links {_LINKS}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair`` (a, b), ``docs`` (documents that hold it linked) and ``best``
    (no pair of its a has more) of every id pair of the corpus."""
    links = aligned.select(F.inline("links"))
    counts = links.groupBy(_pair().alias("pair")).agg(F.count(F.lit(1)).alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.withColumn("best", F.col("docs") == most)


def _pair():
    return F.shiftleft(F.col("a").cast("bigint"), 32) + F.col("b")


def score(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``row, n_best, count_sum`` of the rows of ``aligned`` (with a unique
    column ``row``) that have links.  Both tables should be materialised."""
    links = aligned.select("row", F.inline("links")).select("row", _pair().alias("pair"), "n")
    total = counts.agg(F.sum("docs")).first()[0] or 0
    joined = join_on_hot_key(links, counts, "pair", "docs", total, HEAVY)
    return joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("bigint").alias("n_best"),
                                     F.sum(F.col("n") * F.col("docs")).cast("bigint").alias("count_sum"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: tokens, groups and links of both tokenizers, and how common
    the links are in the corpus."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    t = materialise(align(docs).withColumn("groups_sha256", digest).drop("groups")
                    .withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialise(pair_counts(t), "pair-counts")
    none = F.lit(0).cast("bigint")
    out = t.drop("links").join(score(t, counts), "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
                      F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")

"""Operator 9: token counts that follow edits.

Each document keeps a segment tree: its pre-tokens in leaves of ``LEAF``, each
with its characters and tokens, below them the sums of subtrees, as arrays in
heap order (children of node i at 2 i and 2 i + 1, the root at 1).  The trees
are a table of small integers, a few hundredths of the text.  A batch of edits
finds the touched leaves by descending on characters, takes ``CONTEXT``
characters around (no pre-token depends on more beyond its end), splits the
edited region anew until a boundary meets an old leaf boundary again, encodes
those pre-tokens only, and adds the differences along the paths to the root.
Tokens never cross pre-tokens, so the sums are exact.

Edits (doc_id, start, end, replacement) hold code point positions of the text
before the batch.  With a column row_key (as :func:`redactions` makes it) an edit
is for the rows of that id and text alone, without it for all rows of the id.

Defined results.  A null text is empty.  Positions are clipped to the text; an
edit with end before start, or that overlaps one that starts before it (ties:
the one that ends first, then the smaller replacement), is skipped and counted.
A null position, id or key skips the edit, a null replacement deletes.  Repeated
rows get the same edits each.  A document without edits keeps its counts.
Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batches, materialise, row_key
from .tokens import encoder

LEAF = 32
CONTEXT = 4
#: A leaf that grows to this many pre-tokens has its document's tree made anew.
CROWDED = 8 * LEAF
#: Token counts of pre-tokens that a worker remembers.
REMEMBER = 300_000
_PII = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"\+?\d[\d ()-]{7,}\d")


class PreTokens:
    """Splits texts into pre-tokens and knows their token counts."""

    def __init__(self, vocabulary: str | None = None):
        import public_tokenizers
        import regex

        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.encode = encoder(vocabulary)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            n = len(self.encode(piece))
            if len(piece) <= 64:
                self.known[piece] = n
        return n

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)


@lru_cache(maxsize=2)
def pre_tokens(vocabulary: str | None = None) -> PreTokens:
    return PreTokens(vocabulary)


class Tree:
    """Sums of characters, tokens and pre-tokens over a fixed number of leaves."""

    def __init__(self, sums: np.ndarray):
        self.sums = sums  # (2 * leaves, 3); leaves is a power of two

    @classmethod
    def of_leaves(cls, leaves: np.ndarray) -> "Tree":
        size = 1 << max(0, int(len(leaves) - 1).bit_length())
        sums = np.zeros((2 * size, 3), np.int64)
        sums[size:size + len(leaves)] = leaves
        while size > 1:
            sums[size // 2:size] = sums[size:2 * size].reshape(-1, 2, 3).sum(axis=1)
            size //= 2
        return cls(sums)

    @classmethod
    def of_text(cls, text: str, pre: PreTokens) -> "Tree":
        pieces = pre.split(text)
        if not pieces:
            return cls.of_leaves(np.zeros((1, 3), np.int64))
        n = len(pieces)
        cols = np.empty((n, 3), np.int64)
        cols[:, 0] = np.fromiter(map(len, pieces), np.int64, n)
        cols[:, 1] = np.fromiter(map(pre.count, pieces), np.int64, n)
        cols[:, 2] = 1
        return cls.of_leaves(np.add.reduceat(cols, np.arange(0, n, LEAF), axis=0))

    @property
    def leaves(self) -> int:
        return len(self.sums) // 2

    def find(self, at: int) -> tuple[int, int]:
        """(leaf that holds character ``at``, its first character)."""
        node, before = 1, 0
        while node < self.leaves:
            node *= 2
            left = int(self.sums[node, 0])
            if at - before >= left and self.sums[node + 1, 0] > 0:
                before += left
                node += 1
        return node - self.leaves, before

    def put(self, leaf: int, values) -> None:
        """Set a leaf and add the difference up to the root."""
        node = leaf + self.leaves
        change = np.asarray(values, np.int64) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


def clean_edits(edits, n: int) -> tuple[list[tuple[int, int, str]], int]:
    """Edits in order without overlaps, clipped to n characters; number skipped."""
    good, skipped, reached = [], 0, 0
    whole = [(max(0, min(s, n)), max(0, min(e, n)), r or "") for s, e, r in edits if s is not None and e is not None]
    skipped += len(edits) - len(whole)
    for s, e, r in sorted(whole):
        if e < s or s < reached:
            skipped += 1
            continue
        good.append((s, e, r))
        reached = e
    return good, skipped


def apply_edits(text: str, tree: Tree, edits: list[tuple[int, int, str]], pre: PreTokens) -> tuple[str, Tree, int]:
    """(new text, tree, characters encoded again).  ``edits`` as by :func:`clean_edits`."""
    parts, at = [], 0
    for s, e, r in edits:
        parts += [text[at:s], r]
        at = e
    new = "".join([*parts, text[at:]])
    if not edits:
        return new, tree, 0
    old = Tree(tree.sums.copy())  # boundaries of the text before the batch
    encoded, shift, k = 0, 0, 0
    while k < len(edits):
        first, begin = old.find(max(0, edits[k][0] - CONTEXT))
        last, last_begin = old.find(min(len(text), edits[k][1] + CONTEXT))
        end = last_begin + int(old.sums[old.leaves + last, 0])
        pos, pieces, moved = begin + shift, [], shift  # moved: new minus old position behind the region's edits
        while True:
            while k < len(edits) and edits[k][0] <= end + CONTEXT:  # edits that reach into the region
                s, e, r = edits[k]
                moved += len(r) - (e - s)
                far, far_begin = old.find(min(len(text), e + CONTEXT))
                if far > last:
                    last, end = far, far_begin + int(old.sums[old.leaves + far, 0])
                k += 1
            m = None
            for m in pre.pattern.finditer(new, pos):
                if m.start() >= end + moved:
                    break
                pieces.append(m[0])
                pos = m.end()
                if pos >= end + moved:
                    break
            if pos == end + moved or last + 1 >= old.leaves or end >= len(text):
                break
            last += 1  # a pre-token runs over the boundary: take one leaf more
            end += int(old.sums[old.leaves + last, 0])
        slots = last - first + 1
        cut = [len(pieces) * i // slots for i in range(slots + 1)]
        for i in range(slots):
            part = pieces[cut[i]:cut[i + 1]]
            tree.put(first + i, (sum(map(len, part)), sum(map(pre.count, part)), len(part)))
        encoded += sum(map(len, pieces))
        shift = moved
    if tree.sums[tree.leaves:, 2].max() > CROWDED:
        return new, Tree.of_text(new, pre), len(new)
    return new, tree, encoded


_TREE = "chars array<int>, tokens array<int>, pieces array<int>"


def build_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, row_key`` and the three heap arrays of every row."""
    def run(batches):
        pre = pre_tokens(vocabulary)
        for b in as_batches()(batches):
            trees = [Tree.of_text(t or "", pre).sums.astype(np.int32) for t in b.column(2).to_pylist()]
            ends = np.cumsum([0, *map(len, trees)]).astype(np.int32)
            flat = np.concatenate(trees) if trees else np.zeros((0, 3), np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(flat[:, c]))) for c in range(3)]],
                names=["doc_id", "row_key", "chars", "tokens", "pieces"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, f"doc_id bigint, row_key string, {_TREE}")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))


def recount(docs: DataFrame, trees: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``docs``: counts before and after its edits, the edits
    applied and skipped, the characters encoded again, and the tree after.
    Texts of documents without edits are not read."""
    key = "row_key" if "row_key" in edits.columns else "doc_id"
    per_doc = (edits.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__id"))
               .agg(F.collect_list(F.struct("start", "end", "replacement")).alias("edits")))
    same = trees.groupBy("row_key").agg(*[F.first(c).alias(c) for c in ("chars", "tokens", "pieces")])
    kept = trees.join(per_doc.select("__id"), F.col(key) == F.col("__id"), "left_anti")
    none = F.lit(0).cast("bigint")
    root = lambda c: F.col(c)[1].cast("bigint")
    unchanged = kept.select("doc_id", root("tokens").alias("n_tokens_before"), root("tokens").alias("n_tokens"), root("chars").alias("n_chars"),
                            none.alias("n_edits"), none.alias("n_skipped"), none.alias("n_chars_encoded"), "chars", "tokens", "pieces")
    touched = (_keyed(docs, id_col, text_col).join(per_doc, F.col(key) == F.col("__id")).join(same, "row_key")
               .select("doc_id", "text", "edits", "chars", "tokens", "pieces"))

    names = unchanged.columns

    def run(batches):
        pre = pre_tokens(vocabulary)
        for b in as_batches(64)(batches):
            out = []
            for r in b.to_pylist():
                text, tree = r["text"] or "", Tree(np.array([r["chars"], r["tokens"], r["pieces"]], np.int64).T.copy())
                before = int(tree.sums[1, 1])
                good, skipped = clean_edits([(e["start"], e["end"], e["replacement"]) for e in r["edits"]], len(text))
                _, tree, encoded = apply_edits(text, tree, good, pre)
                s = tree.sums.astype(np.int32)
                out.append((r["doc_id"], before, int(s[1, 1]), int(s[1, 0]), len(good), skipped, encoded, *(s[:, c].tolist() for c in range(3))))
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return unchanged.unionByName(touched.mapInArrow(
        run, f"doc_id bigint, n_tokens_before bigint, n_tokens bigint, n_chars bigint, n_edits bigint, n_skipped bigint, n_chars_encoded bigint, {_TREE}"))


def redactions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edits that put a mark in place of mail addresses and of telephone and
    other long numbers: ``doc_id, row_key, start, end, replacement``."""
    import re

    find = re.compile("|".join(f"({p})" for p in _PII))

    def run(batches):
        for b in as_batches()(batches):
            rows = [(i, k, m.start(), m.end(), "<mail>" if m.lastindex == 1 else "<number>")
                    for i, k, t in zip(*(c.to_pylist() for c in b.columns)) for m in find.finditer(t or "")]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()))],
                                             names=["doc_id", "row_key", "start", "end", "replacement"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, row_key string, start int, end int, replacement string")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, before and after the redaction of personal data."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = materialise(build_trees(docs), "token-trees")
    edits = materialise(redactions(docs).dropDuplicates(), "redactions")
    out = recount(docs, trees, edits)
    return out.select("doc_id", "n_tokens_before", "n_tokens", "n_chars", "n_edits", "n_skipped", "n_chars_encoded",
                      (F.size("chars") / 2).cast("int").alias("n_leaves"))

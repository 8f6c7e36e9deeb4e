"""Operator 2: near-duplicates by SimHash, found with BK-trees.

Fingerprints are reduced to their distinct values, which are dealt to shards:
two 64-bit values that differ in at most ``radius`` bits agree in one of
``radius + 1`` blocks, so every value goes to one shard per block and no link
is lost.  A shard larger than ``max_shard`` is dealt again by blocks of its
remaining bits (the same argument), until it fits one task.  Each shard's tree
travels to the task that searches it through the shuffle: sending trees of the
whole corpus through the driver, as a literal broadcast would, grows with the
data and is ruled out.  In a task, a forest of BK-trees (children keyed by
integer Hamming distance to the parent) is built level by level, and a search
follows only edges whose distance lies within ``radius`` of the query's.  Links
of a shard are folded to a spanning star before they leave the task, so a
group of m near copies emits m - 1 edges and not m^2 pairs.

Defined results.  Null and empty texts have fingerprint zero and are linked
like any other.  Repeated rows have one fingerprint and so one component.  A
component whose ids are all null has a null ``component_id``.  Empty tables
give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batches, join_on_hot_key, keep_rows, materialise, row_key
from .components import connected_components

BITS = 64
SHINGLE = 3
RADIUS = 2
#: Most distinct fingerprints that one BK-tree holds.
MAX_SHARD = 4096
#: Nodes of the trees that are searched together, queries at a time, and visits
#: at a time.
FOREST_NODES, QUERY_BLOCK, FRONTIER = 1 << 14, 1 << 11, 1 << 15
HASH_SEED = 42


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of one whole text, unsigned."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    h = np.fromiter((xxh64_intdigest(s, HASH_SEED) for s in shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = h[i:i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id, row_key, fp`` of every row; ``fp`` is the signed 64-bit value."""
    def run(batches):
        for b in as_batches()(batches):
            fps = np.array([fingerprint(t, size) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())],
                                             names=["doc_id", "row_key", "fp"])

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                    row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id bigint, row_key string, fp bigint")


# ---------------------------------------------------------------- BK-trees

def build_forest(values: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees of ``values`` (uint64, distinct within a tree; ``tree`` numbers
    them from 0).  Returns (root node of each tree, child[node, distance] or -1).
    The first unplaced value of a slot becomes its node; the rest go below it."""
    n = len(values)
    child = np.full((n, BITS + 1), -1, np.int32)
    order = np.argsort(tree, kind="stable")
    first = np.r_[True, tree[order][1:] != tree[order][:-1]] if n else np.zeros(0, bool)
    roots = order[first].astype(np.int32)
    rest = order[~first]
    parent = roots[tree[rest]]
    while len(rest):
        d = np.bitwise_count(values[rest] ^ values[parent]).astype(np.int64)
        slot = parent.astype(np.int64) * (BITS + 1) + d
        by = np.argsort(slot, kind="stable")
        rest, slot = rest[by], slot[by]
        lead = np.r_[True, slot[1:] != slot[:-1]]
        child.ravel()[slot[lead]] = rest[lead]
        parent = child.ravel()[slot][~lead]
        rest = rest[~lead]
    return roots, child


def search_forest(values: np.ndarray, child: np.ndarray, query: np.ndarray, node: np.ndarray, radius: int):
    """Yields (query, node) links: ``query`` indexes values, ``node`` is where
    its search starts.  Only edges within ``radius`` of the distance are
    followed, at most FRONTIER visits at a time (deepest first), so dense
    shards need no more memory than others."""
    span = np.arange(-radius, radius + 1)
    todo = [(query.astype(np.int32), node.astype(np.int32))]
    while todo:
        query, node = todo.pop()
        if len(query) > FRONTIER:
            todo.append((query[FRONTIER:], node[FRONTIER:]))
            query, node = query[:FRONTIER], node[:FRONTIER]
        d = np.bitwise_count(values[query] ^ values[node]).astype(np.int32)
        near = d <= radius
        yield query[near], node[near]
        edge = d[:, None] + span
        nxt = np.where((edge >= 0) & (edge <= BITS), child[node[:, None], np.clip(edge, 0, BITS)], -1)
        go = nxt >= 0
        if go.any():
            todo.append((np.repeat(query, go.sum(axis=1)), nxt[go]))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the classes of a and b; label[i] is the smallest index of i's class."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def shard_links(shards: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, representative) of the classes inside each shard."""
    values = np.concatenate(shards)
    tree = np.repeat(np.arange(len(shards)), [len(s) for s in shards])
    roots, child = build_forest(values, tree)
    label = np.arange(len(values))
    for i in range(0, len(values), QUERY_BLOCK):
        q = np.arange(i, min(i + QUERY_BLOCK, len(values)))
        for a, b in search_forest(values, child, q, roots[tree[q]], radius):
            label = _merge(label, a, b)
    member = np.flatnonzero(label != np.arange(len(values)))
    return values[member], values[label[member]]


# ---------------------------------------------------------------- shards

def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    cut = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[cut[i]:cut[i + 1]] for i in range(parts)]


def _signed(bits: list[int]) -> int:
    v = sum(1 << b for b in bits)
    return v - (1 << BITS) if v >= 1 << (BITS - 1) else v


def shards(values: DataFrame, radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """``shard, fps``: the shards of two values or more.  ``values`` has
    the distinct fingerprints in ``fp``."""
    level = {0: (_blocks(list(range(BITS)), radius + 1))}
    pending, out = values.select("fp", F.lit(0).alias("tag")), None
    fixed: dict[int, list[int]] = {0: []}
    while True:
        nxt: dict[int, list[int]] = {}
        deal = None
        for tag, blocks in level.items():
            rows = []
            for i, block in enumerate(blocks):
                t = tag * (radius + 1) + i + 1
                nxt[t] = fixed[tag] + block
                rows.append(F.struct(F.lit(t).alias("tag"), F.col("fp").bitwiseAND(F.lit(_signed(nxt[t]))).alias("mask_key")))
            deal = F.when(F.col("tag") == tag, F.array(*rows)) if deal is None else deal.when(F.col("tag") == tag, F.array(*rows))
        dealt = materialise(pending.select("fp", F.explode(deal).alias("shard")), "shard-rows")
        sizes = materialise(dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shard-sizes")
        # a shard whose free bits allow no more than max_shard values always fits
        small = [t for t, bits in nxt.items() if 1 << (BITS - len(bits)) <= max_shard]
        fits = (F.col("n") <= max_shard) | F.col("shard.tag").isin(small)
        part = (dealt.join(sizes.filter(fits).select("shard"), "shard")
                     .groupBy("shard").agg(F.collect_list("fp").alias("fps")))
        out = part if out is None else out.unionByName(part)
        large = sizes.filter(~fits)
        if large.isEmpty():
            return out
        pending = join_on_hot_key(dealt, large, "shard", "n", dealt.count()).select("fp", F.col("shard.tag").alias("tag"))
        # the block paths that still have large shards, a few hundred at most
        tags = {r[0] for r in large.select("shard.tag").distinct().collect()}
        fixed = {t: bits for t, bits in nxt.items() if t in tags}
        level = {t: _blocks([b for b in range(BITS) if b not in bits], radius + 1) for t, bits in fixed.items()}


def link_fingerprints(values: DataFrame, radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints whose connected components
    are those of all links within ``radius``."""
    def run(batches):
        hold, n = [], 0

        def flush():
            a, b = shard_links(hold, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            for fps in batch.column(0):
                hold.append(fps.values.to_numpy(zero_copy_only=False).view(np.uint64))
                n += len(hold[-1])
                if n >= FOREST_NODES:
                    yield flush()
                    hold, n = [], 0
        if hold:
            yield flush()

    return shards(values, radius, max_shard).select("fps").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                    radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, row_key, fp, root, component_id``;
    ``root`` is the smallest fingerprint of the component."""
    fps = materialise(fingerprints(docs, id_col, text_col, size), "fingerprints")
    total = fps.count()
    values = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("min_id"), F.count(F.lit(1)).alias("n")), "fp-values")
    links = materialise(link_fingerprints(values, radius, max_shard), "fp-links")
    roots = connected_components(links)
    classed = materialise(values.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                          .select("fp", "min_id", "n", F.coalesce("root", "fp").alias("root")), "fp-classes")
    ids = materialise(classed.groupBy("root").agg(F.min("min_id").alias("component_id"),
                                                  F.count(F.lit(1)).alias("members")), "fp-components")
    by_value = materialise(join_on_hot_key(classed, ids, "root", "members", total), "fp-ids")
    return join_on_hot_key(fps, by_value.select("fp", "n", "root", "component_id"), "fp", "n", total).drop("n")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with fingerprint and component."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document with the smallest id of each component."""
    found = materialise(near_duplicates(docs), "near-duplicates")
    kept = found.groupBy("root").agg(
        F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("row_key"))).alias("row_key"))
    return keep_rows(docs, kept.select("row_key"))

"""Frame-feature pooling (FEA-01 .. FEA-06) and masked means (SEQ-08).

Frames are rows ``(sample_id, t, feat array<float>)``, and vectors stay vectors:
a task sums the frames of an Arrow batch as matrices and keeps one partial result
a sample (counts, means and squared deviations by dimension), which are merged
once, after a shuffle of partial results only.  Quantiles need the values of a
dimension together: the frames of a clip (``CLIP`` at most) are dealt to one
task, which takes the ranked values of all dimensions at once; longer samples go
by the exact selection of :mod:`.selection`, in which no sample has a task to
itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import kth_smallest

# FIXED VALUES: part order of pose features and the normalisation floor.
POSE_PARTS = ["pose", "face", "left_hand", "right_hand"]
NORM_FLOOR = 1e-6

#: Frames of a sample that one task may hold.
CLIP = 1024
#: Numbers of partial results that a task keeps before it hands them on.
HELD = 1 << 22


# ---- partial sums over matrices

def _matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A list column as a matrix of doubles, with flags of the cells that the
    lists have (null lists have none) and of those that are not null."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    have = np.arange(sizes.max(initial=0)) < sizes[:, None]
    values, there = np.zeros(have.shape), np.zeros(have.shape, bool)
    values[have] = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    there[have] = flat.is_valid().to_numpy(zero_copy_only=False)
    return values, have, there


def _samples(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, list, pa.RecordBatch]]:
    """Slices of a batch of (sample, list, ..) of a bounded number of cells, each
    sorted by sample, with the samples in it, where each begins, and its longest list."""
    lists = batch.column(1)
    cells = np.asarray(lists.value_lengths().fill_null(0))
    step = max(1, HELD // max(1, int(cells.max(initial=1))))
    for first in range(0, batch.num_rows, step):
        part = batch.slice(first, step)
        code = part.column(0).dictionary_encode(null_encoding="encode")
        of = code.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.diff(of[order], prepend=-1))
        names = code.dictionary.to_pylist()
        widths = np.maximum.reduceat(cells[first:first + step][order], starts).tolist()
        yield [names[i] for i in of[order][starts]], starts, widths, part.take(pa.array(order))


def _moments(part: pa.RecordBatch, starts: np.ndarray) -> list[np.ndarray]:
    """Per sample and dimension: frames, values, their mean and the sum of their
    squared deviations."""
    x, have, there = _matrix(part.column(1))
    add = partial(np.add.reduceat, indices=starts, axis=0)
    n = add(there.astype(float))
    mean = add(x) / np.maximum(n, 1)
    off = np.where(there, x - np.repeat(mean, np.diff(starts, append=len(x)), axis=0), 0.0)
    return [add(have.astype(float)), n, mean, add(off * off)]


def _merge_moments(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The moments of both parts together."""
    n = a[1] + b[1]
    part, d = b[1] / np.maximum(n, 1), b[2] - a[2]
    return [a[0] + b[0], n, a[2] + d * part, a[3] + b[3] + d * d * a[1] * part]


def _weighted(part: pa.RecordBatch, starts: np.ndarray) -> list[np.ndarray]:
    """Per sample and dimension: sum of value x weight, and of weights; the
    weight is the third column."""
    x, have, _ = _matrix(part.column(1))
    w = part.column(2).fill_null(0.0).to_numpy(zero_copy_only=False)[:, None]
    return [np.add.reduceat(x * w, starts, axis=0), np.add.reduceat(have * w, starts, axis=0)]


def _plus(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b)]


def _wider(a: list[np.ndarray], width: int) -> list[np.ndarray]:
    return [np.pad(x, (0, width - len(x))) for x in a]


def reduce_vectors(rows: DataFrame, first: Callable, merge: Callable, parts: int) -> DataFrame:
    """``sample_id`` and ``parts`` arrays ``v0, v1, ..`` of doubles: ``rows``
    (sample, list, ..) summed batch by batch with ``first`` (per sample of a
    batch, one row of each of ``parts`` matrices) and put together with ``merge``.
    A shorter list counts as zeros where another of its sample is longer."""
    kind = rows.schema[0].dataType.simpleString()
    out = f"sample_id {kind}, " + ", ".join(f"v{i} array<double>" for i in range(parts))

    def both(a, b):
        width = max(len(a[0]), len(b[0]))
        return merge(*(s if len(s[0]) == width else _wider(s, width) for s in (a, b)))

    def batch_of(held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        lists = [pa.array([s[i] for _, s in held], pa.list_(pa.float64())) for i in range(parts)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], kind), *lists], names=["sample_id", *[f"v{i}" for i in range(parts)]])

    def sums(batches):
        held, cells, kind = {}, 0, None
        for b in batches:
            kind = b.schema.field(0).type
            for names, starts, widths, part in _samples(b):
                for k, width, *values in zip(names, widths, *first(part, starts)):
                    values = [v[:width] for v in values]
                    if k in held:
                        held[k] = both(held[k], values)
                    else:
                        held[k] = values
                        cells += parts * len(values[0])
                if cells > HELD:
                    yield batch_of(list(held.items()), kind)
                    held, cells = {}, 0
        if held:
            yield batch_of(list(held.items()), kind)

    def whole(batches):  # sorted by sample: one is held at a time
        now, kind = None, None
        for b in batches:
            kind = b.schema.field(0).type
            names = b.column(0).to_pylist()
            for i, k in enumerate(names):
                s = [np.asarray(b.column(j + 1)[i].values) for j in range(parts)]
                if now is not None and now[0] == k:
                    now = (k, both(now[1], s))
                else:
                    if now is not None:
                        yield batch_of([now], kind)
                    now = (k, s)
        if now is not None:
            yield batch_of([now], kind)

    partial_sums = rows.mapInArrow(sums, out)
    return partial_sums.repartition("sample_id").sortWithinPartitions("sample_id").mapInArrow(whole, out)


def _ranked(batches, ranks, kind):
    """Frames of whole samples, sorted by sample -> (sample, T, mean, std, value of
    each of ``ranks``)."""
    def row(values, there):
        return pa.ListArray.from_arrays([0, len(values)], pa.array(values, mask=~there))

    def one(name, lists):
        x, have, there = _matrix(pa.concat_arrays(lists))
        n, t = there.sum(axis=0), have.sum(axis=0)
        mean = x.sum(axis=0) / np.maximum(n, 1)
        std = np.sqrt(np.square(np.where(there, x - mean, 0.0)).sum(axis=0) / np.maximum(n, 1))
        x[~there] = np.nan  # nulls come after all values
        x.sort(axis=0)
        at = [np.maximum(1, np.floor(q * t)).astype(int) - 1 for q in ranks]
        picks = [row(x[np.minimum(k, len(x) - 1), np.arange(x.shape[1])], k < n) for k in at]
        return pa.RecordBatch.from_arrays([pa.array([name], kind[0]), pa.array([int(t[0])]), row(mean, n > 0), row(std, n > 0), *picks],
                                          names=["sample_id", "n_frames", "mean", "std", *[f"q{i}" for i in range(len(ranks))]])

    now, lists = None, []
    for b in batches:
        kind[0] = b.schema.field(0).type
        for names, starts, _, part in _samples(b):
            for k, first, last in zip(names, starts, [*starts[1:], part.num_rows]):
                if lists and k != now:
                    yield one(now, lists)
                    lists = []
                now = k
                lists.append(part.column(1).slice(first, last - first))
    if lists:
        yield one(now, lists)


def pool(frames: DataFrame, mode: str = "meanstd", feat: str = "feat", clip: int = CLIP) -> DataFrame:
    """FEA-03: temporal pooling per sample -> (sample_id, n_frames, pooled).

    none (valid only for T == 1), mean, meanstd (population std),
    meanstdp25p75 where a quantile is the k-th smallest value,
    k = max(1, int(q * T)).  Invalid samples get a null vector.  A frame without
    values does not count, nor does a sample of only such frames."""
    if mode not in ("none", "mean", "meanstd", "meanstdp25p75"):
        raise ValueError(f"unknown pooling mode {mode}")
    x = frames.select("sample_id", feat).filter(F.size(feat) > 0)
    if mode == "meanstdp25p75":
        return _pool_quantiles(x, feat, clip)
    s = reduce_vectors(x, _moments, _merge_moments, 4)
    there = lambda c: F.zip_with(c, "v1", lambda v, n: F.when(n > 0, v))
    mean, std = there("v2"), F.zip_with("v3", "v1", lambda m, n: F.when(n > 0, F.sqrt(m / n)))
    n = F.get("v0", F.lit(0)).cast("bigint")
    pooled = F.concat(mean, std) if mode == "meanstd" else mean
    return s.select("sample_id", n.alias("n_frames"), F.when(F.lit(mode != "none") | (n == 1), pooled).alias("pooled"))


def _pool_quantiles(x: DataFrame, feat: str, clip: int) -> DataFrame:
    sizes = x.groupBy("sample_id").agg(F.count(F.lit(1)).alias("T"))
    pooled = F.concat("mean", "std", "q0", "q1")
    kind = x.schema["sample_id"].dataType.simpleString()
    out = f"sample_id {kind}, n_frames bigint, mean array<double>, std array<double>, q0 array<double>, q1 array<double>"
    long = sizes.filter(F.col("T") > clip).select(F.col("sample_id").alias("_s"))
    any_long = long.limit(1).count() > 0
    short = x.join(long, F.col("sample_id").eqNullSafe(F.col("_s")), "left_anti") if any_long else x
    dealt = short.repartition("sample_id").sortWithinPartitions("sample_id")
    done = dealt.mapInArrow(lambda b: _ranked(b, (0.25, 0.75), [None]), out).select("sample_id", "n_frames", pooled.alias("pooled"))
    if not any_long:
        return done
    rest = x.join(long, F.col("sample_id").eqNullSafe(F.col("_s")), "left_semi")
    dims = rest.select("sample_id", F.posexplode(feat).alias("d", "v"))
    k = lambda q: F.greatest(F.lit(1), F.floor(q * F.col("n")).cast("bigint")) + F.col("n") - F.col("_there")
    picked = kth_smallest(dims, ["sample_id", "d"], "v", {"q0": k(0.25), "q1": k(0.75)})
    lists = F.array_sort(F.collect_list(F.struct("d", "q0", "q1")))
    picked = picked.groupBy(F.col("sample_id").alias("_s")).agg(lists.alias("a"))
    picked = picked.select("_s", F.concat(F.transform("a", lambda r: r["q0"].cast("double")), F.transform("a", lambda r: r["q1"].cast("double"))).alias("_q"))
    both = pool(rest.select("sample_id", feat), "meanstd", feat).join(picked, F.col("sample_id").eqNullSafe(F.col("_s")))
    return done.unionByName(both.select("sample_id", "n_frames", F.concat("pooled", "_q").alias("pooled")))


def normalise(v, norm: str | None) -> Column:
    """FEA-04: l2 (norm floored at 1e-6) or zscore (population std floored
    at 1e-6) over the vector; None/'none' leaves it as is."""
    v = F.col(v) if isinstance(v, str) else v
    if norm in (None, "none"):
        return v
    vd = F.transform(v, lambda x: x.cast("double"))
    n = F.size(vd)
    if norm == "l2":
        nrm = F.sqrt(F.aggregate(vd, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(vd, lambda x: x / F.greatest(nrm, F.lit(NORM_FLOOR)))
    if norm == "zscore":
        mean = F.aggregate(vd, F.lit(0.0), lambda a, x: a + x) / n
        var = F.aggregate(vd, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
        sd = F.greatest(F.sqrt(var), F.lit(NORM_FLOOR))
        return F.transform(vd, lambda x: (x - mean) / sd)
    raise ValueError(norm)


def fit_width(v, width: int) -> Column:
    """FEA-05: cut to ``width`` or right-fill with zeros; null -> zeros."""
    v = F.col(v) if isinstance(v, str) else v
    vd = F.transform(v, lambda x: x.cast("double"))
    zeros = F.array_repeat(F.lit(0.0), width)
    return F.when(v.isNull(), zeros).when(F.size(v) >= width, F.slice(vd, 1, width)) \
            .otherwise(F.concat(vd, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(v))))


def pose_frames(parts: DataFrame, use_conf: bool = True) -> DataFrame:
    """FEA-01: per sample, frame-wise concat of the valid pose parts.

    ``parts`` rows: (sample_id, part, kp array<array<array<float>>>) shaped
    [T, K, C].  A part is skipped when missing, empty (T = 0) or when some
    keypoint's last axis is not 2 or 3; ``use_conf=False`` keeps the first
    two values.  Valid parts are concatenated per frame in the fixed order;
    no valid part or unequal frame counts make the sample invalid (it keeps its
    row).  Output (sample_id, valid, n_frames, frames array<array<float>>).
    """
    order = F.array_position(F.array(*[F.lit(p) for p in POSE_PARTS]), F.col("part"))
    kp = F.col("kp")
    good_c = F.forall(kp, lambda fr: F.forall(fr, lambda k: F.size(k).isin(2, 3)))
    ok = order.isNotNull() & (order > 0) & kp.isNotNull() & (F.size(kp) > 0) & good_c
    if not use_conf:
        kp = F.transform(kp, lambda fr: F.transform(fr, lambda k: F.slice(k, 1, 2)))
    flat = F.transform(kp, lambda fr: F.flatten(fr))
    # a sample without any valid part still has its row: collect_list skips nulls
    p = parts.select("sample_id", F.when(ok, F.struct(order.alias("o"), flat.alias("fr"))).alias("part"))
    g = p.groupBy("sample_id").agg(F.array_sort(F.collect_list("part")).alias("_p"))
    sizes = F.transform("_p", lambda x: F.size(x["fr"]))
    T = F.array_min(sizes)
    valid = (F.size("_p") > 0) & (T == F.array_max(sizes))
    frames = F.transform(F.sequence(F.lit(0), T - 1),
                         lambda t: F.flatten(F.transform("_p", lambda x: F.element_at(x["fr"], t + 1))))
    return g.select("sample_id", F.coalesce(valid, F.lit(False)).alias("valid"), F.coalesce(T, F.lit(0)).alias("n_frames"),
                    F.when(valid, frames).alias("frames"))


def audio_frames(df: DataFrame, vec: str | None = "vec", mat: str | None = "mat") -> DataFrame:
    """FEA-02: normalise audio features to [T, D]: a [D] vector becomes one
    frame; an empty input is invalid.  Output adds (valid, frames)."""
    one = F.when(F.col(vec).isNotNull() & (F.size(vec) > 0), F.array(F.col(vec)))
    frames = F.coalesce(F.when(F.col(mat).isNotNull() & (F.size(mat) > 0)
                               & F.forall(mat, lambda r: F.size(r) > 0), F.col(mat)), one)
    return df.withColumn("frames", frames).withColumn("valid", F.col("frames").isNotNull())


def frames_to_rows(df: DataFrame, frames: str = "frames") -> DataFrame:
    """Array-of-frames form -> (sample_id, t, feat) rows for :func:`pool`."""
    return df.select("sample_id", F.posexplode(frames).alias("t", "feat"))


def batch_valid(df: DataFrame, batch: str = "batch_id", valid: str = "valid") -> DataFrame:
    """FEA-06: one invalid sample voids the whole batch's feature matrix."""
    return df.groupBy(batch).agg(F.bool_and(valid).alias("batch_valid"), F.count(F.lit(1)).alias("n"))


def masked_mean(frames: DataFrame, mask: str = "m", floor_one: bool = True, feat: str = "feat") -> DataFrame:
    """SEQ-08: mask-weighted mean over positions per dimension.

    ``floor_one`` divides by max(sum(mask), 1) (one variant); otherwise by
    sum(mask) itself (null when it is 0).  Output (sample_id, value array).
    """
    return masked_means(frames, mask, feat).select("sample_id", F.col("value_floor" if floor_one else "value").alias("value"))


def masked_means(frames: DataFrame, mask: str = "m", feat: str = "feat") -> DataFrame:
    """SEQ-08, both variants from one pass: (sample_id, value_floor, value), a
    vector each."""
    x = frames.select("sample_id", feat, F.col(mask).cast("double").alias("_m")).filter(F.size(feat) > 0)
    s = reduce_vectors(x, _weighted, _plus, 2)
    return s.select("sample_id", F.zip_with("v0", "v1", lambda v, w: v / F.greatest(w, F.lit(1.0))).alias("value_floor"),
                    F.zip_with("v0", "v1", lambda v, w: v / F.when(w != 0, w)).alias("value"))

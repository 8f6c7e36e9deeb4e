"""Global numbering, modality batches, ordering and training-curve windows
(SMP-01 .. SMP-07, SMP-09, MET-16).

Global numbering inside a group (a modality signature can hold ~95% of the
rows) must not run as one window partition.  :func:`number_keys` numbers the
narrow key table alone: it is range-partitioned by (group, order), so a hot
group is split across many pieces, numbered inside each piece and written
once, with the piece as a stored value.  Offsets and group sizes come from the
piece counts of that table (at most one row per piece and group), and
:func:`global_row_number` joins the numbers back to whole rows on the unique
key, which has no hot value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_once
from .selection import kth_smallest


def number_keys(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "rn", size: str = "group_n",
                num_partitions: int | None = None) -> DataFrame:
    """``group, order, out, copies, size`` for each distinct key: the 1-based
    number of its first row inside its group in ``order``, the rows that have
    the key (1 where ``order`` is unique) and the rows of the group.  Null is a
    group, and comes first in the order, like any other value."""
    group, order = list(group), list(order)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = list(dict.fromkeys(group + order))
    keys = df.groupBy(*names).agg(F.count(F.lit(1)).alias("copies"))
    ranged = keys.repartitionByRange(n, *[F.col(c) for c in names]).withColumn("_piece", F.spark_partition_id())
    w = Window.partitionBy("_piece", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = write_once(ranged.withColumn("_local", F.sum("copies").over(w) - F.col("copies") + 1), "numbered_keys")
    counts = pieces.groupBy("_piece", *group).agg(F.sum("copies").alias("_cnt"))
    per_group = Window.partitionBy(*[F.col(g) for g in group] or [F.lit(1)])
    before = per_group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(F.col("_piece").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
                         F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
                         F.sum("_cnt").over(per_group).alias("_size"))
    on = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_piece") == F.col("_p"))
    return pieces.join(offs, on).select(*names, (F.col("_local") + F.col("_off")).cast("bigint").alias(out), "copies",
                                        F.col("_size").cast("bigint").alias(size))


def global_row_number(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "rn",
                      num_partitions: int | None = None, size: str | None = None) -> DataFrame:
    """All rows and columns of ``df`` with their 1-based number inside ``group``
    by ``order`` and, if ``size`` names a column, the rows of the group.  Rows
    with one and the same key are numbered in any order; no row is lost."""
    keys = number_keys(df, group, order, "_rn", "_n", num_partitions)
    names = [c for c in keys.columns if c not in ("_rn", "_n", "copies")]
    k = keys.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)], "_rn", "_n")
    on = reduce(Column.__and__, [df[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(names)])
    same = Window.partitionBy(*[f"_k{i}" for i in range(len(names))]).orderBy("_rn")
    extra = [F.col("_n").alias(size)] if size else []
    return df.join(k, on).withColumn("_nth", F.row_number().over(same)).select(
        *df.columns, (F.col("_rn") + F.col("_nth") - 1).alias(out), *extra)


def group_sizes(df: DataFrame, group: Sequence[str], out: str = "group_n") -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias(out))


def modality_batches(df: DataFrame, size: int, drop_last: bool, sig: str = "modality_signature",
                     order: str = "sample_id") -> DataFrame:
    """SMP-01: batches homogeneous in signature: batch_no = (rn - 1) div size
    within the signature, in ``order``; with ``drop_last`` a trailing batch
    shorter than ``size`` is dropped.  Null signatures are skipped."""
    d = df.filter(F.col(sig).isNotNull())
    d = global_row_number(d, [sig], [order], size="_group_n")
    d = d.withColumn("batch_no", F.floor((F.col("rn") - 1) / size).cast("bigint"))
    if drop_last:
        d = d.filter(F.floor(F.col("_group_n") / size) > F.col("batch_no"))
    d = d.drop("_group_n")
    return d.withColumn("batch_id", F.concat_ws("#", F.col(sig), F.col("batch_no").cast("string")))


def homogeneous_check(batches: DataFrame, sig: str = "modality_signature") -> DataFrame:
    """SMP-02: per batch, whether it carries exactly one signature."""
    return batches.groupBy("batch_id").agg((F.count_distinct(sig) == 1).alias("homogeneous"))


def skip_batches(batches: DataFrame, n: int) -> DataFrame:
    """SMP-03: drop the first ``n`` batches of each signature (resume)."""
    return batches.filter(F.col("batch_no") >= n)


def resume_position(step: Column, batches_per_epoch: Column) -> Column:
    """SMP-03: struct(epoch, offset) for a global step (1-based)."""
    return F.struct(F.floor((step - 1) / batches_per_epoch).cast("bigint").alias("epoch"),
                    F.pmod(step - 1, batches_per_epoch).cast("bigint").alias("offset"))


# FIXED VALUES: multiplier and modulus of the round function (a Lehmer generator).
_MULTIPLIER, _MODULUS = 48271, 2147483647
ROUNDS = 6
#: Walks along a cycle; each leaves the range with a chance of less than a half.
WALKS = 128


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """Keys of the rounds from the seed."""
    keys, x = [], seed % _MODULUS + 1
    for _ in range(rounds):
        x = (x * _MULTIPLIER + 12345) % _MODULUS
        keys.append(x)
    return keys


def permuted(number: Column, n: Column, seed: int, bits: int) -> Column:
    """The place of ``number`` (0 .. n - 1) in a permutation of 0 .. n - 1 that
    the seed picks: a Feistel network over ``bits`` bits (2 ** bits >= n), walked
    along its cycle until it is in range again.  Every place is computed by
    itself: nothing is sorted, and any part of the order can be found again."""
    high, low = bits - bits // 2, bits // 2

    def once(x: Column) -> Column:
        # halves of unequal width swap their widths every round
        a, b, wa, wb = F.shiftright(x, low), x.bitwiseAND((1 << low) - 1), high, low
        for k in round_keys(seed):
            mixed = ((b + 1) * F.lit(_MULTIPLIER) + F.lit(k)) % _MODULUS * F.lit(_MULTIPLIER) % _MODULUS
            a, b, wa, wb = b, a.bitwiseXOR(F.shiftright(mixed, 7).bitwiseAND((1 << wa) - 1)), wb, wa
        return F.shiftleft(a, wb).bitwiseOR(b)

    first = once(number.cast("bigint"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(first < n, first).when(walked < n, walked).otherwise(F.raise_error(F.lit("no place found")).cast("bigint"))


def seeded_shuffle(df: DataFrame, seed: int, key: str = "sample_id") -> DataFrame:
    """SMP-04: ``df`` with ``position``, its place (from 0) in a seeded order of
    all rows (not the reference's permutation).  Rows are numbered by ``key``, by
    all tasks, and the place is computed from the number, so the order is part of
    the table: it survives writing, and :func:`resume` goes on anywhere."""
    numbered = global_row_number(df, [], [key], "_rn", size="_all")
    n = df.count()
    bits = max(2, (n - 1).bit_length())
    at = permuted(F.col("_rn") - 1, F.lit(n).cast("bigint"), seed, bits)
    return numbered.withColumn("position", at).drop("_rn", "_all")


def resume(shuffled: DataFrame, offset: int, rows: int | None = None) -> DataFrame:
    """SMP-03 over SMP-04: the rows from place ``offset`` on, in order, or the next
    ``rows`` of them.  On a table written with :func:`write_shuffled` the places
    are pushed down to the files."""
    d = shuffled.filter(F.col("position") >= offset)
    if rows is not None:
        d = d.filter(F.col("position") < offset + rows)
    return d.orderBy("position")


def write_shuffled(shuffled: DataFrame, path: str, files: int) -> None:
    """Write in the order of ``position``, each file a stretch of it."""
    shuffled.repartitionByRange(files, "position").sortWithinPartitions("position").write.mode("overwrite").parquet(path)


def cap_samples(batches: DataFrame, n: int, size: int) -> DataFrame:
    """SMP-05: the cap is tested at the start of each batch, so a batch that
    starts below ``n`` is kept whole (up to size - 1 extra rows)."""
    return batches.filter(F.col("batch_no") * size < n)


def early_stop(hist: DataFrame, key: str, order: str, metric: str, patience: int,
               epoch: str | None = None, counted: Column | None = None) -> DataFrame:
    """SMP-06: running best (from 0.0, strict improvement), streak of
    non-improving evaluations, and the first point where the streak reaches
    ``patience`` (patience 0 stops at the first).

    Without ``epoch`` every evaluation ends an epoch.  With it there may be many
    evaluations an epoch, and the stop is tested only after the last one of each:
    a streak that an improvement ends within the epoch stops nothing, and
    ``stop_at`` is an epoch.  ``counted`` tells the evaluations that lengthen or
    end the streak (those by steps, say); the others only raise the best.

    The window is one run's evaluation history, bounded by the training schedule.
    """
    run = Window.partitionBy(key).orderBy(order)
    w_prev, w_cum = run.rowsBetween(Window.unboundedPreceding, -1), run.rowsBetween(Window.unboundedPreceding, 0)
    counted = F.lit(True) if counted is None else counted
    h = hist.withColumn("_prev_best", F.greatest(F.coalesce(F.max(metric).over(w_prev), F.lit(0.0)), F.lit(0.0)))
    h = h.withColumn("improved", F.col(metric) > F.col("_prev_best"))
    h = h.withColumn("best_so_far", F.greatest(F.col("_prev_best"), F.col(metric)))
    h = h.withColumn("_nth", F.count_if(counted).over(w_cum))
    ended = F.max(F.when(F.col("improved") & counted, F.col("_nth"))).over(w_cum)
    h = h.withColumn("streak", (F.col("_nth") - F.coalesce(ended, F.lit(0))).cast("bigint"))
    at = order if epoch is None else epoch
    last = F.lit(True) if epoch is None else ~F.lead(epoch).over(run).eqNullSafe(F.col(epoch))
    h = h.withColumn("_tested", last)
    stop_at = F.min(F.when(F.col("_tested") & (F.col("streak") >= patience), F.col(at))).over(Window.partitionBy(key))
    return h.withColumn("stop_at", stop_at).drop("_prev_best", "_nth", "_tested")


def best_checkpoint(hist: DataFrame, key: str, order: str, loss: str) -> DataFrame:
    """SMP-07: running minimum of the validation loss and the best point."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("best_loss", F.min(loss).over(w))
    best = hist.groupBy(key).agg(F.min_by(order, loss).alias("best_at"))
    return h.join(best, key)


def collate(batches: DataFrame, cols: Sequence[str], order: str = "rn") -> DataFrame:
    """SMP-09: one row per batch with each column as a list in batch order
    (a batch is bounded by the batch size)."""
    g = batches.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("_r"))
    def field(name):
        return lambda x: x[name]
    return g.select("batch_id", *[F.transform("_r", field(c)).alias(c) for c in cols])


def p99_lower(df: DataFrame, group: Sequence[str], value: str, q: float = 0.99) -> DataFrame:
    """MET-16: sorted[int(q * (n - 1))] per group (0-based rank on the lower
    side; neither percentile_disc nor percentile_approx uses this rank), as
    ``group, p99, n``.  Exact, by :func:`.selection.kth_smallest`; a group with
    most of the rows is counted by all tasks."""
    r = kth_smallest(df, group, value, {"p99": F.floor(F.lit(q) * (F.col("n") - 1)).cast("bigint") + 1})
    return r.select(*group, "p99", "n")

"""Exact selection of ranked values in all groups at once, without sorting.

Values become 64-bit numbers of the same order.  The value of rank k is narrowed
from its highest bits down: a histogram of the next digit over the rows that
share the digits found so far, counted with map-side combining, tells which digit
holds the rank.  A group of any size is counted by all tasks, and what is
shuffled is at most ``DIGIT`` bits of counts per group and task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_once

#: Bits of a digit.
DIGIT = 18
_FLIP = np.int64(0x7FFF_FFFF_FFFF_FFFF)


@F.pandas_udf(T.LongType())
def _to_key(v: pd.Series) -> pd.Series:
    """Numbers in the order of doubles (-0.0 is 0.0, NaN is the greatest)."""
    x = v.to_numpy(np.float64) + 0.0
    b = np.where(np.isnan(x), np.nan, x).view(np.int64)
    return pd.Series(np.where(b < 0, b ^ _FLIP, b))


@F.pandas_udf(T.DoubleType())
def _from_key(k: pd.Series) -> pd.Series:
    b = k.to_numpy(np.int64)
    return pd.Series(np.where(b < 0, b ^ _FLIP, b).view(np.float64))


def kth_smallest(df: DataFrame, group: Sequence[str], value: str, ranks: dict[str, Column], count: str = "n") -> DataFrame:
    """One row a group: ``group, count`` and for each of ``ranks`` (a 1-based rank
    as an expression of the column ``count``) the value of that rank.  Nulls come
    first; a rank below 1 or above the count gives null.  ``df`` is read once a
    digit: pass a written table if it costs much."""
    kind = df.schema[value].dataType
    real = isinstance(kind, (T.DoubleType, T.FloatType))
    names = [f"_g{i}" for i in range(len(group))] or ["_g0"]
    cols = [F.col(c).alias(n) for c, n in zip(group, names)] or [F.lit(0).alias("_g0")]
    v = F.col(value)
    d = df.select(*cols, F.when(v.isNotNull(), _to_key(F.coalesce(v.cast("double"), F.lit(0.0)))).alias("_v") if real else v.cast("bigint").alias("_v"))
    steps = list(range(0, 64, 4))
    wide = [F.max(F.coalesce(F.expr(f"try_subtract(shiftright(_hi, {s}), shiftright(_lo, {s}))"),
                             F.when(F.col("_lo").isNotNull(), F.lit(1 << 62)).otherwise(0))).alias(f"w{s}") for s in steps]
    most = Observation(f"select-{uuid.uuid4().hex}")
    sizes = write_once(d.groupBy(*names).agg(F.count(F.lit(1)).alias(count), F.count("_v").alias("_there"),
                                             F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).observe(most, *wide), "select_sizes")
    shift = next(s for s in steps if (most.get[f"w{s}"] or 0) < 1 << DIGIT)
    # ranks among the values that are there
    asked = F.array(*[F.struct(F.lit(q).alias("_q"), (k.cast("bigint") - (F.col(count) - F.col("_there"))).alias("_k")) for q, k in ranks.items()])
    todo = sizes.select(*names, F.inline(asked)).filter("_k >= 1")
    hist = d.filter("_v IS NOT NULL").groupBy(*names, F.shiftright("_v", shift).alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
    found = _digit(todo, hist, names)
    while shift:
        found = write_once(found, "select_digit")
        below = max(0, shift - DIGIT)
        rows = _join(d, found.select(*names, "_q", F.col("_d").alias("_p")), names).filter(F.shiftright("_v", shift) == F.col("_p"))
        hist = rows.groupBy(*names, "_q", F.shiftright("_v", below).alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
        found = _digit(found.drop("_d"), hist, [*names, "_q"])
        shift = below
    got = F.map_from_entries(F.collect_list(F.struct("_q", "_d")))
    out = _join(sizes, found.groupBy(*names).agg(got.alias("_m")), names, "left")
    back = (lambda c: _from_key(F.coalesce(c, F.lit(0))).cast(kind)) if real else (lambda c: c.cast(kind))
    picked = [F.try_element_at("_m", F.lit(q)) for q in ranks]
    return out.select(*[F.col(n).alias(c) for c, n in zip(group, names)], count,
                      *[F.when(p.isNotNull(), back(p)).alias(q) for q, p in zip(ranks, picked)])


def _join(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """A join in which null is a key like any other, with the columns of both."""
    r = right.select(*[F.col(n).alias(f"{n}_") for n in names], *[c for c in right.columns if c not in names])
    return left.join(r, reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]), how).drop(*[f"{n}_" for n in names])


def _digit(todo: DataFrame, hist: DataFrame, names: list[str]) -> DataFrame:
    """Of the asked ranks ``_k`` (keys, _q), the digit ``_d`` that holds each, and
    the rank within it.  A histogram has few digits a key."""
    w = Window.partitionBy(*names).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    h = hist.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    j = _join(todo, h, names).filter((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_c")))
    return j.withColumn("_k", F.col("_k") - F.col("_before")).drop("_before", "_c")

"""Joins whose key may be held by a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1 / SHARE of all rows, so there are fewer
#: than SHARE hot keys whatever the size of the table.
SHARE = 1000


def join_unique(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, share: int = SHARE) -> DataFrame:
    """Inner join of ``left`` with ``right``, which is unique in ``key``.

    ``weight`` is a column of ``right``, of which the sum is at most ``total``,
    and says how many rows of ``left`` have the key.  The rows of the few hot keys
    are broadcast, so ``left``'s rows of such keys stay where they are; all others
    meet in a shuffle whose largest key is bounded.  Both tables are read twice."""
    limit = F.lit(max(1, total // share))
    hot = F.broadcast(right.filter(F.col(weight) > limit))  # fewer than ``share`` rows
    rest = left.join(hot.select(key), key, "left_anti").join(right.filter(F.col(weight) <= limit), key)
    return left.join(hot, key).unionByName(rest)

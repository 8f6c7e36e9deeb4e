"""Helpers shared by the training-data operators.

* :func:`materialise` cuts lineage with a written table in the shared folder
  named by ``spark.checkpoint.dir`` (never a machine-local folder on a
  cluster), so lost executors cost a re-read and not a recomputation.
* :func:`join_on_hot_key` joins a table whose key may be held by a third of
  all rows with a unique right side.
* :func:`keep_rows` filters whole rows by a table of kept row keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A key counts as hot when it holds more than 1 / HOT_SHARE of all rows, so
#: there are fewer than HOT_SHARE hot keys whatever the size of the table.
HOT_SHARE = 1000


def shared_path(spark, name: str) -> str:
    """A path not used before, below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text is divisible by ``folds``; a null id
    counts as the text ``null``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(folds)) == 0


def row_key(id_col: Column, text_col: Column) -> Column:
    """A null-safe key of (id, text): one for all repeated rows."""
    return F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("null")),
                       F.xxhash64(F.coalesce(text_col, F.lit(""))).cast("string"))


def join_on_hot_key(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, share: int = HOT_SHARE) -> DataFrame:
    """Inner join ``left`` with ``right`` (unique in ``key``) on ``key``.

    ``weight`` is a column of ``right`` whose sum over the table is at most
    ``total``; it says how many rows of ``left`` a key has.  Keys heavier than
    ``total / share`` are fewer than ``share`` by counting, so they are
    broadcast; the others meet in an ordinary shuffle join whose largest key
    is bounded.  Both tables should be materialised: each is read twice.
    """
    limit = F.lit(max(1, total // share))
    hot = F.broadcast(right.filter(F.col(weight) > limit))
    cold = right.filter(~(F.col(weight) > limit))
    a = left.join(hot, key)
    b = left.join(hot.select(key), key, "left_anti").join(cold, key)
    return a.unionByName(b)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with more underscores if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def same_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with the columns ``names``, whatever characters they hold."""
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in names])


def keep_rows(docs: DataFrame, keepers: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose :func:`row_key` is in ``keepers`` (one column
    ``row_key``, unique), one of each set of repeated rows, with the columns of
    ``docs``.  One shuffle; the row number reuses the join's order."""
    from pyspark.sql import Window

    k, n = free_name(docs, "__row_key"), free_name(docs, "__row_no")
    d = docs.withColumn(k, row_key(docs[id_col], docs[text_col]))
    j = d.join(keepers.select(F.col("row_key").alias(k)), k)
    first = j.withColumn(n, F.row_number().over(Window.partitionBy(k).orderBy(k)))
    return same_columns(first.filter(F.col(n) == 1), docs.columns)


def by_bytes(batches, column: int, limit: int):
    """Slices of Arrow batches whose text or binary column holds about ``limit``
    bytes (more where one value does)."""
    import pyarrow.compute as pc

    for b in batches:
        first = held = 0
        for i, n in enumerate(pc.binary_length(b.column(column)).fill_null(0).to_pylist()):
            if held and held + n > limit:
                yield b.slice(first, i - first)
                first, held = i, 0
            held += n
        if b.num_rows > first:
            yield b.slice(first)


def as_batches(rows: int = 512):
    """Split incoming Arrow batches so that a task holds few long texts at once."""
    def split(batches):
        for b in batches:
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)
    return split

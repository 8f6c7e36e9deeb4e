"""Operator 10: exact deduplication against a persistent digest index.

The index is a catalog table of one row per distinct digest, bucketed and
sorted by digest.  A batch is reduced to (digest, keep row, size) with map-side
combining; a sort-merge anti-join with the index (whose side is neither
shuffled nor sorted again) finds the digests not seen before, and these are
appended.  Only ids and 32-byte digests move, never texts.

Defined results.  Texts are equal when identical after lower-casing A-Z; null
counts as empty.  Of equal texts in a batch the row with the largest id stays
(null ids come last; of repeated rows with one id exactly one stays); a text
already in the index keeps the row that the index names and all rows of the
batch go.  ``group_size`` counts the batch's rows.  Empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, join_on_hot_key, keep_rows, materialise, row_key


class DigestIndex:
    """A digest index kept in the catalog table ``table``.

    ``buckets`` is fixed when the table is made and defaults to the session's
    shuffle partitions (with fewer buckets Spark would shuffle the index too).
    Set it for the size the index shall reach.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table = spark, table
        if not spark.catalog.tableExists(table):
            n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.sql(f"CREATE TABLE {table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
                      f"CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS")

    def drop(self) -> None:
        """Remove the index; results of :meth:`admit` stay readable."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def admit(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str | None = None) -> DataFrame:
        """Deduplicate ``batch`` against the index and itself, append its new
        digests, and return one row per row of the batch: ``doc_id, row_key,
        keep_id, group_size, kept, text_sha256``.

        ``name`` names the batch (any new name by default).  Digests that the
        index has under this name are the batch's own, so a batch admitted again
        under its name, as after a driver lost between append and output, gets the
        same result and appends nothing."""
        name = uuid.uuid4().hex if name is None else name
        digests = materialise(batch.select(
            F.col(id_col).cast("bigint").alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"),
            F.unhex(F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row")), "digests")
        total = digests.count()
        groups = materialise(digests.groupBy("digest").agg(
            F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
        fresh = groups.join(self.spark.table(self.table).hint("merge"), "digest", "left_anti")
        (fresh.select("digest", F.col("keep.doc_id").alias("keep_id"), F.lit(name).alias("batch"))
              .sortWithinPartitions("digest").write.insertInto(self.table))
        index = self.spark.table(self.table).hint("merge")
        resolved = materialise(groups.join(index, "digest").select(
            "digest", "keep_id", "group_size",
            F.when(F.col("batch") == name, F.col("keep.row")).alias("keep_row")), "digest-resolved")
        out = join_on_hot_key(digests, resolved, "digest", "group_size", total)
        return out.select("doc_id", "row_key", "keep_id", "group_size",
                          F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
                          F.lower(F.hex("digest")).alias("text_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as the first batch of a new index."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    out = index.admit(docs).drop("row_key")
    index.drop()  # what was admitted is written
    return out


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the kept row of each group of equal texts."""
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    decisions = materialise(index.admit(docs), "digest-kept")
    index.drop()
    return keep_rows(docs, decisions.filter("kept").select("row_key"))


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""

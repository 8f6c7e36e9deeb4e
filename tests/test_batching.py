"""Global numbering on wide rows against a plain window (SF 0.1: 600,000 rows)."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessellate.operators import batching as B

BIG = "/root/testdata/sf0.1"


@pytest.mark.parametrize("table,group,order", [
    ("lineitem", ["l_returnflag"], ["l_orderkey", "l_linenumber"]),  # keys repeat
    ("events", ["event_type"], ["event_id"]),
])
def test_wide_rows_keep_exact_numbers(spark, table, group, order):
    df = spark.read.parquet(f"{BIG}/{table}.parquet")
    got = B.global_row_number(df, group, order, "rn", num_partitions=16, size="n")
    w = Window.partitionBy(*group)
    exp = df.select(*group, *order, F.row_number().over(w.orderBy(*order)).cast("bigint").alias("rn"), F.count(F.lit(1)).over(w).alias("n"))
    assert got.columns == df.columns + ["rn", "n"]
    mine = got.select(exp.columns)
    assert mine.count() == df.count()
    assert mine.exceptAll(exp).count() == 0
    # the rows themselves are all there, once each
    assert got.drop("rn", "n").exceptAll(df).count() == 0


def test_null_groups_and_no_group(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), (None, 3), ("a", None)], "g string, k int")
    got = {(r.g, r.k): r.rn for r in B.global_row_number(df, ["g"], ["k"]).collect()}
    assert got == {(None, 1): 1, (None, 3): 2, ("a", None): 1, ("a", 2): 2}
    assert sorted(r.rn for r in B.global_row_number(df, [], ["g", "k"]).collect()) == [1, 2, 3, 4]


def test_modality_batches_on_whole_samples(spark):
    from tessellate.plans import fixtures as X
    s = X.samples(spark, "/root/testdata/sf0.01")
    b = B.modality_batches(s, 8, drop_last=False)
    sizes = b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("d"))
    assert b.count() == s.filter("modality_signature is not null").count()
    assert sizes.filter("n > 8 or n <> d").count() == 0

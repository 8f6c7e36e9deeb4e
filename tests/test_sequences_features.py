import pytest
from pyspark.sql import functions as F

from tessellate.functions import sequences as S
from tessellate.operators import features as FE


def test_pad_truncate_middle(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6, 7],), ([1, 2],)], "ids array<int>")
    out = [r.o for r in df.select(S.pad_or_truncate("ids", 4, pad_id=0, left_pad=True, truncation="middle")
                                  .alias("o")).collect()]
    assert out == [[1, 2, 6, 7], [0, 0, 1, 2]]


def test_position_ids_gaps(spark):
    df = spark.createDataFrame([([0, 0, 1, 1, 0, 1],), ([],), (None,)], "m array<int>")
    out = [r.p for r in df.select(S.position_ids("m").alias("p")).collect()]
    assert out == [[0, 0, 0, 1, 1, 2], [], None]


def test_loss_mask(spark):
    df = spark.createDataFrame([([1, 1, 1, 1, 1, 0],)], "a array<int>")
    m = df.select(S.loss_mask("a", F.lit(3), F.lit(5), 6).alias("m")).first().m
    assert m == [0, 0, 1, 1, 0, 0]


def test_kth_smallest_quantiles(spark):
    rows = [(1, t, [float(v)]) for t, v in enumerate([5.0, 1.0, 3.0])]
    df = spark.createDataFrame(rows, "sample_id bigint, t bigint, feat array<float>")
    p = FE.pool(df, "meanstdp25p75").first().pooled
    assert p[2] == 1.0 and p[3] == 3.0  # T=3: q=0.25 -> 1st smallest, q=0.75 -> 2nd smallest


def test_pool_none_needs_single_frame(spark):
    rows = [(1, 0, [1.0, 2.0]), (2, 0, [1.0, 2.0]), (2, 1, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "sample_id bigint, t bigint, feat array<float>")
    got = {r.sample_id: r.pooled for r in FE.pool(df, "none").collect()}
    assert got[1] == [1.0, 2.0] and got[2] is None


def test_pose_samples_without_valid_part_keep_their_row(spark):
    kp = [[[1.0, 2.0]], [[3.0, 4.0]]]
    df = spark.createDataFrame([(1, "pose", kp), (2, "pose", [[[1.0]]]), (3, "pose", kp), (3, "face", kp[:1]), (4, "pose", None)],
                               "sample_id bigint, part string, kp array<array<array<float>>>")
    got = {r.sample_id: (r.valid, r.n_frames) for r in FE.pose_frames(df).collect()}
    assert got == {1: (True, 2), 2: (False, 0), 3: (False, 1), 4: (False, 0)}

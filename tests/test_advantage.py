import pytest
from pyspark.sql import functions as F

from tessellate.operators import advantage as A
from tessellate.plans import fixtures as X
from tessellate.streaming.ema import ema_fold

SF = "/root/testdata/sf0.001"


def test_group_norm_zero_mean(spark):
    df = A.group_norm(A.minmax_scale(A.rollout_reward(X.rollouts(spark, SF))))
    g = df.groupBy("step", "qid").agg(F.avg("adv").alias("m"), F.stddev_pop("scaled").alias("sd"),
                                      F.count(F.lit(1)).alias("n"))
    bad = g.filter((F.col("n") >= 2) & (F.col("sd") > 1e-6) & (F.abs("m") > 1e-9)).count()
    assert bad == 0


def test_ema_seeds(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0)], "k string, s int, v double")
    r = [x.ema for x in ema_fold(df, ["k"], "s", "v", 0.95, seed="first").orderBy("s").collect()]
    assert r[-1] == pytest.approx(1.1475)
    z = [x.ema for x in ema_fold(df, ["k"], "s", "v", 0.95, seed=0.0).orderBy("s").collect()]
    assert z[0] == pytest.approx(0.05)


def test_advantage_repartition_invariant(spark):
    ro = X.rollouts(spark, SF)
    a = {r.rollout_id: r.advantage for r in A.group_relative_advantage(ro.repartition(1)).collect()}
    b = {r.rollout_id: r.advantage for r in A.group_relative_advantage(ro.repartition(7)).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9)


def test_single_rollout_question_keeps_value(spark):
    df = A.group_norm(A.minmax_scale(A.rollout_reward(X.rollouts(spark, SF))))
    n = df.groupBy("step", "qid").agg(F.count(F.lit(1)).alias("n"))
    singles = df.join(n.filter("n = 1"), ["step", "qid"])
    assert singles.count() > 0
    assert singles.filter(F.col("adv") != F.col("scaled")).count() == 0

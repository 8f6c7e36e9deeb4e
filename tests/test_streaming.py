"""Streams: steps in parts, state that outlives stops, the scan of long histories."""
import tempfile

import pytest
from pyspark.sql import functions as F

from tessellate.operators import advantage as A
from tessellate.streaming import advantage_stream as ST
from tessellate.streaming.ema import Ema, ema_folds, ema_scan
from tessellate.streaming.ema_stream import write_ema_stream

SCHEMA = "step bigint, rollout_id bigint, qid string, task string, dataset string, token_rewards array<double>, response_mask array<int>, step_size bigint"
BIG = 1 << 60


def _rows(steps, per=8):
    return [(s, BIG + s * 100 + i, f"{s}-{i // 2}", "ab"[i % 2] if i else None, "d", [float((s * 7 + i * i) % 11)], [1], per)
            for s in steps for i in range(per)]


def _feed(spark, base, rows, cfg=A.AdvantageConfig(mode="z_score"), **how):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/src")
    src = spark.readStream.schema(SCHEMA).parquet(f"{base}/src")
    ST.advantage_stream(spark, src, f"{base}/out", f"{base}/state", f"{base}/ckpt", cfg, **how).awaitTermination()


def _same_as_batch(spark, base, rows, cfg):
    batch = A.group_relative_advantage(spark.createDataFrame(rows, SCHEMA), cfg)
    j = spark.read.parquet(f"{base}/out").join(batch.select("rollout_id", F.col("advantage").alias("b")), "rollout_id")
    assert j.count() == len(rows) and j.filter(F.abs(F.col("advantage") - F.col("b")) > 1e-9).count() == 0


def test_steps_in_parts_by_their_size(spark):
    base, rows, cfg = tempfile.mkdtemp(prefix="adv-"), _rows([1, 2, 3, 5]), A.AdvantageConfig(scaling="arith", rarity=True, rare_ratio=0.5)
    for part in (rows[:21], rows[21:]):
        _feed(spark, base, part, cfg, size="step_size")
    _same_as_batch(spark, base, rows, cfg)
    assert ST.latest_version(spark, f"{base}/state", before=1) == 0 and ST.latest_version(spark, f"{base}/nowhere") is None
    with pytest.raises(Exception, match="steps must come whole"):
        _feed(spark, base, _rows([5]), cfg, size="step_size")


def test_steps_in_parts_by_the_next_step_and_out_of_order(spark):
    base, rows, cfg = tempfile.mkdtemp(prefix="adv-"), _rows([1, 2, 3, 4]), A.AdvantageConfig(mode="z_score")
    # rows of step 1 come after some of step 2; step 9 ends the others
    mixed = rows[:5] + rows[8:11], rows[5:8] + rows[11:20], rows[20:], _rows([9], 1)
    for part in mixed:
        _feed(spark, base, part, cfg, shards=2, patience=1)
    _same_as_batch(spark, base, rows, cfg)


def test_averages_in_keyed_state_outlive_stops_and_absence(spark):
    base = tempfile.mkdtemp(prefix="ema-")
    rows = [(k, s, float((s * 13 + ord(k)) % 17) if s != 4 else None) for s in range(12) for k in "abc" if not (k == "b" and 2 < s < 9)]
    emas = [Ema("x", 0.9, "one"), Ema("x", 0.5, "two", seed=0.0, clamp=(1.0, 5.0))]
    kind = "k string, step bigint, x double"
    for part in (rows[:7], rows[7:8], rows[8:20], rows[20:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{base}/src")
        src = spark.readStream.schema(kind).parquet(f"{base}/src")
        write_ema_stream(src, ["k"], "step", emas, f"{base}/out", f"{base}/ckpt").awaitTermination()
    d = spark.createDataFrame(rows, kind)
    want = sorted(map(tuple, ema_folds(d, ["k"], "step", emas).select("k", "step", F.round("one", 9), F.round("two", 9)).collect()))
    got = spark.read.parquet(f"{base}/out").select("k", "step", F.round("one", 9), F.round("two", 9))
    assert sorted(map(tuple, got.collect())) == want
    spark.createDataFrame([("a", 3, 1.0)], kind).write.mode("append").parquet(f"{base}/src")
    with pytest.raises(Exception, match="must come in order"):
        write_ema_stream(spark.readStream.schema(kind).parquet(f"{base}/src"), ["k"], "step", emas, f"{base}/out", f"{base}/ckpt").awaitTermination()


@pytest.mark.parametrize("block", [4, 1000])
def test_scan_equals_fold(spark, block):
    rows = [("ab"[i % 5 == 0], i, float(i * i % 23) if i % 41 else None) for i in range(400)] + [("c", 5, 1.0), (None, 1, 2.0), (None, 2, 4.0)]
    d = spark.createDataFrame(rows, "k string, step bigint, x double")
    emas = [Ema("x", 0.9, "one"), Ema("x", 0.5, "two", seed=0.0, clamp=(3.0, 9.0)), Ema("x", 0.0, "three"), Ema("x", 0.7, "four", clamp=(8.0, 20.0))]
    state = spark.createDataFrame([("a", 3.0, 4.0, 1.0, 9.0), ("z", 1.0, 1.0, 1.0, 9.0)], "k string, one double, two double, three double, four double")
    cols = ["k", "step", *[F.round(c, 9) for c in ("one", "two", "three", "four")]]
    for init in (None, state):
        want = ema_folds(d, ["k"], "step", emas, init).select(*cols).collect()
        got = ema_scan(d, ["k"], "step", emas, init, block=block).select(*cols).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == len(rows)


def test_fold_of_long_histories_and_bounds(spark):
    n = 1000
    df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("step"), (F.col("id") % 7).cast("double").alias("x"))
    got = {r.step: (r.a, r.b) for r in ema_folds(df, ["k"], "step", [Ema("x", 0.9, "a"), Ema("x", 0.5, "b", seed=0.0, clamp=(1.0, 2.0))]).collect()}
    a, b = None, 0.0
    for i in range(n):
        x = float(i % 7)
        a = 0.9 * (x if a is None else a) + 0.1 * x
        b = min(2.0, max(1.0, 0.5 * b + 0.5 * x))
        assert got[i] == (pytest.approx(a), pytest.approx(b))


def test_metric_stream_is_fed_rows_as_they_come(spark, monkeypatch):
    """The files of the stream are cut from the input without a shuffle, whose
    round-robin sorts each task's rows in memory."""
    from tessellate.plans import q_io

    d, base = tempfile.mkdtemp(prefix="feed-"), tempfile.mkdtemp(prefix="metric-")
    rows = spark.range(0, 1003, 1, 1).selectExpr("id AS l_orderkey", "id AS l_partkey", "id % 10 AS l_suppkey", "CAST(0 AS INT) AS l_linenumber",
                                                 "IF(id % 50 = 0, NULL, 'ANR') AS l_returnflag")
    rows.write.mode("overwrite").parquet(f"{d}/lineitem.parquet")
    monkeypatch.setattr(q_io, "scratch_path", lambda spark, name: base)
    got = q_io.str03(spark, d)
    assert sum(r.n for r in got.collect()) == 1003
    files = spark.read.parquet(f"{base}/src").inputFiles()
    parts = [[r.y_true for r in spark.read.parquet(f).collect()] for f in files]
    assert len(parts) == 4 and sorted(map(len, parts)) == [250, 251, 251, 251]
    assert all(b == (a + 1) % 7 for p in parts for a, b in zip(p, p[1:]))  # rows that follow each other in the input
    assert ST.latest_version(spark, f"{base}/cells") == 3  # a micro-batch each

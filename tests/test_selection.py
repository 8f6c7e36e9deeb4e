"""Exact selection, pooled vectors, seeded order, early stops by steps."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellate.operators import batching as B
from tessellate.operators import features as FE
from tessellate.operators.selection import kth_smallest

WILD = [0.0, -0.0, 1.5, -1.5, 1e300, -1e300, 1e-300, -1e-300, float("inf"), float("-inf"), 3.25, 3.25, 3.25, float("nan")]


def _key(x):
    return (0, 0) if x is None else (2, 0) if math.isnan(x) else (1, x)


@pytest.mark.parametrize("kind", ["double", "bigint", "int"])
def test_ranks_equal_sorting(spark, kind):
    rnd = random.Random(3)
    pool = {"double": WILD + [rnd.gauss(0, 1e3) for _ in range(300)] + [None],
            "bigint": [0, -1, 1 << 62, -(1 << 63), (1 << 63) - 1, None] + [rnd.randint(-10**12, 10**12) for _ in range(200)],
            "int": [5, 5, 5, None] + [rnd.randint(-100, 100000) for _ in range(200)]}[kind]
    rows = [(rnd.choice(["hot"] * 20 + ["a", "b", None]), rnd.choice(pool)) for _ in range(3000)] + [("nulls", None), ("one", pool[0])]
    d = spark.createDataFrame(rows, f"g string, v {kind}").repartition(6)
    ranks = {"low": F.lit(1), "half": F.ceil(F.col("n") / 2), "p99": F.floor(0.99 * (F.col("n") - 1)) + 1, "out": F.col("n") + 1}
    got = {r.g: r for r in kth_smallest(d, ["g"], "v", ranks).collect()}
    assert len(got) == len({g for g, _ in rows})
    for g in got:
        v = sorted([x for h, x in rows if h == g], key=_key)
        want = [v[0], v[math.ceil(len(v) / 2) - 1], v[int(0.99 * (len(v) - 1))], None]
        assert got[g].n == len(v)
        for x, y in zip((got[g].low, got[g].half, got[g].p99, got[g].out), want):
            assert _key(x) == _key(y)


def test_a_group_with_most_rows_is_not_gathered(spark):
    d = spark.range(200_000).select(F.when(F.col("id") % 20 == 0, "cold").otherwise("hot").alias("g"), ((F.col("id") * 7919) % 200_003).alias("v"))
    got = {r.g: (r.p99, r.n) for r in B.p99_lower(d, ["g"], "v").collect()}
    for g, rest in (("cold", [0]), ("hot", range(1, 20))):
        v = sorted(i * 7919 % 200_003 for i in range(200_000) if i % 20 in rest)
        assert got[g] == (v[int(0.99 * (len(v) - 1))], len(v))
    assert B.p99_lower(d.limit(0), ["g"], "v").count() == 0
    assert B.p99_lower(d, [], "v").first().n == 200_000


def _frames(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, t bigint, feat array<float>, m double")


def _odd_frames():
    rnd = random.Random(4)
    rows = [(s, t, [None if rnd.random() < 0.05 else rnd.choice([-2.0, 0.0, 1.0, rnd.random()]) for _ in range(w)], float(t % 3 > 0))
            for s, n, w in (("a", 40, 5), ("b", 1, 5), ("c", 7, 3), (None, 9, 2)) for t in range(n)]
    # frames of other widths, without values, without weight
    return rows + [("c", 8, [1.0], 1.0), ("c", 9, [], 1.0), ("c", 10, None, 1.0), ("d", 0, None, 1.0), ("c", 11, [1.0, 2.0, 3.0, 4.0], None)]


def _want(rows, s, quantiles):
    lists = [f for k, _, f, _ in rows if k == s and f]
    out = []
    for d in range(max(map(len, lists))):
        col = [f[d] for f in lists if len(f) > d]
        v = np.array(sorted(np.float32(x) for x in col if x is not None), float)
        ks = [max(1, int(q * len(col))) - 1 for q in (0.25, 0.75)]
        out.append([v.mean(), v.std()] + [v[k] if k < len(v) else None for k in ks if quantiles])
    return [x for part in zip(*out) for x in part]


@pytest.mark.parametrize("clip", [1000, 5])
def test_pooled_vectors_equal_numpy(spark, clip):
    rows = _odd_frames()
    d = _frames(spark, rows).repartition(5)
    for mode in ("meanstd", "meanstdp25p75"):
        got = {r.sample_id: r for r in FE.pool(d, mode, clip=clip).collect()}
        assert set(got) == {"a", "b", "c", None} and got["a"].n_frames == 40 and got["c"].n_frames == 9
        for s in got:
            for x, y in zip(got[s].pooled, _want(rows, s, mode != "meanstd"), strict=True):
                assert (x is None and y is None) or x == pytest.approx(float(y), abs=1e-6)


def test_vectors_are_summed_without_exploding(spark, monkeypatch):
    monkeypatch.setattr(FE, "HELD", 16)  # many partial results
    rows = _odd_frames()
    d = _frames(spark, rows)
    assert FE.pool(d, "meanstd").filter("sample_id = 'a'").first().pooled == pytest.approx(_want(rows, "a", False), abs=1e-6)
    out = FE.masked_means(d, "m")
    for r in out.collect():
        lists = [(f, m or 0.0) for k, _, f, m in rows if k == r.sample_id and f]
        for i in range(len(r.value)):
            num = sum((np.float32(f[i]) if f[i] is not None else 0.0) * m for f, m in lists if len(f) > i)
            den = sum(m for f, m in lists if len(f) > i)
            assert r.value_floor[i] == pytest.approx(num / max(den, 1), abs=1e-6)
            assert r.value[i] == (pytest.approx(num / den, abs=1e-6) if den else None)
    for d in (out, FE.pool(d, "meanstd"), FE.pool(d, "meanstdp25p75")):
        assert "Generate" not in d._jdf.queryExecution().executedPlan().toString()
    assert FE.pool(_frames(spark, []), "meanstdp25p75").count() == FE.masked_means(_frames(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 3, 64, 1000])
def test_seeded_order_is_a_permutation(spark, n, tmp_path):
    d = spark.createDataFrame([(f"k{i:05d}", i) for i in range(n)], "sample_id string, x int")
    one = {r.sample_id: r.position for r in B.seeded_shuffle(d, 1).collect()}
    assert sorted(one.values()) == list(range(n))
    if n == 1000:
        assert one == {r.sample_id: r.position for r in B.seeded_shuffle(d.repartition(3), 1).collect()}
        other = {r.sample_id: r.position for r in B.seeded_shuffle(d, 2).collect()}
        order = np.array([one[k] for k in sorted(one)])
        assert other != one and abs(np.corrcoef(order, np.arange(n))[0, 1]) < 0.15
        B.write_shuffled(B.seeded_shuffle(d, 1), str(tmp_path / "s"), files=4)
        got = [r.sample_id for r in B.resume(spark.read.parquet(str(tmp_path / "s")), 400, 10).collect()]
        assert got == sorted(one, key=one.get)[400:410]


def test_stop_is_tested_at_the_ends_of_epochs(spark):
    # (epoch, f1, by steps): the streak of 2 in epoch 0 ends within it; the end evaluation of epoch 1 only raises the best
    h = [(0, 0.5, True), (0, 0.4, True), (0, 0.4, True), (0, 0.6, True), (0, 0.1, False), (1, 0.6, True), (1, 0.9, False), (2, 0.8, True), (2, 0.1, False), (3, 0.95, True)]
    d = spark.createDataFrame([("r", i, *x) for i, x in enumerate(h)], "run string, at int, epoch int, f1 double, by_step boolean")
    got = sorted(B.early_stop(d, "run", "at", "f1", 2, "epoch", F.col("by_step")).collect(), key=lambda r: r["at"])
    assert [r.streak for r in got] == [0, 1, 2, 0, 0, 1, 1, 2, 2, 0] and {r.stop_at for r in got} == {2}
    assert B.early_stop(d, "run", "at", "f1", 0, "epoch").first().stop_at == 0
    assert {r.stop_at for r in B.early_stop(d, "run", "at", "f1", 2).collect()} == {2}

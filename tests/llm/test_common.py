import pytest
from pyspark.sql import functions as F

from tessellate.llm import common as C
from tessellate.llm import components
from tessellate.llm.components import connected_components


def test_hot_keys_are_joined_whole(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("w"))
    out = C.join_on_hot_key(left, right, "k", "w", 5000)
    assert out.count() == 5000 and out.filter("k = 0").select("w").distinct().collect()[0][0] == 1667


def test_keep_rows_keeps_columns_and_one_of_repeated(make_docs):
    docs = make_docs([(1, "a"), (1, "a"), (2, None), (None, "b"), (3, "c")])
    keep = docs.filter("doc_id is null or doc_id < 3").select(C.row_key(F.col("doc_id"), F.col("text")).alias("row_key")).distinct()
    out = C.keep_rows(docs, keep)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r["__row_key"]) for r in out.collect()), key=str) == [(1, "a", "k"), (2, None, "k"), (None, "b", "k")]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_components_against_union_find(spark, monkeypatch, limit):
    import random
    monkeypatch.setattr(components, "ONE_TASK_EDGES", limit)
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(-5, i) for i in range(2000, 2200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    alone = {a for a, b in edges if a == b}
    assert {k: v for k, v in got.items()} == {x: find(x) for x in parent if x in got} and set(parent) - set(got) <= alone
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_rounds_of_few_edges_leave_the_driver_alone(spark):
    e = spark.range(50).selectExpr("id + 1 AS a", "id AS b")
    plan = components._round(e, 50, True)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert components._round(e, 50, True).count() > 0


def test_rounds_of_few_edges_have_a_small_plan(spark):
    e = spark.range(50).selectExpr("id + 1 AS a", "id AS b")
    plan = components._round(e, 50, True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") <= 2 and plan.count("HashAggregate") <= 8


def test_rounds_are_the_same_for_few_and_many_edges(spark):
    import random
    rnd = random.Random(11)
    pairs = {(max(a, b), min(a, b)) for a, b in ((rnd.randrange(80), rnd.randrange(80)) for _ in range(90)) if a != b}
    e = spark.createDataFrame(sorted(pairs), "a bigint, b bigint")
    few, many = ({tuple(r) for r in components._round(e, len(pairs), f).collect()} for f in (True, False))
    assert few == many

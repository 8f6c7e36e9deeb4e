import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellate.llm import mixing as M

from .conftest import ODD


def _cells(spark):
    rows = [(f"+s{s}", f"+l{l}", f"+t{t}", 1000 * (5 if s == 0 else 1) * (l + 1) + 37 * t) for s in range(4) for l in range(2) for t in range(3)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")


@pytest.mark.parametrize("few", [True, False])
def test_marginals_meet_targets(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(M, "MAX_ONE_TASK_CELLS", 0)
    cells = _cells(spark)
    targets = {"source": [("+s0", .4), ("+s1", .2), ("+s2", .2), ("+s3", .2)], "lang": [("+l0", .4), ("+l1", .6)], "topic": [("+t0", .4), ("+t1", .3), ("+t2", .3)]}
    frames = {d: spark.createDataFrame(v, "value string, share double") for d, v in targets.items()}
    total = cells.agg(F.sum("tokens")).first()[0]
    out = M.rake(cells, frames, budget=0.3)
    assert out.filter("weight > tokens or weight < 0").count() == 0 and out.count() == cells.count()
    for d, v in targets.items():
        got = {r[0]: r[1] for r in out.groupBy(d).agg(F.sum("weight")).collect()}
        for k, share in v:
            assert got[k] == pytest.approx(share * 0.3 * total, rel=0.01)


def _slow_cells(spark):
    """Cells with a heavy source whose raking takes 40 rounds."""
    rnd = np.random.default_rng(6)
    keys = [(s, l, t) for s in range(6) for l in range(3) for t in range(4) if rnd.random() < 0.6]
    tokens = np.floor(rnd.lognormal(5, 2, len(keys))) + 1
    big = np.array([s == 0 for s, _, _ in keys])
    tokens[big] *= max(1, 0.5 * tokens[~big].sum() / tokens[big].sum())
    rows = [(f"+s{s}", f"+l{l}", f"+t{t}", int(n)) for (s, l, t), n in zip(keys, tokens)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")
    return cells, {d: M.materialise(M.flattened_targets(cells, d), "targets") for d in ("source", "lang", "topic")}


def test_one_stop_rule_at_every_size(spark, monkeypatch):
    cells, targets = _slow_cells(spark)
    weights = lambda: {r[:3]: r.weight for r in M.rake(cells, targets, rounds=12).select("source", "lang", "topic", "weight").collect()}
    few = weights()
    monkeypatch.setattr(M, "MAX_ONE_TASK_CELLS", 0)
    assert weights() == pytest.approx(few, rel=1e-9)


def test_raking_goes_on_to_the_tolerance(spark):
    cells, targets = _slow_cells(spark)
    out = M.materialise(M.rake(cells, targets), "raked")
    for d, t in targets.items():
        goals = {r[0]: r[1] for r in M.goal_tokens(cells, d, t, M.BUDGET).collect()}
        for value, got in out.groupBy(d).agg(F.sum("weight")).collect():
            assert got == pytest.approx(goals[value], rel=M.TOLERANCE * 1.01)


def test_goals_never_exceed_what_a_value_has(spark):
    cells = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 2000)], "source string, tokens bigint")
    t = spark.createDataFrame([("a", .5), ("b", .25), ("c", .25)], "value string, share double")
    got = {r["__v"]: r["__goal"] for r in M.goal_tokens(cells, "source", t, 0.5).collect()}
    assert got["a"] == pytest.approx(10) and got["b"] == pytest.approx(got["c"]) and sum(got.values()) == pytest.approx(1505)


def test_documents_odd_rows_and_determinism(spark, make_docs):
    rows = [r + (None, None) for r in ODD] + [(100 + i, "some words about nothing special " * (i % 7 + 1), "en" if i % 3 else "de", f"s{i % 5}") for i in range(300)]
    docs = make_docs(rows)
    got = M.decisions(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
    assert {(r.doc_id, r.sampled) for r in got if r.doc_id == 4} in ({(4, True)}, {(4, False)})  # repeated rows: one decision
    a, b = M.stage_mixing(spark, docs, ""), M.stage_mixing(spark, docs, "")
    assert a.columns == docs.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert a.count() == sum(r.sampled for r in got)
    assert M.stage_mixing(spark, make_docs([]), "").count() == 0


def test_topics(spark):
    df = spark.createDataFrame([("alpha alpha alpha omega",), ("a b",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(M.hashed_topic(F.col("t"))).collect()]
    one = df.sparkSession.createDataFrame([("alpha",)], "t string").select(M.hashed_topic(F.col("t"))).first()[0]
    assert got == [one, "none", "none", "none"] and one.startswith("t")


def test_texts_without_ids_are_drawn_each(make_docs):
    docs = make_docs([(None, f"text number {i} of many") for i in range(400)] + [(5, f"other text {i}") for i in range(400)])
    got = M.decisions(docs).collect()
    for rows in ([r for r in got if r.doc_id is None], [r for r in got if r.doc_id == 5]):
        assert 120 < sum(r.sampled for r in rows) < 280
    twice = M.decisions(make_docs([(None, "one and the same text")] * 60)).collect()
    assert len(twice) == 60 and len({r.sampled for r in twice}) == 1

"""Rejects and counts of one pass, slices after filters, files of partitioned
writes, plug-ins: ids that stay whole, each text embedded once."""
import json

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellate.functions import udf as U
from tessellate.operators import advantage as A
from tessellate.operators import labels as L
from tessellate.operators import media as MD
from tessellate.operators import prompts as P
from tessellate.sources import readers as RD
from tessellate.sources import sinks as SK


def test_malformed_lines_are_counted_and_kept_in_one_pass(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": "x", "n": 1}\n\n   \n{broken\n{"k": "y"}\n{"k": "z", "n": "text"}\n')
    (tmp_path / "b.jsonl").write_text('[1\n{"k": "x", "n": 2}')
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.IntegerType())])
    rows, rejects, counts = RD.read_jsonl_with_rejects(spark, [str(tmp_path / f) for f in ("a.jsonl", "none.jsonl", "b.jsonl")], schema)
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    assert sorted((r.k, r.n) for r in rows.collect() if r.n) == [("x", 1), ("x", 2)]
    assert counts.get == {"nonblank_lines": 6, "parsed": 3, "malformed": 3}
    assert sorted((r._file.rsplit("/", 1)[1], r._line) for r in rejects.collect()) == [
        ("a.jsonl", '{"k": "z", "n": "text"}'), ("a.jsonl", "{broken"), ("b.jsonl", "[1")]


def test_filters_count_what_they_skip(spark):
    d = spark.createDataFrame([("Video", "a"), ("text", "b"), (None, "a"), ("", "c")], "modality_signature string, dataset string")
    seen = [Observation() for _ in range(3)]
    listed = spark.createDataFrame([("a",), ("z",)], "dataset string")
    assert P.filter_modality(d, ["videos"], seen[0]).count() == 1 and P.require_signature(d, False, seen[1]).count() == 4
    assert L.include_datasets(d, listed, seen[2]).count() == 2
    assert [o.get for o in seen] == [{"kept": 1, "dropped": 3, "null_signature": 1}, {"rows": 4, "rejected": 1}, {"kept": 2, "skipped": 2}]


def test_slices_after_a_filter(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(RD, "RUN", 16)
    for i in range(3):
        spark.range(i * 100, i * 100 + 70 + i * 15).coalesce(1).write.parquet(str(tmp_path / f"d{i}"))
        part = next((tmp_path / f"d{i}").glob("*.parquet"))
        part.rename(tmp_path / f"s-{i}.parquet")
    d = RD.read_split(spark, str(tmp_path), "s").filter("id % 3 <> 1")
    ids = [i for f in range(3) for i in range(f * 100, f * 100 + 70 + f * 15) if i % 3 != 1]
    for spec in ("s[0%:100%]", "s[0%:30%]", "s[13:77]", "s[50%:]", "s[99:100]", "s[40:40]"):
        name, a, b = RD.parse_split(spec)
        out = RD.split_slice(d, spec)
        assert sorted(r.id for r in out.collect()) == ids[int(len(ids) * a):int(len(ids) * b)], spec
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


def _files(path):
    return {d.name: len(list(d.rglob("part-*"))) for d in path.iterdir() if d.is_dir()}


def test_files_follow_the_size_of_the_values(spark, tmp_path):
    # 40 datasets in every one of 16 tasks, one with most of the rows
    d = spark.range(0, 40_000, 1, 16).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("d"), (F.col("id") % 390).cast("string"))).alias("dataset"),
        F.lit("train").alias("split"), F.col("id").alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    SK.export_by_dataset(d, str(tmp_path / "one"))
    files = _files(tmp_path / "one")
    assert len(files) == 40 and sum(files.values()) <= 60
    assert spark.read.parquet(str(tmp_path / "one")).count() == 40_000
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:  # a large value is spread over tasks
        SK.export_by_dataset(d, str(tmp_path / "two"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = _files(tmp_path / "two")
    assert files["dataset=hot"] > 1 and sum(files.values()) < 100


def test_documents_of_predictions(spark, tmp_path):
    rows = [(1, i, "d", f"p{i}", "p2", "t") for i in range(4)] + [(2, 0, "e", None, "x", "t")]
    d = spark.createDataFrame(rows, "step int, row_id int, dataset string, pred string, gold string, task string")
    for layout in ("arrays", "dump", "records"):
        SK.write_predictions(d, str(tmp_path / layout), layout)
    doc = json.loads(next((tmp_path / "dump" / "step=1").glob("part-*")).read_text())
    assert doc["predictions"] == ["p0", "p1", "p2", "p3"] and doc["overall_accuracy"] == 0.25 and doc["tasks"] == ["t"] * 4 and doc["global_step"] == 1
    records = json.loads(next((tmp_path / "records" / "step=1").glob("part-*")).read_text())
    assert records[2] == {"dataset": "d", "pred": "p2", "gold": "p2"}
    got = RD.read_predictions(spark, str(tmp_path / "arrays"), "arrays", multiline=False).collect()
    assert sorted(r.pred for r in got if r.dataset == "d") == ["p0", "p1", "p2", "p3"]
    with pytest.raises(ValueError):
        SK.write_predictions(d, str(tmp_path / "x"), "other")


BIG = (1 << 60) + 1


def test_ids_beside_nulls_stay_whole(spark):
    d = spark.createDataFrame([(BIG, "a b", "b", "t"), (None, None, None, None)], "id bigint, response string, truth string, task string").withColumn("dataset", F.lit("d"))
    assert {r.id for r in U.apply_reward_fn(d.coalesce(1), U.containment_reward, ["id"]).collect()} == {BIG, None}
    m = spark.createDataFrame([(BIG, [b"x"]), (None, [None])], "sample_id bigint, audios array<binary>").coalesce(1)
    assert {r.sample_id for r in MD.audio_profile(m).collect()} == {BIG, None}


def test_each_text_is_embedded_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def loader():
        import uuid

        def model(texts):
            (log / uuid.uuid4().hex).write_text(json.dumps(texts))
            return np.array([[len(t), sum(map(ord, t)) % 97] for t in texts], np.float32).reshape(-1, 2)
        return model

    rows = [(i, "common" if i % 2 else f"t{i % 30}", ["common", None, "t4", ""][i % 4]) for i in range(3000)]
    d = spark.createDataFrame(rows, "id bigint, a string, b string").repartition(6)
    out = U.embed_texts(d, ["a", "b"], loader).collect()
    asked = [t for f in log.iterdir() for t in json.loads(f.read_text())]
    assert sorted(asked) == sorted({x or "" for _, a, b in rows for x in (a, b)})
    model = loader()
    assert len(out) == 3000 and all(r.a_embedding == model([r.a])[0].tolist() and r.b_embedding == model([r.b or ""])[0].tolist() for r in out[:200])


def test_registered_similarity_equals_brute_force(spark):
    from tessellate.functions import rewards as R
    from tessellate.functions import text as TX
    from tessellate.plans import fixtures as X
    from tessellate.plans.q_io import udf02
    sf = "/root/testdata/sf0.001"
    embed = U.hashed_ngram_embedder(64)
    lab = F.lower(TX.py_strip(TX.boxed_reward(TX.tighten_tags("response"))))
    want = {}
    for r in X.responses(spark, sf).select("conv_id", "turn", lab.alias("p"), "truth").collect():
        a, b = embed([r.p, r.truth]).astype(float)
        want[r.conv_id, r.turn] = ((a @ b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12) + 1) / 2
    got = {(r.conv_id, r.turn): r.similarity for r in udf02(spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    assert R is not None


def test_hot_question_is_split(spark):
    """A question with a third of the rollouts: its rows meet one row of
    statistics; no window holds them."""
    d = spark.range(3000).select(F.lit(1).alias("step"), F.col("id").alias("rollout_id"),
                                 F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string")).alias("qid"),
                                 F.lit("t").alias("task"), F.lit("d").alias("dataset"), F.array((F.col("id") % 17).cast("double")).alias("token_rewards"))
    out = A.group_relative_advantage(d)
    assert out.count() == 3000 and "Window" not in out._jdf.queryExecution().executedPlan().toString()
    pos = {r.rollout_id: r.rollout_pos for r in A.rollout_pos(d.select("step", "qid", "rollout_id")).filter("qid = 'hot'").collect()}
    assert pos == {i: i // 3 for i in range(0, 3000, 3)}

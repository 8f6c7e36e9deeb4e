"""Source/sink, streaming, plug-in and media-profile queries.

These write Spark-derived tables under the shared checkpoint folder
(``spark.checkpoint.dir``) and read them back through the library readers.
"""

from __future__ import annotations

import io
import uuid
import wave

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rewards as R
from ..functions import text as TX
from ..functions import udf as U
from ..operators import advantage as A
from ..operators import labels as L
from ..operators import media as MD
from ..operators import prompts as P
from ..operators.batching import global_row_number
from ..session import scratch_path, write_once
from ..sources import readers as RD
from ..sources import sinks as SK
from ..streaming import advantage_stream as ST
from ..streaming.ema import Ema
from ..streaming.ema_stream import write_ema_stream
from . import fixtures as X
from . import q_advantage as QA
from . import q_labels as QL
from . import q_text as QT
from .registry import finish, query


def _samples_schema_rows(spark, sf_dir):
    s = X.samples(spark, sf_dir)
    return s.select(*[f.name for f in RD.SAMPLE_SCHEMA.fields])


@query("src01_read_split", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_in_file FROM documents")
def src01(spark, sf_dir):
    """Single-file form of the split reader, with row positions."""
    df = RD.read_split(spark, f"{sf_dir.rstrip('/')}/documents.parquet", "train")
    return df.select("doc_id", F.col("_row").alias("row_in_file"))


@query("src02_read_samples", """
SELECT dataset, 2 * count(*) AS n, CAST(2 * sum(len(images)) AS BIGINT) AS n_images, 2 * count(task) AS n_tasks,
       2 * count_if(audios IS NULL) AS no_audio, CAST(2 * sum(length(problem)) AS BIGINT) AS chars FROM samples GROUP BY 1""", ("samples",))
def src02(spark, sf_dir):
    base = scratch_path(spark, "samples_in")
    s = _samples_schema_rows(spark, sf_dir)
    s.write.mode("overwrite").parquet(f"{base}/samples.parquet")
    s.write.mode("overwrite").json(f"{base}/samples.jsonl")
    df = RD.read_samples(spark, [f"{base}/samples.parquet", f"{base}/samples.jsonl"])
    return df.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("images")).alias("n_images"), F.count("task").alias("n_tasks"),
        F.count_if(F.col("audios").isNull()).alias("no_audio"), F.sum(F.length("problem")).alias("chars"))


@query("src03_read_jsonl_tolerant", """
, l AS (SELECT dataset, row_id % 13 = 0 AS broken, row_id % 13 <> 0 AND row_id % 29 = 0 AS blank FROM label_pairs_in)
SELECT dataset AS key, count(*) AS n FROM l WHERE NOT broken AND NOT blank GROUP BY 1
UNION ALL SELECT 'nonblank_lines', count_if(NOT blank) FROM l
UNION ALL SELECT 'parsed', count_if(NOT blank AND NOT broken) FROM l
UNION ALL SELECT 'malformed', count_if(broken) FROM l
UNION ALL SELECT '{broken ' || row_id, count(*) FROM label_pairs_in WHERE row_id % 13 = 0 GROUP BY 1""", ("label_pairs_in",))
def src03(spark, sf_dir):
    """Rows by dataset, the counts of the pass that read them, and the rejects."""
    base = scratch_path(spark, "jsonl_in")
    d = X.label_pairs_in(spark, sf_dir)
    good = F.to_json(F.struct("dataset", "task", "answer"))
    line = (F.when(F.col("row_id") % 13 == 0, F.concat(F.lit("{broken "), F.col("row_id").cast("string")))
            .when(F.col("row_id") % 29 == 0, F.lit("   ")).otherwise(good))
    d.select(line.alias("value")).write.mode("overwrite").option("compression", "gzip").text(f"{base}/pairs.jsonl")
    rows, rejects, counts = RD.read_jsonl_with_rejects(
        spark, [f"{base}/pairs.jsonl", f"{base}/missing.jsonl"], X_PAIRS_SCHEMA)
    per = write_once(rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")), "jsonl_rows").select(F.col("dataset").alias("key"), "n")
    report = _counts(spark, counts)
    return per.unionByName(report).unionByName(rejects.groupBy(F.col("_line").alias("key")).agg(F.count(F.lit(1)).alias("n")))


def _counts(spark, *observed):
    """Filled observations as rows ``key, n``."""
    return spark.createDataFrame([(k, int(v)) for o in observed for k, v in o.get.items()], "key string, n bigint")


@query("prj02b_skipped_rows", """
, m AS (SELECT *, contains(lower(coalesce(modality_signature, '')), 'video') AS hit FROM samples)
, i AS (SELECT dataset IN (SELECT source FROM documents WHERE doc_id % 7 = 0) AS listed FROM samples)
SELECT 'kept' AS key, count_if(hit) AS n FROM m UNION ALL SELECT 'dropped', count_if(NOT hit) FROM m
UNION ALL SELECT 'null_signature', count_if(NOT hit AND modality_signature IS NULL) FROM m
UNION ALL SELECT 'rows', count(*) FROM m UNION ALL SELECT 'rejected', count_if(modality_signature IS NULL) FROM m
UNION ALL SELECT 'kept_datasets', count_if(listed) FROM i UNION ALL SELECT 'skipped_datasets', count_if(NOT listed) FROM i""", ("samples",))
def prj02b(spark, sf_dir):
    """What PRJ-02, PRJ-04 and PRJ-09 warn of, counted by the pass that filters."""
    s = X.samples(spark, sf_dir)
    listed = X.table(spark, sf_dir, "documents").filter(F.col("doc_id") % 7 == 0).select(F.col("source").alias("dataset"))
    seen = [Observation(f"skipped-{uuid.uuid4().hex}") for _ in range(3)]
    for d in (P.filter_modality(s, ["videos"], seen[0]), P.require_signature(s, strict=False, counts=seen[1]),
              L.include_datasets(s, listed, seen[2])):
        d.write.format("noop").mode("overwrite").save()
    third = spark.createDataFrame([(f"{k}_datasets", int(v)) for k, v in seen[2].get.items()], "key string, n bigint")
    return _counts(spark, *seen[:2]).unionByName(third)


X_PAIRS_SCHEMA = T.StructType([T.StructField("dataset", T.StringType()), T.StructField("task", T.StringType()),
                               T.StructField("answer", T.StringType())])


@query("src05_media_form", """
, a AS (SELECT unnest(audios) AS x FROM samples)
SELECT 'string' AS written, 'path' AS form, count(*) AS items, CAST(sum(length(x)) AS BIGINT) AS size FROM a
UNION ALL SELECT 'binary', 'binary', count(*), CAST(sum(octet_length(encode(x))) AS BIGINT) FROM a""", ("samples",))
def src05(spark, sf_dir):
    """The media form of tables as they are found on disk, and what they hold."""
    s = X.samples(spark, sf_dir).select("audios")
    binary = s.select(F.transform("audios", lambda x: F.encode(x, "UTF-8")).alias("audios"))
    out = []
    for written, d in (("string", s), ("binary", binary)):
        path = scratch_path(spark, "media_form")
        d.write.parquet(path)
        t = spark.read.parquet(path)
        size = F.length if RD.media_form(t) == "path" else F.octet_length
        items = t.select(F.explode("audios").alias("x")).agg(F.count("x").alias("items"), F.sum(size("x")).alias("size"))
        out.append(items.select(F.lit(written).alias("written"), F.lit(RD.media_form(t)).alias("form"), "items", "size"))
    return reduce(DataFrame.unionByName, out)


@query("src07_read_annotations", """
SELECT 'mimeqa' AS dataset, lower(split_part(text, ' ', 1)) AS answer, text AS question FROM benchmark WHERE item_id % 3 = 0
UNION ALL SELECT 'siq2', lower(split_part(text, ' ', 1)), text FROM benchmark WHERE item_id % 3 = 1
UNION ALL SELECT 'intentqa', lower(coalesce(string_split(text, ' ')[item_id % 7 + 1], '-')), text FROM benchmark WHERE item_id % 3 = 2""")
def src07(spark, sf_dir):
    base = scratch_path(spark, "banks")
    b = X.table(spark, sf_dir, "benchmark")
    first = F.split_part("text", F.lit(" "), F.lit(1))

    def csv(df, path):
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)

    csv(b.filter(F.col("item_id") % 3 == 0).select(F.col("text").alias("question"), first.alias("reference_answer")), f"{base}/mimeqa")
    b.filter(F.col("item_id") % 3 == 1).select(F.col("text").alias("q"), first.alias("ans_corr")) \
        .write.mode("overwrite").json(f"{base}/siq2")
    words = F.split("text", " ")
    csv(b.filter(F.col("item_id") % 3 == 2).select(
        F.col("text").alias("question"), (F.col("item_id") % 7).cast("string").alias("answer"),
        *[F.coalesce(F.get(words, i), F.lit("-")).alias(f"a{i}") for i in range(7)]), f"{base}/intentqa")
    bank = RD.read_annotations(spark, [("mimeqa", f"{base}/mimeqa"), ("intentqa", f"{base}/intentqa")],
                               [("siq2", f"{base}/siq2")])
    return bank.select("dataset", "answer", "question")


@query("src08_read_predictions", """
SELECT dataset, 'x' || truth AS gold, count(*) AS n, CAST(sum(length(response)) AS BIGINT) AS chars FROM responses GROUP BY 1, 2""", ("responses",))
def src08(spark, sf_dir):
    path = scratch_path(spark, "predictions_rows")
    r = X.responses(spark, sf_dir).select("dataset", F.col("response").alias("pred"), F.concat(F.lit("X"), "truth").alias("gold"))
    r.write.mode("overwrite").json(path)
    p = RD.read_predictions(spark, path, layout="rows")
    return p.groupBy("dataset", "gold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("pred")).alias("chars"))


@query("src08b_read_prediction_arrays", r"""
, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS c FROM responses)
SELECT dataset, CASE WHEN regexp_matches(response, '\\boxed\{[^}]+\}') THEN regexp_extract(response, '\\boxed\{([^}]+)\}', 1)
                     ELSE regexp_replace(response, '^\s+|\s+$', '', 'g') END AS pred, 'x' || truth AS gold, count(*) AS n
FROM r WHERE conv_id % 2 = 0 OR k < c GROUP BY 1, 2, 3""", ("responses",))
def src08b(spark, sf_dir):
    """The parallel-array layout, one document per conversation; every other
    one lacks its last gold answer, so its rows end one earlier."""
    path = scratch_path(spark, "prediction_arrays")
    r = X.responses(spark, sf_dir)
    d = r.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "response", "truth", "dataset", "task"))).alias("t"))
    gold = F.transform("t", lambda x: F.concat(F.lit("X"), x["truth"]))
    d.select(F.col("t.response").alias("predictions"),
             F.when(F.col("conv_id") % 2 == 0, gold).otherwise(F.slice(gold, F.lit(1), F.size("t") - 1)).alias("ground_truths"),
             F.col("t.dataset").alias("datasets"), F.col("t.task").alias("tasks")).write.mode("overwrite").json(path)
    p = RD.read_predictions(spark, path, layout="arrays", multiline=False)
    return p.groupBy("dataset", "pred", "gold").agg(F.count(F.lit(1)).alias("n"))


@query("src09_write_predictions", """
SELECT CASE WHEN y_true < 3 THEN 100 ELSE 200 END AS step, dataset, y_true, y_pred, count(*) AS n FROM preds GROUP BY 1, 2, 3, 4""", ("preds",))
def src09(spark, sf_dir):
    path = scratch_path(spark, "predictions_by_step")
    p = X.preds(spark, sf_dir).withColumn("step", F.when(F.col("y_true") < 3, 100).otherwise(200))
    SK.write_predictions(p, path)
    return spark.read.json(path).groupBy("step", "dataset", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


@query("src09b_prediction_documents", r"""
, r AS (SELECT *, CAST(conv_id % 3 AS BIGINT) AS step, CASE WHEN regexp_matches(response, '\\boxed\{[^}]+\}') THEN regexp_extract(response, '\\boxed\{([^}]+)\}', 1)
                     ELSE regexp_replace(response, '^\s+|\s+$', '', 'g') END AS boxed FROM responses)
SELECT 'arrays' AS layout, dataset, boxed AS pred, lower(truth) AS gold, count(*) AS n FROM r GROUP BY ALL
UNION ALL SELECT 'dump', dataset, boxed, lower(truth), count(*) FROM r GROUP BY ALL
UNION ALL SELECT 'records', dataset, response, lower(truth), count(*) FROM r GROUP BY ALL
UNION ALL SELECT 'accuracy', CAST(step AS VARCHAR), CAST(CAST(round(1e6 * avg(CASE WHEN response = truth THEN 1.0 ELSE 0.0 END)) AS BIGINT) AS VARCHAR),
                 array_to_string(list_sort(list(task)), ','), count(*) FROM r GROUP BY step""", ("responses",))
def src09b(spark, sf_dir):
    """The document layouts, written and read back by SRC-08."""
    base = scratch_path(spark, "prediction_documents")
    r = X.responses(spark, sf_dir).select((F.col("conv_id") % 3).cast("bigint").alias("step"), F.concat_ws("-", "conv_id", "turn").alias("row_id"),
                                          "dataset", F.col("response").alias("pred"), F.col("truth").alias("gold"), "task")
    out = []
    for layout in ("arrays", "dump", "records"):
        SK.write_predictions(r, f"{base}/{layout}", layout)
        p = RD.read_predictions(spark, f"{base}/{layout}", "rows" if layout == "records" else "arrays", multiline=False)
        out.append(p.groupBy("dataset", "pred", "gold").agg(F.count(F.lit(1)).alias("n")).withColumn("layout", F.lit(layout)))
    dump = spark.read.json(f"{base}/dump")
    out.append(dump.select(F.lit("accuracy").alias("layout"), F.col("global_step").cast("string").alias("dataset"),
                           F.round(F.col("overall_accuracy") * 1e6).cast("bigint").cast("string").alias("pred"),
                           F.array_join(F.sort_array("tasks"), ",").alias("gold"), F.size("tasks").cast("bigint").alias("n")))
    return reduce(DataFrame.unionByName, out)


@query("src10_write_label_scheme", QL._SQL_CANON + """
SELECT 'label_mapping' AS "table", key AS item, CAST(global_index AS VARCHAR) AS value FROM canon
UNION ALL SELECT 'global_classes', label, CAST(global_index AS VARCHAR) FROM gclass
UNION ALL SELECT 'dataset_labels', dataset, array_to_string(list_sort(list(answer)), '|') FROM lp GROUP BY dataset
UNION ALL SELECT 'dataset_domain', dataset, domain FROM dsdomain""", QL._V)
def src10(spark, sf_dir):
    path = scratch_path(spark, "label_scheme")
    rows = X.label_pairs_in(spark, sf_dir)
    pairs = L.label_pairs(rows, L.qa_datasets(rows))
    mapping = L.resolve_index(L.canonical_label(pairs, spark), spark)
    SK.write_label_scheme(spark, mapping, pairs, path)
    values = {"label_mapping": ("key", F.col("global_index").cast("string")), "global_classes": ("label", F.col("global_index").cast("string")),
              "dataset_labels": ("dataset", F.array_join("labels", "|")), "dataset_domain": ("dataset", F.col("domain"))}
    parts = [spark.read.parquet(f"{path}/{t}").select(F.lit(t).alias("table"), F.col(k).alias("item"), v.alias("value")) for t, (k, v) in values.items()]
    return reduce(DataFrame.unionByName, parts)


@query("src11_write_graded", QT._S_JUDGE.replace("\nSELECT conv_id, turn,\n", "\n, v AS (SELECT conv_id, turn,\n") + """)
SELECT r.dataset, v.correct AS graded_result, v.explanation AS graded_result_explanation, count(*) AS n
FROM v JOIN judge_replies r USING (conv_id, turn) GROUP BY 1, 2, 3""", ("judge_replies",))
def src11(spark, sf_dir):
    path = scratch_path(spark, "graded")
    j = X.judge_replies(spark, sf_dir).select("dataset", TX.parse_judge_reply("reply").alias("v"))
    g = j.select("dataset", F.col("v.correct").alias("graded_result"),
                 F.col("v.explanation").alias("graded_result_explanation"))
    SK.write_graded(g, path)
    return spark.read.json(path).groupBy("dataset", "graded_result", "graded_result_explanation").agg(F.count(F.lit(1)).alias("n"))


@query("src12_export_by_dataset", """
SELECT dataset, CASE WHEN n_chars % 4 = 3 THEN 'validation' ELSE 'train' END AS split, count(*) AS n,
       CAST(sum(length(problem)) AS BIGINT) AS chars FROM samples GROUP BY 1, 2""", ("samples",))
def src12(spark, sf_dir):
    path = scratch_path(spark, "export")
    s = X.samples(spark, sf_dir).withColumn(
        "split", F.when(F.col("n_chars") % 4 == 3, "validation").otherwise("train"))
    SK.export_by_dataset(s.select("sample_id", "problem", "dataset", "split"), path)
    return spark.read.parquet(path).groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("problem")).alias("chars"))


def _wav_bytes(values: np.ndarray, rate: int, channels: int) -> bytes:
    pcm = np.clip(values * 32767.0, -32768, 32767).astype("<i2")
    if channels == 2:
        pcm = np.repeat(pcm, 2)
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(pcm.tobytes())
    return buf.getvalue()


@query("med01_audio_profile", """
, i AS (SELECT [8000, 16000, 44100][label % 3 + 1] AS sample_rate, 1 + label % 2 AS channels, false AS failed FROM embeddings
        UNION ALL SELECT NULL, NULL, true FROM embeddings WHERE vec_id % 10 = 0)
SELECT sample_rate, channels, failed, count(*) AS n,
       CAST(sum(CASE WHEN NOT failed THEN least(CAST(round(3200 * 16000 / sample_rate) AS BIGINT), 160000) END) AS BIGINT) AS clipped_samples,
       round(sum(3200 / sample_rate), 6) AS seconds FROM i GROUP BY 1, 2, 3""", ("embeddings",))
def med01(spark, sf_dir):
    """WAV header profile of audio bytes built from the embedding values."""
    e = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), "embedding", "label")

    def to_wav(batches):
        for pdf in batches:
            items = []
            for emb, lab, sid in zip(pdf["embedding"], pdf["label"], pdf["sample_id"]):
                v = np.asarray(emb, dtype=np.float64)
                rate = [8000, 16000, 44100][int(lab) % 3]
                good = _wav_bytes(np.tile(v, 50), rate, 1 + int(lab) % 2)
                lst = [good, b"not a wav"] if sid % 10 == 0 else [good]
                items.append(lst)
            yield pd.DataFrame({"sample_id": pdf["sample_id"], "audios": items})
    wavs = e.mapInPandas(to_wav, "sample_id bigint, audios array<binary>")
    prof = MD.audio_profile(wavs, "audios")
    return prof.groupBy("sample_rate", "channels", "failed").agg(
        F.count(F.lit(1)).alias("n"), F.sum("clipped_samples").alias("clipped_samples"),
        F.round(F.sum("seconds"), 6).alias("seconds"))


@query("udf01_reward_plugin", """
, x AS (SELECT conv_id, turn, lower(response) AS r, lower(truth) AS g FROM responses)
, y AS (SELECT *, list_distinct(string_split(g, '')) AS gs, string_split(r, '') AS rs FROM x)
SELECT conv_id, turn, round(CASE WHEN contains(r, g) THEN 1.0 ELSE len(list_filter(gs, lambda c: list_contains(rs, c))) / greatest(1, len(gs)) END
       + CASE WHEN length(r) > 400 THEN -0.1 ELSE 0.0 END, 6) AS score FROM y""", ("responses",))
def udf01(spark, sf_dir):
    r = X.responses(spark, sf_dir)
    scored = U.apply_reward_fn(r, U.containment_reward, ["conv_id", "turn"])
    return scored.select("conv_id", "turn", F.round("score", 6).alias("score"))


@query("udf02_embedding_plugin")
def udf02(spark, sf_dir):
    """Similarity of answers and truths; each distinct text is embedded once."""
    lab = F.lower(TX.py_strip(TX.boxed_reward(TX.tighten_tags("response"))))
    r = X.responses(spark, sf_dir).select("conv_id", "turn", lab.alias("pred"), "truth")
    e = U.embed_texts(r, ["pred", "truth"], lambda: U.hashed_ngram_embedder(64))
    return e.select("conv_id", "turn", F.round(R.cosine_scaled("pred_embedding", "truth_embedding"), 6).alias("similarity"))


def _feed(df, path: str, order: list[str], parts: int = 3) -> list:
    """Ways to write the rows of ``df`` in so many files, following each other by
    ``order`` and cut at any row: one call a file."""
    numbered = write_once(global_row_number(df, [], order, "_rn", size="_all"), "stream_input")
    part = F.floor((F.col("_rn") - 1) * parts / F.col("_all"))
    return [lambda c=c: numbered.filter(part == c).drop("_rn", "_all").coalesce(1).write.mode("append").parquet(path) for c in range(parts)]


# the advantages of the z_score mode: responsibilities by the task's averages
_Z_SCORE = QA._BASE.replace("\n, tm AS", """
, z0 AS (SELECT step, task, stddev_pop(adv) AS sg, avg(abs(adv)) AS am, stddev_pop(abs(adv)) AS asg FROM r2 GROUP BY 1, 2)
, z1 AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY step) AS i FROM z0)
, z2 AS (SELECT step, task, {sg}, {am}, {asg} FROM z1
         WINDOW w AS (PARTITION BY task ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
, r3 AS (SELECT r2.*, 1 / (1 + exp(-4.0 * ((abs(adv) - greatest(e_am, 1e-6))
           / (greatest(CASE WHEN e_asg <= 0 THEN e_sg ELSE e_asg END, 1e-6) + 1e-6) - 0.25))) AS r FROM r2 JOIN z2 USING (step, task))
, tm AS""".format(**{c: QA._EMA.format(c=c) for c in ("sg", "am", "asg")}), 1)
_Z_SCORE = _Z_SCORE.replace("sum(abs(adv)) AS mass, count(*) AS sig, count(*) AS cnt FROM r2", "sum(r * abs(adv)) AS mass, sum(r) AS sig, count(*) AS cnt FROM r3")
_Z_SCORE = _Z_SCORE.replace("greatest(sum(abs(adv)) / count(*), 1e-6) AS m FROM r2", "greatest(sum(r * abs(adv)) / count(*), 1e-6) AS m FROM r3")


def _sized(spark, sf_dir):
    """The rollouts with the number of rows of their step."""
    ro = X.rollouts(spark, sf_dir)
    return ro.join(ro.groupBy("step").agg(F.count(F.lit(1)).alias("step_size")), "step")


def _streamed(spark, base, schema, cfg, files=None):
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files or 1_000_000).parquet(f"{base}/src")
    ST.advantage_stream(spark, src, f"{base}/out", f"{base}/state", f"{base}/ckpt", cfg, size="step_size").awaitTermination()


@query("str02_advantage_stream", QA._BASE + """
SELECT step, rollout_id, round(task_scale, 6) AS task_scale, round(question_scale, 6) AS question_scale,
       round(advantage, 6) AS advantage FROM fin""", ("rollouts",))
def str02(spark, sf_dir):
    """Streaming advantage of rollouts that come in three parts cut within steps,
    the stream stopped and resumed after each."""
    base, ro = scratch_path(spark, "adv_stream"), _sized(spark, sf_dir)
    for write in _feed(ro, f"{base}/src", ["step", "rollout_id"]):
        write()
        _streamed(spark, base, ro.schema, A.AdvantageConfig())
    return finish(spark.read.parquet(f"{base}/out").select("step", "rollout_id", "task_scale", "question_scale", "advantage"))


@query("str02b_advantage_stream_z_score", _Z_SCORE + """
SELECT step, rollout_id, round(task_scale, 6) AS task_scale, round(question_scale, 6) AS question_scale,
       round(advantage, 6) AS advantage FROM fin""", ("rollouts",))
def str02b(spark, sf_dir):
    """As str02 in the mode z_score, in one run of three micro-batches."""
    base, ro = scratch_path(spark, "adv_stream_z"), _sized(spark, sf_dir)
    for write in _feed(ro, f"{base}/src", ["step", "rollout_id"]):
        write()
    _streamed(spark, base, ro.schema, A.AdvantageConfig(mode="z_score"), files=1)
    return finish(spark.read.parquet(f"{base}/out").select("step", "rollout_id", "task_scale", "question_scale", "advantage"))


@query("str01b_ema_stream", QA.STR01, ("metric_history",))
def str01b(spark, sf_dir):
    """str01 as a stream with keyed state, stopped and resumed after each of
    three parts; the averages outlive the stops."""
    base, h = scratch_path(spark, "ema_stream"), X.metric_history(spark, sf_dir).select("run", "epoch", "f1")
    emas = [Ema("f1", 0.95, "ema_first"), Ema("f1", 0.95, "ema_zero", 0.0)]
    for write in _feed(h, f"{base}/src", ["epoch", "run"]):
        write()
        src = spark.readStream.schema(h.schema).parquet(f"{base}/src")
        write_ema_stream(src, ["run"], "epoch", emas, f"{base}/out", f"{base}/ckpt").awaitTermination()
    return finish(spark.read.parquet(f"{base}/out").select("run", "epoch", "ema_first", "ema_zero"))


def _in_files(df, path: str, parts: int = 4) -> int:
    """Write ``df`` as ``parts`` files or more, each task its own rows as they come:
    nothing is shuffled, nor sorted in memory as before a round-robin.  Returns how
    many files make a micro-batch, so that there are ``parts`` of these or more."""
    df.write.mode("overwrite").option("maxRecordsPerFile", max(1, -(-df.count() // parts))).parquet(path)
    return max(1, len(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles()) // parts)


@query("str03_metric_stream", """
SELECT dataset, y_true, y_pred, count(*) AS n FROM preds GROUP BY 1, 2, 3""", ("preds",))
def str03(spark, sf_dir):
    """Confusion cells counted over a stream of prediction files."""
    base = scratch_path(spark, "metric_stream")
    p = X.preds(spark, sf_dir)
    files = _in_files(p, f"{base}/src")
    src = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/src")
    ST.metric_stream(src, f"{base}/cells", f"{base}/ckpt").awaitTermination()
    return ST.current_cells(spark, f"{base}/cells")

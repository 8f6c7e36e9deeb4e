"""Filter, projection and prompt queries (PRJ-*, JON-02/03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judge as J
from ..operators import prompts as P
from . import fixtures as X
from .registry import query

_V = ("samples",)
_ALL = ["images", "videos", "audio"]


@query("prj01_filter_task", """
SELECT sample_id, task FROM samples WHERE task IS NOT NULL AND list_last(string_split(task, '_')) = 'cls'""", _V)
def prj01(spark, sf_dir):
    return P.filter_task(X.samples(spark, sf_dir), "cls").select("sample_id", "task")


@query("prj02_filter_modality", """
SELECT sample_id, modality_signature FROM samples
WHERE contains(lower(coalesce(modality_signature, '')), 'video')
   OR contains(lower(coalesce(modality_signature, '')), 'audio')""", _V)
def prj02(spark, sf_dir):
    return P.filter_modality(X.samples(spark, sf_dir), ["videos", "audio"]).select("sample_id", "modality_signature")


@query("prj03_filter_max_length", "SELECT sample_id, n_chars FROM samples WHERE n_chars <= 2000", _V)
def prj03(spark, sf_dir):
    return P.filter_max_length(X.samples(spark, sf_dir), 2000, "n_chars").select("sample_id", "n_chars")


@query("prj04_require_signature", """
SELECT sample_id, CASE WHEN modality_signature IS NULL THEN 'rejected' ELSE 'ok' END AS signature_status
FROM samples""", _V)
def prj04(spark, sf_dir):
    return P.require_signature(X.samples(spark, sf_dir), strict=False).select("sample_id", "signature_status")


@query("prj05_ground_truth", """
SELECT sample_id, coalesce(nullif(answer, ''), ground_truth) AS reward_ground_truth,
       CASE WHEN coalesce(nullif(answer, ''), ground_truth) IS NULL THEN 'missing' ELSE 'ok' END AS gt_status
FROM samples""", _V)
def prj05(spark, sf_dir):
    return P.ground_truth(X.samples(spark, sf_dir)).select("sample_id", "reward_ground_truth", "gt_status")


@query("prj06_null_to_empty", """
SELECT sample_id, CAST(len(coalesce(audios, [])) AS INTEGER) AS n_audios,
       CAST(len(coalesce(ext_audio_feats, [])) AS INTEGER) AS n_ext_audio FROM samples""", _V)
def prj06(spark, sf_dir):
    s = P.null_to_empty(X.samples(spark, sf_dir))
    return s.select("sample_id", F.size("audios").alias("n_audios"), F.size("ext_audio_feats").alias("n_ext_audio"))


@query("prj07_first_feature_path", """
SELECT sample_id, CASE WHEN ext_video_feats[1] IS NOT NULL THEN '/data/base/' || ext_video_feats[1] END AS video_path,
       CASE WHEN ext_audio_feats[1] IS NOT NULL THEN '/data/base/' || ext_audio_feats[1] END AS audio_path
FROM samples""", _V)
def prj07(spark, sf_dir):
    s = X.samples(spark, sf_dir)
    return s.select("sample_id", P.first_feature_path("ext_video_feats", "/data/base").alias("video_path"),
                    P.first_feature_path("ext_audio_feats", "/data/base").alias("audio_path"))


@query("prj07b_first_existing_path", """
, e AS (SELECT sample_id, '/data/base/' || i AS path, p FROM (SELECT sample_id, unnest(images) AS i, unnest(range(len(images))) AS p FROM samples)
        WHERE NOT (i LIKE '%a.png' AND sample_id % 2 = 0))
SELECT s.sample_id, (SELECT arg_min(e.path, e.p) FROM e WHERE e.sample_id = s.sample_id) AS image_path FROM samples s""", _V)
def prj07b(spark, sf_dir):
    s = X.samples(spark, sf_dir)
    listing = s.select("sample_id", F.explode("images").alias("i")).filter(
        ~(F.col("i").endswith("a.png") & (F.col("sample_id") % 2 == 0))).select(F.concat(F.lit("/data/base/"), "i").alias("path"))
    return P.first_existing_path(s.select("sample_id", "images"), "images", "/data/base", listing, "image_path").select("sample_id", "image_path")


@query("prj08_dataset_inventory", """
, s AS (SELECT *, CASE WHEN n_chars % 4 = 3 THEN 'validation' ELSE 'train' END AS split FROM samples)
, g AS (SELECT dataset, count_if(split = 'train') AS n_train, count_if(split = 'validation') AS n_val,
        bool_or(coalesce(len(ext_video_feats) > 0, false)) AS has_video_feats,
        bool_or(coalesce(len(ext_audio_feats) > 0, false)) AS has_audio_feats,
        arg_min(coalesce(task, ''), sample_id) AS t FROM s GROUP BY 1)
SELECT dataset, n_train, n_val, has_video_feats, has_audio_feats,
       CASE WHEN contains(t, '_') THEN list_last(string_split(t, '_')) ELSE 'cls' END AS task_type
FROM g WHERE n_train > 0 AND n_val > 0""", _V)
def prj08(spark, sf_dir):
    s = X.samples(spark, sf_dir).withColumn(
        "split", F.when(F.col("n_chars") % 4 == 3, "validation").otherwise("train"))
    return P.dataset_inventory(s)


@query("prj11_route_row", """
, u AS (SELECT sample_id AS id, dataset, task, answer FROM samples
        UNION ALL SELECT row_id + 1000000000, dataset, task, answer FROM label_pairs_in)
SELECT id, CASE WHEN ends_with(lower(coalesce(task, '')), '_qa') OR lower(dataset) IN ('intentqa', 'mimeqa', 'siq2')
                THEN 'qa' ELSE 'cls' END AS route,
       CASE WHEN ends_with(lower(coalesce(task, '')), '_qa') OR lower(dataset) IN ('intentqa', 'mimeqa', 'siq2')
                THEN lower(coalesce(answer, '')) ELSE '' END AS lm_label
FROM u""", ("samples", "label_pairs_in"))
def prj11(spark, sf_dir):
    a = X.samples(spark, sf_dir).select(F.col("sample_id").alias("id"), "dataset", "task", "answer")
    b = X.label_pairs_in(spark, sf_dir).select((F.col("row_id") + 1000000000).alias("id"), "dataset", "task",
                                                "answer")
    return P.route_row(a.unionByName(b)).select("id", "route", "lm_label")


@query("prj12_strip_inactive_tags", """
SELECT sample_id, replace(replace(problem, '<video>', ''), '<audio>', '') AS prompt FROM samples""", _V)
def prj12(spark, sf_dir):
    s = X.samples(spark, sf_dir)
    return s.select("sample_id", P.strip_inactive_tags(F.col("problem"), ["images"]).alias("prompt"))


_S_COUNT = "CAST((length({t}) - length(replace({t}, '{tag}', ''))) / {n} AS INTEGER)"


def _cnt(t, tag):
    return _S_COUNT.format(t=t, tag=tag, n=len(tag))


@query("prj13_prepend_missing_tags", f"""
, a AS (SELECT sample_id, problem AS p0, len(images) AS ni, len(videos) AS nv, coalesce(len(audios), 0) AS na
        FROM samples)
, b AS (SELECT *, repeat('<image>', greatest(ni - {_cnt('p0', '<image>')}, 0)) || p0 AS p1 FROM a)
, c AS (SELECT *, repeat('<video>', greatest(nv - {_cnt('p1', '<video>')}, 0)) || p1 AS p2 FROM b)
, d AS (SELECT *, repeat('<audio>', greatest(na - {_cnt('p2', '<audio>')}, 0)) || p2 AS p3 FROM c)
SELECT sample_id, p3 AS prompt FROM d""", _V)
def prj13(spark, sf_dir):
    s = X.samples(spark, sf_dir)
    return s.select("sample_id", P.prepend_missing_tags(F.col("problem"), F.size("images"), F.size("videos"),
                                                        F.size("audios")).alias("prompt"))


@query("prj14_segment_prompt", """
, m AS (SELECT sample_id, list_filter(string_split(replace(replace(replace(problem, '<image>', chr(1) || '<image>' || chr(1)),
            '<video>', chr(1) || '<video>' || chr(1)), '<audio>', chr(1) || '<audio>' || chr(1)), chr(1)),
            lambda s: s <> '') AS parts FROM samples)
SELECT sample_id, CAST(len(parts) AS INTEGER) AS n_seg,
       array_to_string(list_transform(parts, lambda s: CASE s WHEN '<image>' THEN 'image' WHEN '<video>' THEN 'video'
                       WHEN '<audio>' THEN 'audio' ELSE 'text' END), ',') AS types,
       list_sum(list_transform(parts, lambda s: CASE WHEN s IN ('<image>', '<video>', '<audio>') THEN 0
                                                     ELSE length(s) END)) AS text_chars
FROM m""", _V)
def prj14(spark, sf_dir):
    s = X.samples(spark, sf_dir).select("sample_id", P.segment_prompt(F.col("problem"), _ALL).alias("seg"))
    return s.select("sample_id", F.size("seg").alias("n_seg"),
                    F.array_join(F.transform("seg", lambda x: x["type"]), ",").alias("types"),
                    F.aggregate("seg", F.lit(0).cast("bigint"),
                                lambda a, x: a + F.coalesce(F.length(x["text"]), F.lit(0))).alias("text_chars"))


@query("prj15_render_prompt", "SELECT sample_id, problem || '" + P.FORMAT_PROMPT.split("{{ content }}")[1]
       + "' AS prompt FROM samples", _V)
def prj15(spark, sf_dir):
    s = X.samples(spark, sf_dir)
    return s.select("sample_id", P.render_prompt(F.col("problem")).alias("prompt"))


@query("prj16_build_chat", """
, h AS (SELECT sample_id, problem, len(videos) > 0 AS hv, coalesce(len(audios), 0) > 0 AS ha FROM samples)
, t AS (SELECT *, replace(problem, '<image>', '') AS txt FROM h)
SELECT sample_id, CAST(2 AS INTEGER) AS n_msgs, 'system' AS first_role,
  CAST(CASE WHEN hv OR ha THEN len(list_filter(string_split(replace(replace(txt, '<video>', chr(1) || '<video>' || chr(1)),
       '<audio>', chr(1) || '<audio>' || chr(1)), chr(1)), lambda s: s <> '')) ELSE 1 END AS INTEGER) AS n_user_parts
FROM t""", _V)
def prj16(spark, sf_dir):
    s = P.build_chat(X.samples(spark, sf_dir), ["videos", "audio"], form="path")
    return s.select("sample_id", F.size("messages").alias("n_msgs"),
                    F.element_at("messages", 1)["role"].alias("first_role"),
                    F.size(F.element_at("messages", -1)["content"]).alias("n_user_parts"))


@query("prj16b_build_chat_binary", """
SELECT sample_id, CAST(CASE WHEN coalesce(len(audios), 0) > 0 THEN 2 ELSE 1 END AS INTEGER) AS n_msgs
FROM samples""", _V)
def prj16b(spark, sf_dir):
    s = P.build_chat(X.samples(spark, sf_dir), _ALL, form="binary")
    return s.select("sample_id", F.size("messages").alias("n_msgs"))


@query("prj18_decode_text", "SELECT doc_id, text AS decoded FROM documents")
def prj18(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    return d.select("doc_id", P.decode_text(F.col("b")).alias("decoded"))


# --- judge flow: predictions, question banks, attach, summary, prompt ------

_JUDGE_SQL = """
, bank0 AS (SELECT (['mimeqa', 'siq2', 'intentqa'])[item_id % 3 + 1] AS dataset,
                   lower(split_part(text, ' ', 1)) AS answer, text AS question, item_id AS ordinal FROM benchmark)
, bank AS (SELECT dataset, answer, arg_max(question, ordinal) AS question FROM bank0 GROUP BY 1, 2)
, preds AS (SELECT conv_id, turn, (['mimeqa', 'siq2', 'intentqa', 'other'])[conv_id % 4 + 1] AS dataset,
                   text AS pred, lower(split_part(text, ' ', 1)) AS gold
            FROM conversations)
, known AS (SELECT DISTINCT dataset FROM bank)
"""


@query("jon02_attach_questions", _JUDGE_SQL + """
SELECT p.conv_id, p.turn, p.dataset, p.gold, b.question FROM preds p JOIN bank b
ON b.dataset = p.dataset AND b.answer = p.gold""", ("benchmark", "conversations"))
def jon02(spark, sf_dir):
    preds, bank = X.judge_inputs(spark, sf_dir)
    return J.attach_questions(preds, bank).select("conv_id", "turn", "dataset", "gold", "question")


@query("jon03_unmatched_summary", _JUDGE_SQL + """
, lab AS (SELECT p.dataset, CASE WHEN p.dataset NOT IN (SELECT dataset FROM known) THEN 'no_dataset'
                      WHEN b.question IS NULL THEN 'no_question' ELSE 'matched' END AS outcome
          FROM preds p LEFT JOIN bank b ON b.dataset = p.dataset AND b.answer = p.gold)
SELECT dataset, outcome, count(*) AS n FROM lab GROUP BY 1, 2""", ("benchmark", "conversations"))
def jon03(spark, sf_dir):
    preds, bank = X.judge_inputs(spark, sf_dir)
    return J.unmatched_summary(preds, bank)


@query("prj17_render_judge_prompt", _JUDGE_SQL + """
SELECT p.conv_id, p.turn, 'Grade ' || p.dataset || ' answers.' AS instruction,
       printf(E'""" + P.JUDGE_TEMPLATE.replace("'", "''").replace("\n", "\\n") + """', b.question, p.pred, p.gold)
         AS judge_prompt
FROM preds p JOIN bank b ON b.dataset = p.dataset AND b.answer = p.gold""", ("benchmark", "conversations"))
def prj17(spark, sf_dir):
    preds, bank = X.judge_inputs(spark, sf_dir)
    att = J.attach_questions(preds, bank)
    instr = bank.select("dataset").distinct().select(
        "dataset", F.concat(F.lit("Grade "), F.col("dataset"), F.lit(" answers.")).alias("instruction"))
    return P.render_judge_prompt(att, instr).select("conv_id", "turn", "instruction", "judge_prompt")

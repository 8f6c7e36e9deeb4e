"""Text scalar and reward queries (TXT-*, PRJ-10, RWD-*, MET-11/12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rewards as R
from ..functions import text as TX
from ..operators import metrics as M
from . import fixtures as X
from .registry import finish, query

# DuckDB spellings of the same scalar rules (independent second implementation).
S_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
S_TIGHT = r"regexp_replace({x}, '\s*(<|>|/)\s*', '\1', 'g')"
S_BOX = r"""CASE WHEN regexp_matches({x}, '\\boxed\{{([^}}]*)\}}') THEN regexp_extract({x}, '\\boxed\{{([^}}]*)\}}', 1)
     WHEN regexp_matches({x}, '\[(.*?)\]') THEN regexp_extract({x}, '\[(.*?)\]', 1)
     WHEN regexp_matches({x}, '<answer>(.*?)</answer>') THEN regexp_extract({x}, '<answer>(.*?)</answer>', 1)
     ELSE {x} END"""
S_FMT = r"CASE WHEN regexp_full_match({x}, '(?s)<think>.*</think>.*\\boxed\{{.*\}}.*') THEN 1.0 ELSE 0.0 END"
S_TASK = r"""CASE WHEN {x} IS NULL OR regexp_replace({x}, '^\s+|\s+$', '', 'g') = '' THEN 'cls'
     WHEN list_last(regexp_split_to_array(lower(regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '^_+|_+$', '', 'g')), '[_\W]+'))
          IN ('qa', 'qna') THEN 'qa' ELSE 'cls' END"""


def s(tpl: str, x: str) -> str:
    return tpl.format(x=x)


@query("txt01_tighten_tags", f"SELECT conv_id, turn, {s(S_TIGHT, 'response')} AS tightened FROM responses",
       ("responses",))
def txt01(spark, sf_dir):
    r = X.responses(spark, sf_dir)
    return r.select("conv_id", "turn", TX.tighten_tags("response").alias("tightened"))


@query("txt02_boxed_reward", f"""
SELECT conv_id, turn, {s(S_BOX, 'x')} AS label,
       CASE WHEN regexp_matches(x, '\\\\boxed\\{{\\}}') AND NOT regexp_matches(x, '\\\\boxed\\{{[^}}]+\\}}')
            THEN 1 ELSE 0 END AS empty_box
FROM (SELECT conv_id, turn, {s(S_TIGHT, 'response')} AS x FROM responses)""", ("responses",))
def txt02(spark, sf_dir):
    r = X.responses(spark, sf_dir).select("conv_id", "turn", TX.tighten_tags("response").alias("x"))
    empty = (F.col("x").rlike(r"\\boxed\{\}") & ~F.col("x").rlike(r"\\boxed\{[^}]+\}")).cast("int")
    return r.select("conv_id", "turn", TX.boxed_reward("x").alias("label"), empty.alias("empty_box"))


@query("txt03_boxed_judge", r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(response, '\\boxed\{([^}]+)\}')
       THEN regexp_extract(response, '\\boxed\{([^}]+)\}', 1)
       ELSE regexp_replace(response, '^\s+|\s+$', '', 'g') END AS pred FROM responses""", ("responses",))
def txt03(spark, sf_dir):
    r = X.responses(spark, sf_dir)
    return r.select("conv_id", "turn", TX.boxed_judge("response").alias("pred"))


_S_PHRASE = r"""
CASE WHEN regexp_matches(response, '\\boxed\{([^}]+)\}')
          THEN regexp_replace(regexp_extract(response, '\\boxed\{([^}]+)\}', 1), '^\s+|\s+$', '', 'g')
     WHEN regexp_matches(response, '<answer>([^<]+)</answer>')
          THEN regexp_replace(regexp_extract(response, '<answer>([^<]+)</answer>', 1), '^\s+|\s+$', '', 'g')
     WHEN regexp_matches(regexp_replace(response, '^\s+|\s+$', '', 'g'), '^([^.\n,!?]+)')
          THEN regexp_replace(regexp_extract(regexp_replace(response, '^\s+|\s+$', '', 'g'), '^([^.\n,!?]+)', 1),
                              '^\s+|\s+$', '', 'g')
     ELSE regexp_replace(response, '^\s+|\s+$', '', 'g') END"""


@query("txt04_answer_phrase", f"SELECT conv_id, turn, {_S_PHRASE} AS phrase FROM responses", ("responses",))
def txt04(spark, sf_dir):
    r = X.responses(spark, sf_dir)
    return r.select("conv_id", "turn", TX.answer_phrase("response").alias("phrase"))


@query("txt05_format_ok", f"""
SELECT conv_id, turn, {s(S_FMT, 'x')} AS format_score
FROM (SELECT conv_id, turn, {s(S_TIGHT, 'response')} AS x FROM responses)""", ("responses",))
def txt05(spark, sf_dir):
    r = X.responses(spark, sf_dir)
    return r.select("conv_id", "turn", TX.format_ok(TX.tighten_tags("response")).alias("format_score"))


@query("txt06_boolean_word", r"""
SELECT row_id, answer, CASE WHEN lower(regexp_replace(answer, '^\s+|\s+$', '', 'g')) IN ('true','yes','1','y','t') THEN true
  WHEN lower(regexp_replace(answer, '^\s+|\s+$', '', 'g')) IN ('false','no','0','n','f') THEN false END AS b
FROM label_pairs_in""", ("label_pairs_in",))
def txt06(spark, sf_dir):
    d = X.label_pairs_in(spark, sf_dir)
    return d.select("row_id", "answer", TX.boolean_word("answer").alias("b"))


_S_JUDGE = r"""
, st AS (SELECT conv_id, turn, regexp_replace(reply, '^\s+|\s+$', '', 'g') AS s FROM judge_replies)
, j0 AS (SELECT *, CASE WHEN starts_with(s, '```json') THEN substr(s, 8) ELSE s END AS j1 FROM st)
, j1 AS (SELECT *, regexp_replace(CASE WHEN ends_with(j1, '```') THEN left(j1, length(j1) - 3) ELSE j1 END,
                                  '^\s+|\s+$', '', 'g') AS j FROM j0)
, j2 AS (SELECT *, CASE WHEN json_valid(j) THEN json_type(CASE WHEN json_valid(j) THEN j END) = 'OBJECT'
                        ELSE false END AS is_obj FROM j1)
, j3 AS (SELECT *, CASE WHEN is_obj THEN list_contains(json_keys(CASE WHEN is_obj THEN j END), 'correct')
                    AND list_contains(json_keys(CASE WHEN is_obj THEN j END), 'explanation') ELSE false END
               AS has_both FROM j2)
SELECT conv_id, turn,
  CASE WHEN has_both THEN CAST(json_extract(CASE WHEN has_both THEN j END, '$.correct') AS BOOLEAN)
       WHEN NOT is_obj THEN contains(lower(s), 'true') END AS correct,
  CASE WHEN has_both THEN json_extract_string(CASE WHEN has_both THEN j END, '$.explanation')
       WHEN NOT is_obj THEN 'Error parsing JSON, content: ' || s END AS explanation,
  CASE WHEN NOT is_obj THEN 'parse_error' WHEN NOT has_both THEN 'missing_field' ELSE 'ok' END AS status
FROM j3"""


@query("txt07_parse_judge_reply", _S_JUDGE, ("judge_replies",))
def txt07(spark, sf_dir):
    j = X.judge_replies(spark, sf_dir)
    return j.select("conv_id", "turn", F.inline(F.array(TX.parse_judge_reply("reply"))))


@query("prj10_task_type", f"""
SELECT task, {s(S_TASK, 'task')} AS task_type, count(*) AS n
FROM (SELECT task FROM responses UNION ALL SELECT task FROM label_pairs_in UNION ALL SELECT task FROM samples)
GROUP BY 1, 2""", ("responses", "label_pairs_in", "samples"))
def prj10(spark, sf_dir):
    t = (X.responses(spark, sf_dir).select("task")
         .unionByName(X.label_pairs_in(spark, sf_dir).select("task"))
         .unionByName(X.samples(spark, sf_dir).select("task")))
    return t.groupBy("task", TX.task_type("task").alias("task_type")).agg(F.count(F.lit(1)).alias("n"))


@query("rwd01_exact_match", f"""
SELECT conv_id, turn,
  CASE WHEN lower(label) = lower(truth) THEN 1.0 ELSE 0.0 END AS exact_v1,
  CASE WHEN lower({s(S_STRIP, 'label')}) = lower({s(S_STRIP, 'truth')}) THEN 1.0 ELSE 0.0 END AS exact_v2
FROM (SELECT conv_id, turn, truth, {s(S_BOX, s(S_TIGHT, 'response'))} AS label FROM responses)""",
       ("responses",))
def rwd01(spark, sf_dir):
    r = X.responses(spark, sf_dir)
    lab = TX.boxed_reward(TX.tighten_tags("response"))
    return r.select("conv_id", "turn", TX.exact_match(lab, "truth").alias("exact_v1"),
                    TX.exact_match(lab, "truth", strip=True).alias("exact_v2"))


_S_COS = ("list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / "
          "(greatest(sqrt(list_inner_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))), 1e-12) * "
          "greatest(sqrt(list_inner_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))), 1e-12))")


def cos_sql(a, b):
    return _S_COS.format(a=a, b=b)


@query("rwd02_cosine_clipped",
       f"SELECT vec_id, round(greatest(0.0, least(1.0, {cos_sql('emb_a', 'emb_b')})), 6) AS sim FROM pairs",
       ("pairs",))
def rwd02(spark, sf_dir):
    p = X.pairs(spark, sf_dir)
    return finish(p.select("vec_id", R.cosine_clipped("emb_a", "emb_b").alias("sim")))


@query("rwd03_cosine_scaled",
       f"SELECT vec_id, round(({cos_sql('emb_a', 'emb_b')} + 1) / 2, 6) AS sim FROM pairs", ("pairs",))
def rwd03(spark, sf_dir):
    p = X.pairs(spark, sf_dir)
    return finish(p.select("vec_id", R.cosine_scaled("emb_a", "emb_b").alias("sim")))


@query("rwd04_overlong_penalty", """
SELECT conv_id, turn, length(response) AS len,
  round(CASE WHEN length(response) <= 684 THEN 0.0 WHEN length(response) <= 812 THEN (684 - length(response)) / 128.0
       ELSE -1.0 END, 6) AS overlong
FROM responses""", ("responses",))
def rwd04(spark, sf_dir):
    r = X.responses(spark, sf_dir)
    ln = F.length("response")
    return finish(r.select("conv_id", "turn", ln.cast("bigint").alias("len"),
                           R.overlong_penalty(ln, 812, 128).alias("overlong")))


def _resp_with_emb(spark, sf_dir):
    r = X.responses(spark, sf_dir)
    e = X.table(spark, sf_dir, "embeddings")
    ep = e.select(F.col("vec_id").alias("pid"), F.col("embedding").alias("emb_pred"))
    et = e.select(F.col("vec_id").alias("tid"), F.col("embedding").alias("emb_truth"))
    r = r.withColumn("pid", F.col("conv_id") * 2).withColumn("tid", F.col("conv_id") * 2 + 1)
    return r.join(ep, "pid").join(et, "tid")


_RESP_EMB_SQL = """
, re AS (SELECT r.*, ep.embedding AS emb_pred, et.embedding AS emb_truth FROM responses r
         JOIN embeddings ep ON ep.vec_id = r.conv_id * 2 JOIN embeddings et ON et.vec_id = r.conv_id * 2 + 1)
"""


@query("rwd05_reward_v1", _RESP_EMB_SQL + f"""
, b AS (SELECT conv_id, turn, lower({s(S_BOX, 'x')}) AS label, lower(truth) AS gold, {s(S_FMT, 'x')} AS fmt,
        greatest(0.0, least(1.0, {cos_sql('emb_pred', 'emb_truth')})) AS sim
        FROM (SELECT *, {s(S_TIGHT, 'response')} AS x FROM re))
SELECT conv_id, turn, round((CASE WHEN label = gold THEN 1.0 ELSE 0.0 END) + 0.2 * fmt + 0.5 * sim, 6) AS score,
       CASE WHEN label = gold THEN 1.0 ELSE 0.0 END AS standard_score, fmt AS format_score,
       round(sim, 6) AS similarity_score
FROM b""", ("responses",))
def rwd05(spark, sf_dir):
    r = _resp_with_emb(spark, sf_dir)
    return finish(r.select("conv_id", "turn", F.inline(F.array(
        R.reward_v1("response", "truth", "emb_pred", "emb_truth")))))


@query("rwd06_reward_v2", _RESP_EMB_SQL + f"""
, b AS (SELECT conv_id, turn, response, {s(S_TASK, 'task')} AS tt,
        lower({s(S_STRIP, s(S_BOX, 'x'))}) AS label, lower({s(S_STRIP, "coalesce(truth, '')")}) AS gold,
        {s(S_FMT, 'x')} AS fmt, ({cos_sql('emb_pred', 'emb_truth')} + 1) / 2 AS sim,
        CASE WHEN length(coalesce(response, '')) <= 684 THEN 0.0
             WHEN length(coalesce(response, '')) <= 812 THEN (684 - length(coalesce(response, ''))) / 128.0
             ELSE -1.0 END AS over
        FROM (SELECT *, {s(S_TIGHT, "coalesce(response, '')")} AS x FROM re))
SELECT conv_id, turn,
  round(CASE WHEN tt = 'cls' THEN 0.8 * (CASE WHEN label = gold THEN 1.0 ELSE 0.0 END) + 0.2 * fmt
        ELSE 0.8 * sim + 0.2 * fmt END + 0.75 * over, 6) AS score,
  CASE WHEN tt = 'cls' AND label = gold THEN 1.0 ELSE 0.0 END AS standard_score,
  fmt AS format_score, round(CASE WHEN tt = 'cls' THEN 0.0 ELSE sim END, 6) AS similarity_score,
  round(over, 6) AS overlong_score, tt AS task_type
FROM b""", ("responses",))
def rwd06(spark, sf_dir):
    r = _resp_with_emb(spark, sf_dir)
    return finish(r.select("conv_id", "turn", F.inline(F.array(
        R.reward_v2("response", "truth", F.col("task"), "emb_pred", "emb_truth")))))


@query("met11_generation_accuracy", f"""
, g AS (SELECT dataset, coalesce(task, '') AS task,
        CASE WHEN lower({_S_PHRASE.strip()}) = truth THEN 1 ELSE 0 END AS hit FROM responses)
, ds AS (SELECT 'dataset' AS scope, dataset AS key, CAST(sum(hit) AS BIGINT) AS correct, count(*) AS total
         FROM g GROUP BY dataset)
, tk AS (SELECT 'task' AS scope, task AS key, CAST(sum(hit) AS BIGINT) AS correct, count(*) AS total
         FROM g GROUP BY task)
, ov AS (SELECT 'overall' AS scope, '' AS key, CAST(sum(hit) AS BIGINT) AS correct, count(*) AS total FROM g)
, al AS (SELECT * FROM ds UNION ALL SELECT * FROM tk UNION ALL SELECT * FROM ov)
SELECT scope, key, correct, total, round(CASE WHEN total > 0 THEN correct / total ELSE 0.0 END, 6) AS accuracy FROM al
UNION ALL
SELECT 'dataset_mean', '', CAST(sum(correct) AS BIGINT), CAST(sum(total) AS BIGINT), round(avg(correct / total), 6)
FROM ds""", ("responses",))
def met11(spark, sf_dir):
    r = X.responses(spark, sf_dir)
    g = r.select("dataset", "task", F.lower(TX.answer_phrase("response")).alias("pred"),
                 F.col("truth").alias("gold"))
    return finish(M.generation_accuracy(g))


@query("met12_judge_accuracy", _S_JUDGE.split("SELECT conv_id, turn,\n  CASE WHEN has_both")[0] + """
, graded AS (SELECT jr.dataset, CASE WHEN has_both THEN CAST(json_extract(CASE WHEN has_both THEN j END, '$.correct') AS BOOLEAN)
                    ELSE contains(lower(s), 'true') END AS correct
             FROM j3 JOIN judge_replies jr ON jr.conv_id = j3.conv_id AND jr.turn = j3.turn
             WHERE has_both OR NOT is_obj)
SELECT dataset, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS correct, count(*) AS total,
       round(avg(CAST(correct AS INT)), 6) AS accuracy FROM graded GROUP BY dataset
UNION ALL
SELECT '__all__', CAST(sum(CAST(correct AS INT)) AS BIGINT), count(*), round(avg(CAST(correct AS INT)), 6) FROM graded
""", ("judge_replies",))
def met12(spark, sf_dir):
    j = X.judge_replies(spark, sf_dir)
    p = j.select("dataset", TX.parse_judge_reply("reply").alias("v"))
    graded = p.filter(F.col("v.status") != "missing_field").select("dataset", F.col("v.correct").alias("correct"))
    return finish(M.judge_accuracy(graded))

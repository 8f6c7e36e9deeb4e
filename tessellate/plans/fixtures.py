"""Input views derived from the driver's test tables.

Each view only reshapes rows of a given table into the schema an operator
expects; none of them does an operator's work.  The same definitions exist as
SQL in :mod:`tessellate.plans.oracle_views` so the DuckDB oracle reads the
same rows.  Integer arithmetic only in keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES for the fixtures: dataset names of the label scheme and a list
# of raw label spellings (mixed case, synonyms, boolean words, blanks).
FIX_DATASETS = ["chsimsv2", "mosei_senti", "meld_senti", "cremad", "meld_emotion",
                "mosei_emotion", "tess", "ptsd_in_the_wild", "mmpsy_depression",
                "mmpsy_anxiety", "daicwoz", "mmsd", "urfunny", "intentqa", "mimeqa", "siq2"]
FIX_SPELLINGS = ["Positive", "strongly negative", " Neutral ", "weakly positive", "Happy",
                 "joy", "Angry", "pleasant surprise", "no  ptsd", "PTSD", "Yes", "no",
                 "Depression", "no depression", "anxiety", "No Anxiety", "true", "F",
                 "sarcasm", "humour", "maybe", "highly positive"]


_TABLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named test table; the resolved DataFrame is reused per session so
    the file listing and footer read happen once per table."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


def _pick(values: list[str], idx: Column) -> Column:
    """values[idx] for a 0-based integer column (literal array lookup)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def preds(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    y_true = (F.col("l_partkey") + F.col("l_linenumber")) % 7
    alt = (F.col("l_suppkey") + F.col("l_linenumber")) % 9
    return li.select(
        F.when(F.col("l_returnflag") == "A", "chsimsv2")
         .when(F.col("l_returnflag") == "N", "mosei_senti")
         .otherwise("meld").alias("dataset"),
        y_true.cast("bigint").alias("y_true"),
        F.when(F.col("l_suppkey") % 3 > 0, y_true).otherwise(alt).cast("bigint").alias("y_pred"),
    )


def emo_preds(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    y_true = (F.col("l_partkey") + F.col("l_linenumber")) % 7 + 7
    alt = (F.col("l_suppkey") + F.col("l_linenumber")) % 9 + 7
    return li.select(
        F.when(F.col("l_returnflag") == "A", "cremad")
         .when(F.col("l_returnflag") == "N", "meld_emotion")
         .otherwise("tess").alias("dataset"),
        y_true.cast("bigint").alias("y_true"),
        F.when(F.col("l_suppkey") % 3 > 0, y_true).otherwise(alt).cast("bigint").alias("y_pred"),
    )


def binary_preds(spark, sf_dir) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "source")
    return lab.join(doc, "doc_id").select(
        F.col("source").alias("dataset"),
        F.col("quality").cast("bigint").alias("y_true"),
        F.col("toxic").cast("bigint").alias("y_pred"),
    )


def samples(spark, sf_dir) -> DataFrame:
    """Documents as sample rows of the path-form schema."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    sid = k.cast("string")
    media = lambda kind, ext: (F.when(k % 3 == 0, F.array().cast("array<string>"))
                               .when(k % 3 == 1, F.array(F.concat(F.lit(kind + "/"), sid, F.lit(ext))))
                               .otherwise(F.array(F.concat(F.lit(kind + "/"), sid, F.lit("a" + ext)),
                                                  F.concat(F.lit(kind + "/"), sid, F.lit("b" + ext)))))
    sig = (F.when(k % 10 == 0, "text_video").when(k % 10 == 1, "text_image")
           .when(k % 10 == 2, "text_video_audio").when(k % 10 == 3, F.lit(None).cast("string"))
           .when(k % 10 == 4, "").otherwise("text_Audio"))
    problem = (F.when(k % 4 == 0, F.concat(F.lit("<audio>"), F.col("text")))
               .when(k % 4 == 1, F.col("text"))
               .when(k % 4 == 2, F.concat(F.lit("<video>"), F.col("text"), F.lit(" <image>")))
               .otherwise(F.concat(F.col("text"), F.lit("<audio><audio>"))))
    return d.select(
        k.alias("sample_id"),
        problem.alias("problem"),
        F.when(k % 7 == 0, F.lit("")).otherwise(F.col("lang")).alias("answer"),
        F.col("lang").alias("ground_truth"),
        media("img", ".png").alias("images"),
        media("vid", ".mp4").alias("videos"),
        F.when(k % 2 == 0, media("aud", ".wav")).alias("audios"),
        F.col("source").alias("dataset"),
        F.when(k % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.col("lang"), F.when(k % 5 == 0, F.lit("_qa")).otherwise(F.lit("_cls"))))
         .alias("task"),
        F.col("lang").alias("class_label"),
        F.array(F.col("lang")).alias("texts"),
        sig.alias("modality_signature"),
        F.when(k % 4 == 1, F.array().cast("array<string>"))
         .otherwise(F.array(F.concat(F.lit("vf/"), sid, F.lit(".pt")))).alias("ext_video_feats"),
        F.when(k % 6 == 0, F.lit(None).cast("array<string>"))
         .otherwise(F.array(F.concat(F.lit("af/"), sid, F.lit(".pt")))).alias("ext_audio_feats"),
        F.col("n_chars"),
    )


def label_pairs_in(spark, sf_dir) -> DataFrame:
    """Raw (dataset, task, answer) rows for label unification."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    k = F.col("doc_id")
    ds = _pick(FIX_DATASETS, k % len(FIX_DATASETS))
    ans = _pick(FIX_SPELLINGS, (k / len(FIX_DATASETS)).cast("bigint") % len(FIX_SPELLINGS))
    return d.select(
        k.alias("row_id"),
        ds.alias("dataset"),
        F.when(k % len(FIX_DATASETS) >= 13, F.concat(ds, F.lit("_qa")))
         .otherwise(F.concat(ds, F.lit("_cls"))).alias("task"),
        F.when(k % 17 == 0, F.lit(None).cast("string")).otherwise(ans).alias("answer"),
    )


def responses(spark, sf_dir) -> DataFrame:
    """All turns wrapped in the answer formats the scorers look for."""
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id")
    truth = F.lower(F.split_part(F.col("text"), F.lit(" "), F.lit(1)))
    t = F.col("text")
    resp = (F.when(k % 6 == 0, F.concat(F.lit("<think>"), t, F.lit("</think> \\boxed{"), truth, F.lit("}")))
            .when(k % 6 == 1, F.concat(F.lit("Answer: ["), truth, F.lit("] "), t))
            .when(k % 6 == 2, F.concat(t, F.lit(" <answer>"), truth, F.lit("</answer>")))
            .when(k % 6 == 3, F.concat(F.lit("<think>x</think>\\boxed{}"), t))
            .when(k % 6 == 4, F.concat(F.lit("< think >"), t, F.lit("< /think >\\boxed{ "), truth, F.lit(" }")))
            .otherwise(t))
    task = (F.when(F.col("turn") % 5 == 0, "chat_cls").when(F.col("turn") % 5 == 1, "chat_qa")
            .when(F.col("turn") % 5 == 2, "chat_q&a").when(F.col("turn") % 5 == 3, "Chat_QnA_")
            .otherwise(F.lit(None).cast("string")))
    return c.select(
        k.alias("conv_id"), F.col("turn"),
        F.concat(F.lit("d"), (k % 4).cast("string")).alias("dataset"),
        task.alias("task"),
        resp.alias("response"),
        truth.alias("truth"),
    )


def judge_replies(spark, sf_dir) -> DataFrame:
    """Stored judge replies in five shapes, one per conversation turn."""
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") + F.col("turn")
    expl = F.concat(F.lit("turn "), F.col("turn").cast("string"))
    flag = F.when(F.col("conv_id") % 2 == 0, "true").otherwise("false")
    body = F.concat(F.lit('{"correct": '), flag, F.lit(', "explanation": "'), expl, F.lit('"}'))
    reply = (F.when(k % 5 == 0, body)
             .when(k % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
             .when(k % 5 == 2, F.concat(F.lit("Verdict: TRUE, "), expl))
             .when(k % 5 == 3, F.concat(F.lit("no. "), expl))
             .otherwise(F.concat(F.lit('{"explanation": "'), expl, F.lit('"}'))))
    return c.select(
        F.col("conv_id"), F.col("turn"),
        F.concat(F.lit("d"), (F.col("conv_id") % 4).cast("string")).alias("dataset"),
        reply.alias("reply"),
    )


def pairs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id"), F.col("embedding").alias("emb_a"), F.col("label"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("emb_b"))
    return a.join(b, "vec_id")


def rollouts(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    step = (F.datediff(F.to_date("ts"), F.to_date(F.lit("1970-01-01")))).cast("bigint")
    half = F.col("value") / 2
    mask = (F.when(F.col("event_id") % 3 == 0, F.array(F.lit(1), F.lit(1), F.lit(0)))
            .when(F.col("event_id") % 3 == 1, F.array(F.lit(1), F.lit(0), F.lit(0)))
            .otherwise(F.array(F.lit(1), F.lit(1), F.lit(1))))
    return ev.select(
        step.alias("step"),
        F.col("event_id").alias("rollout_id"),
        F.concat_ws("-", step.cast("string"), F.col("event_type"),
                    (F.col("user_id") % 8).cast("string")).alias("qid"),
        F.col("event_type").alias("task"),
        F.concat(F.lit("d"), (F.col("user_id") % 4).cast("string")).alias("dataset"),
        F.array(half, half).alias("token_rewards"),
        mask.alias("response_mask"),
    )


def frames(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("bigint").alias("sample_id"),
                    F.col("vec_id").alias("t"), F.col("embedding").alias("feat"))


def _word_lengths(text: Column) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.length(w))


def token_rows(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    p = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("p_text"))
    r = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r_text"))
    j = p.join(r, ["conv_id", "turn"])
    return j.select(
        "conv_id", "turn",
        _word_lengths(F.col("p_text")).alias("prompt_ids"),
        _word_lengths(F.col("r_text")).alias("response_ids"),
    )


def metric_history(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("1970-01-01"))).cast("bigint")
    g = ev.groupBy(F.col("event_type").alias("run"), day.alias("epoch")).agg(
        (F.avg("value") / 500.0).alias("f1"), F.count(F.lit(1)).alias("n_samples"),
        F.sum(F.length("props")).cast("bigint").alias("n_tokens"))
    return g.withColumn("loss", 1.0 - F.col("f1"))


def scores(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.slice("embedding", 1, 25).alias("scores"),
                    (F.col("label") % 7).cast("bigint").alias("domain_id"))


def judge_inputs(spark, sf_dir):
    """(predictions, question bank) for the judge flow.

    Bank: benchmark items spread over the three QA datasets, answer = first
    word; several items share an answer, so the bank has duplicate keys.
    Predictions: all turns with the first word as gold; a fourth
    dataset has no bank at all.
    """
    b = table(spark, sf_dir, "benchmark")
    bank = b.select(_pick(["mimeqa", "siq2", "intentqa"], F.col("item_id") % 3).alias("dataset"),
                    F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("answer"),
                    F.col("text").alias("question"), F.col("item_id").alias("ordinal"))
    c = table(spark, sf_dir, "conversations")
    preds = c.select("conv_id", "turn",
                     _pick(["mimeqa", "siq2", "intentqa", "other"], F.col("conv_id") % 4).alias("dataset"),
                     F.col("text").alias("pred"),
                     F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("gold"))
    return preds, bank

"""Batching, ordering, budget and light-source queries (SMP-*, MET-16..18,
MED-02/03, SRC-04/06/13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import batching as B
from ..operators import media as MD
from ..operators import metrics as M
from ..session import scratch_path
from ..sources import readers as RD
from ..sources import sinks as SK
from . import fixtures as X
from .oracle_views import with_views
from .registry import finish, query

_V = ("samples",)
_RN = """
, rn AS (SELECT *, row_number() OVER (PARTITION BY modality_signature ORDER BY sample_id) AS rn,
                count(*) OVER (PARTITION BY modality_signature) AS gn
         FROM samples WHERE modality_signature IS NOT NULL)
, bt AS (SELECT *, CAST(floor((rn - 1) / 8) AS BIGINT) AS batch_no,
                modality_signature || '#' || CAST(floor((rn - 1) / 8) AS BIGINT) AS batch_id FROM rn)
"""


@query("smp01_modality_batches", _RN + """
SELECT sample_id, modality_signature, rn, batch_no, batch_id FROM bt WHERE floor(gn / 8) > batch_no""", _V)
def smp01(spark, sf_dir):
    b = B.modality_batches(X.samples(spark, sf_dir), 8, drop_last=True)
    return b.select("sample_id", "modality_signature", "rn", "batch_no", "batch_id")


@query("smp01b_modality_batches_keep_last", _RN + "SELECT sample_id, batch_id FROM bt", _V)
def smp01b(spark, sf_dir):
    return B.modality_batches(X.samples(spark, sf_dir), 8, drop_last=False).select("sample_id", "batch_id")


@query("smp02_homogeneous_check", _RN + """
SELECT batch_id, count(DISTINCT modality_signature) = 1 AS homogeneous FROM bt GROUP BY 1""", _V)
def smp02(spark, sf_dir):
    return B.homogeneous_check(B.modality_batches(X.samples(spark, sf_dir), 8, drop_last=False))


@query("smp03_skip_batches", _RN + """
SELECT sample_id, batch_id, CAST(floor((batch_no) / 5) AS BIGINT) AS epoch, CAST(batch_no % 5 AS BIGINT) AS "offset"
FROM bt WHERE batch_no >= 3""", _V)
def smp03(spark, sf_dir):
    b = B.skip_batches(B.modality_batches(X.samples(spark, sf_dir), 8, drop_last=False), 3)
    pos = B.resume_position(F.col("batch_no") + 1, F.lit(5))
    return b.select("sample_id", "batch_id", pos["epoch"].alias("epoch"), pos["offset"].alias("offset"))


def _places(seed, then):
    """SQL: the places of the seeded order, by the same network: the cycle is
    walked row by row until it is in range."""
    def once(x):
        a, b, wa, wb = f"({x} >> low)", f"({x} & ((1 << low) - 1))", "high", "low"
        for k in B.round_keys(seed):
            f = f"((((({b} + 1) * 48271 + {k}) % 2147483647 * 48271 % 2147483647) >> 7) & ((1 << {wa}) - 1))"
            a, b, wa, wb = b, f"xor({a}, {f})", wb, wa
        return f"(({a} << {wb}) | {b})"
    return f"""
, numbered AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS x, count(*) OVER () AS n FROM samples)
, halves AS (SELECT sample_id, x, n, b // 2 AS low, b - b // 2 AS high
             FROM (SELECT *, CAST(greatest(2, ceil(log2(n))) AS BIGINT) AS b FROM numbered))
, walk AS (SELECT sample_id, n, low, high, {once("x")} AS x FROM halves
           UNION ALL SELECT sample_id, n, low, high, {once("x")} FROM walk WHERE x >= n)
{then}"""


def _recursive(name, sql):
    return query(name, with_views(sql, "samples").replace("WITH ", "WITH RECURSIVE ", 1))


@_recursive("smp04_seeded_shuffle", _places(42, "SELECT sample_id, CAST(x AS BIGINT) AS position FROM walk WHERE x < n"))
def smp04(spark, sf_dir):
    """Every row's place in the seeded order."""
    s = B.seeded_shuffle(X.samples(spark, sf_dir).select("sample_id"), seed=42)
    return s.select("sample_id", "position")


@_recursive("smp04b_resume_shuffled", _places(7, """
SELECT CAST(x AS BIGINT) AS position, sample_id, lead(sample_id) OVER (ORDER BY x) AS next_id
FROM walk WHERE x < n AND x >= n // 3 AND x < n // 3 + 100"""))
def smp04b(spark, sf_dir):
    """The order written, and a hundred rows taken up again at a third of it."""
    path = scratch_path(spark, "shuffled")
    s = X.samples(spark, sf_dir).select("sample_id")
    B.write_shuffled(B.seeded_shuffle(s, seed=7), path, files=4)
    r = B.resume(spark.read.parquet(path), s.count() // 3, 100)
    return r.select("position", "sample_id", F.lead("sample_id").over(Window.orderBy("position")).alias("next_id"))


@query("smp05_cap_samples", _RN + "SELECT sample_id, batch_id FROM bt WHERE batch_no * 8 < 20", _V)
def smp05(spark, sf_dir):
    b = B.cap_samples(B.modality_batches(X.samples(spark, sf_dir), 8, drop_last=False), 20, 8)
    return b.select("sample_id", "batch_id")


@query("smp06_early_stop", """
, h AS (SELECT run, epoch, f1, row_number() OVER (PARTITION BY run ORDER BY epoch) AS idx,
               coalesce(max(f1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)
                 AS prev_best FROM metric_history)
, i AS (SELECT *, f1 > greatest(prev_best, 0.0) AS improved FROM h)
, s AS (SELECT *, idx - coalesce(max(CASE WHEN improved THEN idx END) OVER
               (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS streak FROM i)
SELECT run, epoch, improved, round(greatest(prev_best, f1, 0.0), 6) AS best_so_far, CAST(streak AS BIGINT) AS streak,
       min(CASE WHEN streak >= 3 THEN epoch END) OVER (PARTITION BY run) AS stop_at
FROM s""", ("metric_history",))
def smp06(spark, sf_dir):
    e = B.early_stop(X.metric_history(spark, sf_dir), "run", "epoch", "f1", patience=3)
    return finish(e.select("run", "epoch", "improved", "best_so_far", "streak", "stop_at"))


@query("smp06b_early_stop_stepwise", """
, h0 AS (SELECT run, epoch AS day, epoch // 6 AS epoch, f1, epoch % 6 <> 5 AS by_step FROM metric_history)
, h AS (SELECT *, greatest(coalesce(max(f1) OVER (PARTITION BY run ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0) AS best,
               count_if(by_step) OVER (PARTITION BY run ORDER BY day) AS nth,
               row_number() OVER (PARTITION BY run, epoch ORDER BY day DESC) = 1 AS tested FROM h0)
, s AS (SELECT *, f1 > best AS improved, nth - coalesce(max(CASE WHEN f1 > best AND by_step THEN nth END)
               OVER (PARTITION BY run ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS streak FROM h)
SELECT run, day, improved, CAST(streak AS BIGINT) AS streak, min(CASE WHEN tested AND streak >= 4 THEN epoch END) OVER (PARTITION BY run) AS stop_at
FROM s""", ("metric_history",))
def smp06b(spark, sf_dir):
    """Epochs of six days: five evaluations by steps and one at the end, which
    raises the best only; the stop is tested at the ends."""
    h = X.metric_history(spark, sf_dir).withColumnRenamed("epoch", "day").withColumn("epoch", F.floor(F.col("day") / 6).cast("bigint"))
    e = B.early_stop(h, "run", "day", "f1", patience=4, epoch="epoch", counted=F.col("day") % 6 != 5)
    return e.select("run", "day", "improved", "streak", "stop_at")


@query("smp07_best_checkpoint", """
SELECT run, epoch, round(min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6)
         AS best_loss, arg_min(epoch, loss) OVER (PARTITION BY run) AS best_at
FROM metric_history""", ("metric_history",))
def smp07(spark, sf_dir):
    b = B.best_checkpoint(X.metric_history(spark, sf_dir), "run", "epoch", "loss")
    return finish(b.select("run", "epoch", "best_loss", "best_at"))


@query("smp09_collate", _RN + """
SELECT batch_id, array_to_string(list(sample_id ORDER BY rn), ',') AS sample_ids,
       array_to_string(list(dataset ORDER BY rn), ',') AS datasets FROM bt GROUP BY 1""", _V)
def smp09(spark, sf_dir):
    b = B.modality_batches(X.samples(spark, sf_dir), 8, drop_last=False)
    c = B.collate(b, ["sample_id", "dataset"])
    return c.select("batch_id", F.array_join(F.transform("sample_id", lambda x: x.cast("string")), ",")
                    .alias("sample_ids"), F.array_join("dataset", ",").alias("datasets"))


@query("met16_p99_lower", """
, r AS (SELECT coalesce(modality_signature, '(null)') AS sig, n_chars,
               row_number() OVER (PARTITION BY coalesce(modality_signature, '(null)') ORDER BY n_chars, sample_id) AS r,
               count(*) OVER (PARTITION BY coalesce(modality_signature, '(null)')) AS n FROM samples)
SELECT sig, n_chars AS p99, n FROM r WHERE r = CAST(floor(0.99 * (n - 1)) AS BIGINT) + 1""", _V)
def met16(spark, sf_dir):
    s = X.samples(spark, sf_dir).select(F.coalesce("modality_signature", F.lit("(null)")).alias("sig"),
                                        "n_chars")
    return B.p99_lower(s, ["sig"], "n_chars")


@query("met17_media_budget", """
, t AS (SELECT conv_id, turn, list_concat(prompt_ids, response_ids) AS ids, prompt_ids, response_ids FROM token_rows)
, c AS (SELECT *, len(list_filter(ids, lambda x: x = 1)) AS image_ph, len(list_filter(ids, lambda x: x = 2)) AS video_ph,
               len(list_filter(ids, lambda x: x = 3)) AS audio_ph, len(list_filter(ids, lambda x: x = 4)) AS vision_start,
               len(list_filter(ids, lambda x: x = 5)) AS vision_end FROM t)
SELECT conv_id, turn, CAST(len(ids) AS INTEGER) AS input_ids_len,
       CAST(len(ids) - image_ph - video_ph - audio_ph - vision_start - vision_end AS INTEGER) AS text_tokens_est,
       CAST(image_ph AS INTEGER) AS image_ph, CAST(video_ph AS INTEGER) AS video_ph, CAST(audio_ph AS INTEGER) AS audio_ph,
       CAST(2 * len(prompt_ids) * 3 AS BIGINT) AS image_kv_tokens_est,
       CAST(len(response_ids) * 4 * 4 AS BIGINT) AS video_kv_tokens_est,
       round(list_sum(response_ids) * 160 / 16000.0 + len(prompt_ids) * 80 / 8000.0, 6) AS audio_secs
FROM c""", ("token_rows",))
def met17(spark, sf_dir):
    t = X.token_rows(spark, sf_dir)
    ids = F.concat("prompt_ids", "response_ids")
    image_grid = F.array(F.array(F.lit(2), F.size("prompt_ids"), F.lit(3)))
    video_grid = F.array(F.array(F.size("response_ids"), F.lit(4), F.lit(4)))
    audio = F.array(F.struct((F.aggregate("response_ids", F.lit(0), lambda a, x: a + x) * 160).alias("n_samples"),
                             F.lit(16000).alias("sr")),
                    F.struct((F.size("prompt_ids") * 80).alias("n_samples"), F.lit(8000).alias("sr")))
    b = MD.media_budget(ids, {"image_ph": 1, "video_ph": 2, "audio_ph": 3, "vision_start": 4, "vision_end": 5},
                        image_grid, video_grid, audio)
    return finish(t.select("conv_id", "turn", F.inline(F.array(b))).drop("vision_start", "vision_end"))


@query("met18_signature_counts", "SELECT modality_signature, count(*) AS n FROM samples GROUP BY 1", _V)
def met18(spark, sf_dir):
    return M.signature_counts(X.samples(spark, sf_dir))


@query("med02_frame_plan", """
, v AS (SELECT vec_id, CAST(label * 37 + vec_id % 50 AS BIGINT) AS n, CASE WHEN vec_id % 3 = 0 THEN NULL
               ELSE (vec_id % 7) * 1000 END AS duration, CAST(vec_id % 5 AS BIGINT) AS start FROM embeddings)
SELECT vec_id, array_to_string(CASE WHEN duration IS NOT NULL AND duration > 0 AND n > 8
    THEN list_transform(range(8), lambda i: CAST(floor(start + duration * i / 8) AS BIGINT))
    WHEN least(n, 512) > 8 THEN list_transform(range(8), lambda i: CAST(floor(i * (least(n, 512) - 1) / 7) AS BIGINT))
    ELSE range(least(n, 512)) END, ',') AS plan,
    CASE WHEN duration IS NOT NULL AND duration > 0 AND n > 8 THEN 'seek' ELSE 'index' END AS kind
FROM v""", ("embeddings",))
def med02(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings")
    v = e.select("vec_id", (F.col("label") * 37 + F.col("vec_id") % 50).cast("bigint").alias("n"),
                 F.when(F.col("vec_id") % 3 == 0, F.lit(None)).otherwise((F.col("vec_id") % 7) * 1000)
                 .cast("bigint").alias("duration"), (F.col("vec_id") % 5).cast("bigint").alias("start"))
    p = MD.frame_plan(F.col("n"), F.col("duration"), F.col("start"), 8)
    return v.select("vec_id", F.array_join(F.transform(p["plan"], lambda x: x.cast("string")), ",").alias("plan"),
                    p["kind"].alias("kind"))


@query("med03_media_manifest", """
SELECT sample_id,
  CAST(len(list_filter(coalesce(images, []), lambda x: x <> '')) AS INTEGER) AS n_images,
  CAST(coalesce(list_sum(list_transform(list_filter(coalesce(images, []), lambda x: x <> ''), lambda x: octet_length(encode(x)))), 0) AS BIGINT) AS image_bytes,
  CAST(len(list_filter(coalesce(videos, []), lambda x: x <> '')) AS INTEGER) AS n_videos,
  CAST(len(list_filter(coalesce(audios, []), lambda x: x <> '')) AS INTEGER) AS n_audios,
  CAST(coalesce(list_sum(list_transform(list_filter(coalesce(audios, []), lambda x: x <> ''), lambda x: octet_length(encode(x)))), 0) AS BIGINT) AS audio_bytes
FROM samples""", _V)
def med03(spark, sf_dir):
    s = X.samples(spark, sf_dir)
    m = MD.media_manifest(s, ["images", "videos", "audios"])
    return m.select("sample_id", "n_images", "image_bytes", "n_videos", "n_audios", "audio_bytes")


@query("src04_split_slice", """
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
WHERE i >= CAST(floor(n * 0.10) AS BIGINT) AND i < CAST(floor(n * 0.35) AS BIGINT)""")
def src04(spark, sf_dir):
    return RD.read_slice(spark, f"{sf_dir.rstrip('/')}/documents.parquet", "train[10%:35]").select("doc_id")


@query("src04b_split_slice_after_filter", """
, f AS (SELECT doc_id FROM documents WHERE contains(lower(lang), 'e'))
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM f)
WHERE i >= CAST(floor(n * 0.5) AS BIGINT) AND i < CAST(floor(n * 1.0) AS BIGINT)""")
def src04b(spark, sf_dir):
    df = RD.read_split(spark, f"{sf_dir.rstrip('/')}/documents.parquet", "train")
    df = df.filter(F.lower("lang").contains("e"))
    return RD.split_slice(df, "train[50%:]").select("doc_id")


@query("src06_light_scan", "SELECT doc_id, lang, source, n_chars FROM documents")
def src06(spark, sf_dir):
    return RD.light_scan(X.table(spark, sf_dir, "documents"), heavy=["text"])


@query("src13_metrics_long", """
, preds_all AS (SELECT dataset, y_true, y_pred FROM preds)
, k AS (SELECT dataset || '/' || cls || '/class_f1' AS key FROM (SELECT DISTINCT dataset, y_true AS cls FROM preds)
        UNION ALL SELECT 'validation/' || dataset || '/accuracy' FROM (SELECT DISTINCT dataset FROM preds))
SELECT key, split_part(key, '/', 1) AS scope,
       substr(key, length(split_part(key, '/', 1)) + 2) AS metric,
       CASE WHEN starts_with(key, 'validation/') THEN key ELSE 'validation/' || key END AS prefixed
FROM k""", ("preds",))
def src13(spark, sf_dir):
    p = X.preds(spark, sf_dir)
    cls = p.select("dataset", F.col("y_true").alias("cls")).distinct().select(
        F.concat_ws("/", "dataset", F.col("cls").cast("string"), F.lit("class_f1")).alias("key"))
    acc = p.select("dataset").distinct().select(F.concat(F.lit("validation/"), F.col("dataset"),
                                                         F.lit("/accuracy")).alias("key"))
    return SK.metrics_long(cls.unionByName(acc), "validation")

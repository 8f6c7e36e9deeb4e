"""Sequence and feature queries (SEQ-*, FEA-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scheme
from ..functions import sequences as S
from ..operators import features as FE
from . import fixtures as X
from .registry import finish, query

_V = ("token_rows",)


def _s(c):
    """int array -> 'a,b,c' (engine-neutral comparison form)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


_FIT = """
, f0 AS (SELECT conv_id, turn, prompt_ids, response_ids, list_concat(prompt_ids, response_ids) AS ids,
                len(prompt_ids) + len(response_ids) AS n FROM token_rows)
, f1 AS (SELECT *, CASE WHEN n > 64 THEN ids[1:64]
                        WHEN n < 64 THEN list_concat(ids, list_transform(range(64 - n), lambda x: 0)) ELSE ids END AS fitted,
                   CASE WHEN n >= 64 THEN list_transform(range(least(n, 64)), lambda x: 1)
                        ELSE list_concat(list_transform(range(n), lambda x: 1), list_transform(range(64 - n), lambda x: 0))
                   END AS attn FROM f0)
"""


@query("seq01_concat_fit", _FIT + """
SELECT conv_id, turn, array_to_string(fitted, ',') AS input_ids, array_to_string(attn, ',') AS attention_mask,
       array_to_string(CASE WHEN n > 64 THEN ids[n - 63:n] ELSE NULL END, ',') AS left_cut
FROM f1""", _V)
def seq01(spark, sf_dir):
    t = X.token_rows(spark, sf_dir)
    r = S.concat_fit("prompt_ids", "response_ids", 64, "right")
    l = S.concat_fit("prompt_ids", "response_ids", 64, "left")
    n = F.size("prompt_ids") + F.size("response_ids")
    return t.select("conv_id", "turn", _s(r["input_ids"]).alias("input_ids"),
                    _s(r["attention_mask"]).alias("attention_mask"),
                    F.when(n > 64, _s(l["input_ids"])).alias("left_cut"))


@query("seq02_loss_mask", _FIT + """
SELECT conv_id, turn, array_to_string(list_transform(attn, lambda x, i:
   CASE WHEN least(len(prompt_ids), 64) > 1 AND i - 1 < least(len(prompt_ids), 64) - 1 THEN 0
        WHEN least(n, 64) > 0 AND i - 1 = least(n, 64) - 1 THEN 0 ELSE x END), ',') AS loss_mask
FROM f1""", _V)
def seq02(spark, sf_dir):
    t = X.token_rows(spark, sf_dir)
    fit = S.concat_fit("prompt_ids", "response_ids", 64)
    n = F.size("prompt_ids") + F.size("response_ids")
    m = S.loss_mask(fit["attention_mask"], F.size("prompt_ids"), n, 64)
    return t.select("conv_id", "turn", _s(m).alias("loss_mask"))


@query("seq03_position_ids", _FIT + """
, g AS (SELECT conv_id, turn, attn, list_transform(prompt_ids, lambda x: x % 2) AS gm FROM f1)
SELECT conv_id, turn,
  array_to_string(list_transform(attn, lambda x, i: greatest(0, list_sum(attn[1:i]) - 1)), ',') AS pos_fit,
  array_to_string(list_transform(gm, lambda x, i: greatest(0, coalesce(list_sum(gm[1:i]), 0) - 1)), ',') AS pos_gaps
FROM g""", _V)
def seq03(spark, sf_dir):
    t = X.token_rows(spark, sf_dir)
    fit = S.concat_fit("prompt_ids", "response_ids", 64)
    gm = F.transform("prompt_ids", lambda x: x % 2)
    return t.select("conv_id", "turn", _s(S.position_ids(fit["attention_mask"])).alias("pos_fit"),
                    _s(S.position_ids(gm)).alias("pos_gaps"))


@query("seq04_pad_or_truncate", """
SELECT conv_id, turn, array_to_string(CASE
    WHEN len(response_ids) < 16 THEN list_concat(list_transform(range(16 - len(response_ids)), lambda x: 0), response_ids)
    WHEN len(response_ids) > 16 THEN list_concat(response_ids[1:8], response_ids[len(response_ids) - 7:len(response_ids)])
    ELSE response_ids END, ',') AS middle_left_pad,
  array_to_string(CASE
    WHEN len(response_ids) < 16 THEN list_concat(response_ids, list_transform(range(16 - len(response_ids)), lambda x: 9))
    WHEN len(response_ids) > 16 THEN response_ids[len(response_ids) - 15:len(response_ids)]
    ELSE response_ids END, ',') AS left_right_pad
FROM token_rows""", _V)
def seq04(spark, sf_dir):
    t = X.token_rows(spark, sf_dir)
    a = S.pad_or_truncate("response_ids", 16, pad_id=0, left_pad=True, truncation="middle")
    b = S.pad_or_truncate("response_ids", 16, pad_id=9, left_pad=False, truncation="left")
    return t.select("conv_id", "turn", _s(a).alias("middle_left_pad"), _s(b).alias("left_right_pad"))


@query("seq05_teacher_forced", """
, a0 AS (SELECT conv_id, turn, prompt_ids[1:48] AS p,
                CASE WHEN len(response_ids) = 0 OR response_ids[-1] <> 3 THEN list_concat(response_ids, [3])
                     ELSE response_ids END AS a FROM token_rows)
, a1 AS (SELECT conv_id, turn, p, CASE WHEN 48 - len(p) > 0 THEN a[1:48 - len(p)] ELSE [] END AS a FROM a0)
SELECT conv_id, turn,
  array_to_string(list_concat(p, a, list_transform(range(48 - len(p) - len(a)), lambda x: 0)), ',') AS input_ids,
  array_to_string(list_concat(list_transform(range(len(p) + len(a)), lambda x: 1),
                              list_transform(range(48 - len(p) - len(a)), lambda x: 0)), ',') AS attention_mask,
  array_to_string(list_concat(list_transform(range(len(p)), lambda x: -100), a,
                              list_transform(range(48 - len(p) - len(a)), lambda x: -100)), ',') AS labels
FROM a1""", _V)
def seq05(spark, sf_dir):
    t = X.token_rows(spark, sf_dir)
    tf = S.teacher_forced("prompt_ids", "response_ids", 48, eos_id=3)
    return t.select("conv_id", "turn", _s(tf["input_ids"]).alias("input_ids"),
                    _s(tf["attention_mask"]).alias("attention_mask"), _s(tf["labels"]).alias("labels"))


_MARKERS = {"image_ph": 1, "video_ph": 2, "audio_ph": 3, "vision_start": 4, "vision_end": 5}


@query("seq06_placeholder_counts", "SELECT conv_id, turn, " + ", ".join(
    f"CAST(len(list_filter(list_concat(prompt_ids, response_ids), lambda x: x = {v})) AS INTEGER) AS {k}"
    for k, v in _MARKERS.items()) + " FROM token_rows", _V)
def seq06(spark, sf_dir):
    t = X.token_rows(spark, sf_dir)
    ids = F.concat("prompt_ids", "response_ids")
    return t.select("conv_id", "turn", F.inline(F.array(S.placeholder_counts(ids, _MARKERS))))


@query("seq07_grid_tokens", """
SELECT conv_id, turn,
  CAST(1 * len(prompt_ids) * len(response_ids) + 2 * (len(prompt_ids) % 5 + 1) * 3 AS BIGINT) AS grid_tokens,
  CAST(ceil(list_sum(prompt_ids) * 10 / 28) * ceil(list_sum(response_ids) * 3 / 28) AS BIGINT) AS visual_tokens
FROM token_rows""", _V)
def seq07(spark, sf_dir):
    t = X.token_rows(spark, sf_dir)
    grid = F.array(F.array(F.lit(1), F.size("prompt_ids"), F.size("response_ids")),
                   F.array(F.lit(2), F.size("prompt_ids") % 5 + 1, F.lit(3)))
    h = F.aggregate("prompt_ids", F.lit(0), lambda a, x: a + x) * 10
    w = F.aggregate("response_ids", F.lit(0), lambda a, x: a + x) * 3
    return t.select("conv_id", "turn", S.grid_tokens(grid).alias("grid_tokens"),
                    S.visual_tokens(h, w).alias("visual_tokens"))


@query("seq08_masked_mean", """
, x AS (SELECT sample_id, CASE WHEN t % 3 <> 0 THEN 1.0 ELSE 0.0 END AS m, unnest(feat) AS v,
               unnest(range(len(feat))) AS d FROM frames)
SELECT sample_id, CAST(d AS INTEGER) AS d, round(sum(v * m) / greatest(sum(m), 1.0), 6) AS value_floor,
       round(sum(v * m) / sum(m), 6) AS value FROM x GROUP BY 1, 2""", ("frames",))
def seq08(spark, sf_dir):
    fr = X.frames(spark, sf_dir).withColumn("m", (F.col("t") % 3 != 0).cast("int"))
    m = FE.masked_means(fr, "m")
    return finish(m.select("sample_id", F.posexplode(F.arrays_zip("value_floor", "value")).alias("d", "v"))
                  .select("sample_id", "d", "v.value_floor", "v.value"))


@query("seq09_domain_argmax", """
, dom AS (SELECT domain_id, min(global_index) AS start, count(*) AS size FROM gclass GROUP BY 1)
SELECT s.vec_id, CAST(CASE WHEN d.start IS NULL THEN -1 ELSE
   list_position(s.scores[d.start + 1:d.start + d.size], list_max(s.scores[d.start + 1:d.start + d.size]))
   - 1 + d.start END AS BIGINT) AS pred
FROM scores s LEFT JOIN dom d ON d.domain_id = s.domain_id""", ("scores", "gclass"))
def seq09(spark, sf_dir):
    s = X.scores(spark, sf_dir)
    dom = scheme.global_classes(spark).groupBy("domain_id").agg(
        F.min("global_index").alias("start"), F.count(F.lit(1)).alias("size"))
    j = s.join(F.broadcast(dom), "domain_id", "left")
    return j.select("vec_id", S.domain_argmax("scores", F.col("start").cast("int"), F.col("size").cast("int"))
                    .alias("pred"))


_POOL = """
, x AS (SELECT sample_id, unnest(feat) AS v, unnest(range(len(feat))) AS d FROM frames)
, st AS (SELECT sample_id, d, avg(v) AS mean, stddev_pop(v) AS std, count(*) AS T FROM x GROUP BY 1, 2)
, rk AS (SELECT x.sample_id, x.d, x.v, st.T, row_number() OVER (PARTITION BY x.sample_id, x.d ORDER BY x.v) AS r
         FROM x JOIN st USING (sample_id, d))
, q AS (SELECT sample_id, d, max(CASE WHEN r = greatest(1, CAST(floor(0.25 * T) AS INTEGER)) THEN v END) AS p25,
               max(CASE WHEN r = greatest(1, CAST(floor(0.75 * T) AS INTEGER)) THEN v END) AS p75
        FROM rk GROUP BY 1, 2)
, pooled AS (SELECT st.sample_id, st.d, mean, std, p25, p75 FROM st JOIN q USING (sample_id, d))
"""


@query("fea03_pool", _POOL + """
SELECT sample_id, CAST(d AS INTEGER) AS i, round(mean, 6) AS value FROM pooled
UNION ALL SELECT sample_id, CAST(d + 64 AS INTEGER), round(std, 6) FROM pooled
UNION ALL SELECT sample_id, CAST(d + 128 AS INTEGER), round(p25, 6) FROM pooled
UNION ALL SELECT sample_id, CAST(d + 192 AS INTEGER), round(p75, 6) FROM pooled""", ("frames",))
def fea03(spark, sf_dir):
    p = FE.pool(X.frames(spark, sf_dir), "meanstdp25p75")
    return finish(p.select("sample_id", F.posexplode("pooled").alias("i", "value")))


@query("fea04_normalise", _POOL + """
, agg AS (SELECT sample_id, sqrt(sum(mean * mean)) AS nrm, avg(mean) AS mu, stddev_pop(mean) AS sd
          FROM pooled GROUP BY 1)
SELECT p.sample_id, CAST(p.d AS INTEGER) AS i, round(p.mean / greatest(a.nrm, 1e-6), 6) AS l2,
       round((p.mean - a.mu) / greatest(a.sd, 1e-6), 6) AS zscore
FROM pooled p JOIN agg a USING (sample_id)""", ("frames",))
def fea04(spark, sf_dir):
    p = FE.pool(X.frames(spark, sf_dir), "mean")
    out = p.select("sample_id", FE.normalise("pooled", "l2").alias("l2"), FE.normalise("pooled", "zscore").alias("z"))
    return finish(out.select("sample_id", F.posexplode(F.arrays_zip("l2", "z")).alias("i", "v"))
                  .select("sample_id", "i", F.col("v.l2").alias("l2"), F.col("v.z").alias("zscore")))


@query("fea05_fit_width", _POOL + """
, m AS (SELECT sample_id, list(mean ORDER BY d) AS v FROM pooled GROUP BY 1)
SELECT sample_id, len(v[1:50]) AS n50, round(list_sum(v[1:50]), 6) AS s50,
       len(list_concat(v, list_transform(range(80 - len(v)), lambda x: 0.0))) AS n80,
       round(list_sum(v), 6) AS s80 FROM m""", ("frames",))
def fea05(spark, sf_dir):
    p = FE.pool(X.frames(spark, sf_dir), "mean")
    a = FE.fit_width("pooled", 50)
    b = FE.fit_width("pooled", 80)
    tot = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return finish(p.select("sample_id", F.size(a).alias("n50"), tot(a).alias("s50"),
                           F.size(b).alias("n80"), tot(b).alias("s80")))


def _pose_parts(spark, sf_dir):
    """Embeddings reshaped into pose parts [T, K, C]: 8 frames of 4 keypoints by
    label, or 4 frames of 8, or keypoints of four values, which are no valid part."""
    e = X.table(spark, sf_dir, "embeddings")
    T = F.when(F.col("label") % 10 < 2, 4).otherwise(8)
    C = F.when(F.col("label") % 10 == 0, 4).otherwise(2)
    K = (F.lit(64) / T / C).cast("int")
    kp = F.transform(F.sequence(F.lit(0), T - 1), lambda t: F.transform(
        F.sequence(F.lit(0), K - 1), lambda k: F.slice("embedding", t * K * C + k * C + 1, C)))
    part = F.element_at(F.array(*[F.lit(p) for p in FE.POSE_PARTS]), (F.col("vec_id") % 4 + 1).cast("int"))
    return e.select((F.col("vec_id") / 4).cast("bigint").alias("sample_id"), part.alias("part"), kp.alias("kp"))


_POSE_SQL = """
, p AS (SELECT vec_id // 4 AS sample_id, label % 10 <> 0 AS ok, CASE WHEN label % 10 < 2 THEN 4 ELSE 8 END AS t FROM embeddings)
, f AS (SELECT sample_id, count_if(ok) > 0 AND coalesce(min(t) FILTER (ok) = max(t) FILTER (ok), false) AS valid,
               CAST(coalesce(min(t) FILTER (ok), 0) AS INTEGER) AS n_frames, count_if(ok) * 64 AS width FROM p GROUP BY 1)
"""


@query("fea01_pose_frames", _POSE_SQL + """
SELECT sample_id, valid, n_frames, CAST(CASE WHEN valid THEN width END AS INTEGER) AS n_values FROM f""")
def fea01(spark, sf_dir):
    """Pose parts -> frame-wise features; validity and sizes per sample."""
    pf = FE.pose_frames(_pose_parts(spark, sf_dir), use_conf=False)
    return pf.select("sample_id", "valid", "n_frames", F.size(F.flatten("frames")).alias("n_values"))


@query("fea02_audio_frames", """
SELECT vec_id AS sample_id, true AS valid, CAST(1 + label % 2 AS INTEGER) AS n_frames,
       CAST(CASE WHEN label % 2 = 0 THEN 128 ELSE 64 END AS INTEGER) AS pooled_width FROM embeddings""")
def fea02(spark, sf_dir):
    """Audio features as [D] vectors or [T, D] matrices -> frames."""
    e = X.table(spark, sf_dir, "embeddings")
    vec = F.when(F.col("label") % 2 == 0, F.col("embedding"))
    mat = F.when(F.col("label") % 2 == 1, F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)))
    df = e.select(F.col("vec_id").alias("sample_id"), vec.alias("vec"), mat.alias("mat"))
    af = FE.audio_frames(df)
    pooled = FE.pool(FE.frames_to_rows(af.filter("valid")), "meanstd")
    return af.select("sample_id", "valid", F.size("frames").alias("n_frames")).join(
        pooled.select("sample_id", F.size("pooled").alias("pooled_width")), "sample_id", "left")


@query("fea06_batch_valid", _POSE_SQL + """
SELECT sample_id // 2 AS batch_id, bool_and(valid) AS batch_valid, count(*) AS n FROM f GROUP BY 1""")
def fea06(spark, sf_dir):
    """A batch of two pose samples is void when one sample is invalid."""
    pf = FE.pose_frames(_pose_parts(spark, sf_dir))
    return FE.batch_valid(pf.withColumn("batch_id", (F.col("sample_id") / 2).cast("bigint")))

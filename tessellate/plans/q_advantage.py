"""Advantage and EMA-state queries (ADV-*, STR-01, SMP-08, JON-05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advantage as A
from ..session import scratch_path
from ..streaming.ema import Ema, ema_fold, ema_scan
from . import fixtures as X
from .oracle_views import with_views
from .registry import finish, query


def _recursive(name, sql):
    """Register a query whose oracle needs a recursive CTE."""
    return query(name, with_views(sql, "rollouts").replace("WITH ", "WITH RECURSIVE ", 1))

# Oracle: the default configuration written with window sums.  A seeded EMA
# over the i-th appearance of a key has the closed form
#   seed first: b^(i-1) x_1 + sum_{j>=2} (1-b) b^(i-j) x_j
#   seed 0:     sum_{j>=1} (1-b) b^(i-j) x_j
_BASE = """
, r0 AS (SELECT step, rollout_id, qid, task, dataset, list_sum(token_rewards) AS raw, response_mask FROM rollouts)
, mm AS (SELECT step, min(raw) AS mn, max(raw) AS mx FROM r0 GROUP BY step)
, r1 AS (SELECT r0.*, (raw - mn) / greatest(mx - mn, 1e-6) AS scaled FROM r0 JOIN mm USING (step))
, qn AS (SELECT step, qid, avg(scaled) AS mu, stddev_pop(scaled) AS sd, count(*) AS n FROM r1 GROUP BY 1, 2)
, r2 AS (SELECT r1.*, CASE WHEN n < 2 THEN scaled ELSE (scaled - mu) / greatest(sd, 1e-6) END AS adv
         FROM r1 JOIN qn USING (step, qid))
, tm AS (SELECT step, task, sum(abs(adv)) AS mass, count(*) AS sig, count(*) AS cnt FROM r2 GROUP BY 1, 2)
, tr AS (SELECT *, greatest(mass / greatest(cnt, 1), 1e-6) AS rho_batch,
                row_number() OVER (PARTITION BY task ORDER BY step) AS i FROM tm)
, te AS (SELECT *, greatest(pow(0.95, i - 1) * first_value(rho_batch) OVER w
                + 0.05 * pow(0.95, i) * sum(CASE WHEN i >= 2 THEN rho_batch * pow(0.95, -i) ELSE 0 END) OVER w,
                1e-6) AS rho_ema
         FROM tr WINDOW w AS (PARTITION BY task ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
, ref AS (SELECT step, avg(ln(rho_ema)) AS log_rho_ref, avg(rho_ema) AS rho_ref_arith FROM te GROUP BY step)
, dens AS (SELECT te.*, ref.log_rho_ref, ref.rho_ref_arith FROM te JOIN ref USING (step))
, lm AS (SELECT *, 0.05 * pow(0.95, i) * sum((log_rho_ref - ln(rho_ema)) * pow(0.95, -i))
                  OVER (PARTITION BY task ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  AS log_mult_ema FROM dens)
, ts AS (SELECT step, task, greatest(0.5, least(4.0, exp(log_mult_ema))) AS task_scale FROM lm)
, qm AS (SELECT step, task, qid, greatest(sum(abs(adv)) / count(*), 1e-6) AS m FROM r2 GROUP BY 1, 2, 3)
, qt AS (SELECT step, task, count(*) AS nq, avg(ln(m)) AS log_mbar FROM qm GROUP BY 1, 2)
, qs AS (SELECT qm.step, qm.qid, CASE WHEN nq >= 2 THEN greatest(0.5, least(3.0, exp(log_mbar - ln(m))))
                ELSE 1.0 END AS question_scale FROM qm JOIN qt USING (step, task))
, fin AS (SELECT r2.*, ts.task_scale, qs.question_scale, adv * ts.task_scale * qs.question_scale AS advantage
          FROM r2 JOIN ts USING (step, task) JOIN qs USING (step, qid))
"""
_V = ("rollouts",)


def _adv(spark, sf_dir, cfg=A.AdvantageConfig()):
    return A.group_relative_advantage(X.rollouts(spark, sf_dir), cfg)


@query("adv01_rollout_reward", _BASE + "SELECT rollout_id, round(raw, 6) AS raw FROM r0", _V)
def adv01(spark, sf_dir):
    return finish(A.rollout_reward(X.rollouts(spark, sf_dir)).select("rollout_id", "raw"))


@query("adv02_minmax_scale", _BASE + "SELECT rollout_id, round(scaled, 6) AS scaled FROM r1", _V)
def adv02(spark, sf_dir):
    df = A.minmax_scale(A.rollout_reward(X.rollouts(spark, sf_dir)))
    return finish(df.select("rollout_id", "scaled"))


_STATS_SQL = """
, st0 AS (SELECT step, '{by}' AS kind, {by} AS key, avg({c}) AS mu, stddev_pop({c}) AS sigma, count(*) AS count,
                 avg(abs({c})) AS abs_mu, stddev_pop(abs({c})) AS abs_sigma
          FROM {src} GROUP BY 1, 2, 3)
, st1 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY step) AS i FROM st0)
, st_{by} AS (SELECT step, kind, key, mu, sigma, count,
     pow(0.95, i - 1) * first_value(mu) OVER w
       + 0.05 * pow(0.95, i) * sum(CASE WHEN i >= 2 THEN mu * pow(0.95, -i) ELSE 0 END) OVER w AS ema_mu,
     pow(0.95, i - 1) * first_value(sigma) OVER w
       + 0.05 * pow(0.95, i) * sum(CASE WHEN i >= 2 THEN sigma * pow(0.95, -i) ELSE 0 END) OVER w AS ema_sigma,
     pow(0.95, i - 1) * first_value(abs_mu) OVER w
       + 0.05 * pow(0.95, i) * sum(CASE WHEN i >= 2 THEN abs_mu * pow(0.95, -i) ELSE 0 END) OVER w AS ema_abs_mu,
     pow(0.95, i - 1) * first_value(abs_sigma) OVER w
       + 0.05 * pow(0.95, i) * sum(CASE WHEN i >= 2 THEN abs_sigma * pow(0.95, -i) ELSE 0 END) OVER w AS ema_abs_sigma
   FROM st1 WINDOW w AS (PARTITION BY key ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


def _stats_sql(by, c, src):
    return _STATS_SQL.format(by=by, c=c, src=src).replace("st0 AS", f"st0_{by} AS").replace(
        "FROM st0)", f"FROM st0_{by})").replace("st1 AS", f"st1_{by} AS").replace("FROM st1 WINDOW", f"FROM st1_{by} WINDOW")


_STATS_OUT = ("SELECT step, kind, key, round(mu, 6) AS mu, round(sigma, 6) AS sigma, count, "
              "round(ema_mu, 6) AS ema_mu, round(ema_sigma, 6) AS ema_sigma, round(ema_abs_mu, 6) AS ema_abs_mu, "
              "round(ema_abs_sigma, 6) AS ema_abs_sigma FROM st_task "
              "UNION ALL SELECT step, kind, key, round(mu, 6), round(sigma, 6), count, round(ema_mu, 6), "
              "round(ema_sigma, 6), round(ema_abs_mu, 6), round(ema_abs_sigma, 6) FROM st_dataset")


def _stats_spark(df, col, cfg=A.AdvantageConfig()):
    cols = ["step", "kind", "key", "mu", "sigma", "count", "ema_mu", "ema_sigma", "ema_abs_mu", "ema_abs_sigma"]
    t = A.group_stats(df, "task", col, cfg).select(*cols)
    d = A.group_stats(df, "dataset", col, cfg).select(*cols)
    return finish(t.unionByName(d))


@query("adv03_raw_stats", _BASE + _stats_sql("task", "scaled", "r1") + _stats_sql("dataset", "scaled", "r1")
       + _STATS_OUT, _V)
def adv03(spark, sf_dir):
    df = A.minmax_scale(A.rollout_reward(X.rollouts(spark, sf_dir)))
    return _stats_spark(df, "scaled")


@query("adv04_group_norm", _BASE + "SELECT rollout_id, round(adv, 6) AS adv FROM r2", _V)
def adv04(spark, sf_dir):
    df = A.group_norm(A.minmax_scale(A.rollout_reward(X.rollouts(spark, sf_dir))))
    return finish(df.select("rollout_id", "adv"))


@query("adv05_advantage_stats", _BASE + _stats_sql("task", "adv", "r2") + _stats_sql("dataset", "adv", "r2")
       + _STATS_OUT, _V)
def adv05(spark, sf_dir):
    df = A.group_norm(A.minmax_scale(A.rollout_reward(X.rollouts(spark, sf_dir))))
    return _stats_spark(df, "adv")


_EMA = ("pow(0.95, i - 1) * first_value({c}) OVER w + 0.05 * pow(0.95, i) * "
        "sum(CASE WHEN i >= 2 THEN {c} * pow(0.95, -i) ELSE 0 END) OVER w AS e_{c}")


@query("adv06_responsibility", _BASE + f"""
, g AS (SELECT step, avg(abs(adv)) AS gm FROM r2 GROUP BY 1)
, z0 AS (SELECT step, task, stddev_pop(adv) AS sg, avg(abs(adv)) AS am, stddev_pop(abs(adv)) AS asg FROM r2 GROUP BY 1, 2)
, z1 AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY step) AS i FROM z0)
, z2 AS (SELECT step, task, {_EMA.format(c="sg")}, {_EMA.format(c="am")}, {_EMA.format(c="asg")} FROM z1
         WINDOW w AS (PARTITION BY task ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT rollout_id, 1.0 AS r_none,
       round(1 / (1 + exp(-4.0 * (abs(adv) - 0.5))), 6) AS r_absolute,
       round(1 / (1 + exp(-4.0 * (abs(adv) / greatest(gm, 1e-6) - 1))), 6) AS r_global_norm,
       round(1 / (1 + exp(-4.0 * ((abs(adv) - greatest(e_am, 1e-6))
           / (greatest(CASE WHEN e_asg <= 0 THEN e_sg ELSE e_asg END, 1e-6) + 1e-6) - 0.25))), 6) AS r_z_score
FROM r2 JOIN g USING (step) JOIN z2 USING (step, task)""", _V)
def adv06(spark, sf_dir):
    df = A.group_norm(A.minmax_scale(A.rollout_reward(X.rollouts(spark, sf_dir))))
    out = df.select("step", "rollout_id", "task", "adv")
    a = A.responsibility(out, A.AdvantageConfig(mode="no_responsibilities")).withColumnRenamed("r", "r_none")
    a = A.responsibility(a, A.AdvantageConfig(mode="absolute")).withColumnRenamed("r", "r_absolute")
    a = A.responsibility(a, A.AdvantageConfig(mode="global_norm")).withColumnRenamed("r", "r_global_norm")
    a = A.responsibility(a, A.AdvantageConfig(mode="z_score")).withColumnRenamed("r", "r_z_score")
    return finish(a.select("rollout_id", "r_none", "r_absolute", "r_global_norm", "r_z_score"))


@query("adv07_task_density", _BASE + """
SELECT step, task, round(mass, 6) AS mass, cnt, round(rho_batch, 6) AS rho_batch, round(rho_ema, 6) AS rho_ema,
       round(log_rho_ref, 6) AS log_rho_ref, round(rho_ref_arith, 6) AS rho_ref_arith FROM dens""", _V)
def adv07(spark, sf_dir):
    df = A.responsibility(A.group_norm(A.minmax_scale(A.rollout_reward(X.rollouts(spark, sf_dir)))))
    d = A.task_density(A.task_mass(df))
    return finish(d.select("step", "task", "mass", "cnt", "rho_batch", "rho_ema", "log_rho_ref", "rho_ref_arith"))


@query("adv08_rarity_boost", _BASE + """
, sg AS (SELECT step, task, greatest(sig, 1e-6) AS sb, row_number() OVER (PARTITION BY task ORDER BY step) AS i FROM tm)
, se AS (SELECT *, pow(0.95, i - 1) * first_value(sb) OVER w
                + 0.05 * pow(0.95, i) * sum(CASE WHEN i >= 2 THEN sb * pow(0.95, -i) ELSE 0 END) OVER w AS sig_ema
         FROM sg WINDOW w AS (PARTITION BY task ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
, sr AS (SELECT step, exp(avg(ln(greatest(sig_ema, 1e-6)))) AS sig_ref FROM se GROUP BY 1)
SELECT step, task, round(sig_ema, 4) AS sig_ema,
       round(exp(least(0.5 * ln(1 + greatest(0.0, sig_ref / greatest(sig_ema, 1e-6) - 2.5)), ln(1.5))), 6) AS k
FROM se JOIN sr USING (step)""", _V)
def adv08(spark, sf_dir):
    cfg = A.AdvantageConfig(rarity=True)
    df = A.responsibility(A.group_norm(A.minmax_scale(A.rollout_reward(X.rollouts(spark, sf_dir)))), cfg)
    k = A.rarity_boost(A.task_density(A.task_mass(df), cfg), cfg)
    return finish(k.select("step", "task", F.round("sig_ema", 4).alias("sig_ema"), "k"))


@query("adv09_task_scale", _BASE + """
SELECT step, task, round(task_scale, 6) AS task_scale,
       round(greatest(0.5, least(4.0, 1.0 / rho_ema)), 6) AS naive_scale FROM lm JOIN ts USING (step, task)""", _V)
def adv09(spark, sf_dir):
    df = A.responsibility(A.group_norm(A.minmax_scale(A.rollout_reward(X.rollouts(spark, sf_dir)))))
    dens = A.rarity_boost(A.task_density(A.task_mass(df)))
    g = A.task_scale(dens).select("step", "task", "task_scale")
    n = A.task_scale(dens, A.AdvantageConfig(scaling="naive_density")).select(
        "step", "task", F.col("task_scale").alias("naive_scale"))
    return finish(g.join(n, ["step", "task"]))


@_recursive("adv09b_task_scale_arith", """
, r0 AS (SELECT step, rollout_id, qid, task, list_sum(token_rewards) AS raw FROM rollouts)
, mm AS (SELECT step, min(raw) AS mn, max(raw) AS mx FROM r0 GROUP BY step)
, r1 AS (SELECT r0.*, (raw - mn) / greatest(mx - mn, 1e-6) AS scaled FROM r0 JOIN mm USING (step))
, qn AS (SELECT step, qid, avg(scaled) AS mu, stddev_pop(scaled) AS sd, count(*) AS n FROM r1 GROUP BY 1, 2)
, r2 AS (SELECT r1.*, CASE WHEN n < 2 THEN scaled ELSE (scaled - mu) / greatest(sd, 1e-6) END AS adv
         FROM r1 JOIN qn USING (step, qid))
, tm AS (SELECT step, task, greatest(sum(abs(adv)) / count(*), 1e-6) AS rho_batch FROM r2 GROUP BY 1, 2)
, tr AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY step) AS i FROM tm)
, te AS (SELECT *, greatest(pow(0.95, i - 1) * first_value(rho_batch) OVER w
                + 0.05 * pow(0.95, i) * sum(CASE WHEN i >= 2 THEN rho_batch * pow(0.95, -i) ELSE 0 END) OVER w,
                1e-6) AS rho_ema
         FROM tr WINDOW w AS (PARTITION BY task ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
, inst AS (SELECT te.task, te.i, te.step, a.ra / te.rho_ema AS mi
           FROM te JOIN (SELECT step, avg(rho_ema) AS ra FROM te GROUP BY 1) a USING (step))
, rec(task, i, step, scale) AS (
    SELECT task, i, step, greatest(0.5, least(4.0, mi)) FROM inst WHERE i = 1
    UNION ALL
    SELECT n.task, n.i, n.step, greatest(0.5, least(4.0, 0.95 * rec.scale + 0.05 * n.mi))
    FROM rec JOIN inst n ON n.task = rec.task AND n.i = rec.i + 1)
SELECT step, task, round(scale, 6) AS task_scale FROM rec""")
def adv09b(spark, sf_dir):
    cfg = A.AdvantageConfig(scaling="arith")
    df = A.responsibility(A.group_norm(A.minmax_scale(A.rollout_reward(X.rollouts(spark, sf_dir)))), cfg)
    ts = A.task_scale(A.rarity_boost(A.task_density(A.task_mass(df), cfg), cfg), cfg)
    return finish(ts.select("step", "task", "task_scale"))


@query("adv10_question_scale", _BASE + "SELECT step, qid, round(question_scale, 6) AS question_scale FROM qs", _V)
def adv10(spark, sf_dir):
    df = A.responsibility(A.group_norm(A.minmax_scale(A.rollout_reward(X.rollouts(spark, sf_dir)))))
    return finish(A.question_scale(df))


@query("adv11_final_advantage", _BASE + """
SELECT step, rollout_id, qid, task, dataset, round(adv, 6) AS adv, round(task_scale, 6) AS task_scale,
       round(question_scale, 6) AS question_scale, round(advantage, 6) AS advantage FROM fin""", _V)
def adv11(spark, sf_dir):
    a = _adv(spark, sf_dir)
    return finish(a.select("step", "rollout_id", "qid", "task", "dataset", "adv", "task_scale",
                           "question_scale", "advantage"))


@query("jon05_scale_broadcast", _BASE + """
SELECT task, round(min(task_scale), 6) AS min_task_scale, round(max(question_scale), 6) AS max_question_scale,
       count(*) AS n FROM fin GROUP BY 1""", _V)
def jon05(spark, sf_dir):
    a = _adv(spark, sf_dir)
    return finish(a.groupBy("task").agg(F.min("task_scale").alias("min_task_scale"),
                                        F.max("question_scale").alias("max_question_scale"),
                                        F.count(F.lit(1)).alias("n")))


@query("adv12_to_tokens", _BASE + """

, tk AS (SELECT rollout_id, advantage, response_mask, unnest(range(len(response_mask))) AS pos FROM fin)
SELECT rollout_id, CAST(pos AS BIGINT) AS pos, round(response_mask[pos + 1] * advantage, 6) AS token_advantage
FROM tk""", _V)
def adv12(spark, sf_dir):
    ro = X.rollouts(spark, sf_dir)
    a = _adv(spark, sf_dir).select("rollout_id", "advantage").join(ro.select("rollout_id", "response_mask"),
                                                                   "rollout_id")
    t = A.to_tokens(a)
    return finish(t.select("rollout_id", F.posexplode("token_advantage").alias("pos", "token_advantage"))
                  .withColumn("pos", F.col("pos").cast("bigint")))


@query("adv13_advantage_log", _BASE + """
SELECT step, 'final' AS stage, qid, task, dataset, round(advantage, 6) AS advantage, 1.0 AS responsibility FROM fin
UNION ALL SELECT step, 'post_grpo', qid, task, dataset, round(adv, 6), NULL FROM fin""", _V)
def adv13(spark, sf_dir):
    """Writes the advantage log partitioned by step and reads it back."""
    path = scratch_path(spark, "advantage_log")
    A.advantage_log(_adv(spark, sf_dir), path)
    log = spark.read.parquet(path)
    return finish(log.select(F.col("step").cast("bigint").alias("step"), "stage", "qid", "task", "dataset", "advantage", "responsibility"))


@query("smp08_rollout_pos", """
SELECT rollout_id, row_number() OVER (PARTITION BY step, qid ORDER BY rollout_id) - 1 AS rollout_pos
FROM rollouts""", _V)
def smp08(spark, sf_dir):
    return A.rollout_pos(X.rollouts(spark, sf_dir)).select("rollout_id", F.col("rollout_pos").cast("bigint"))


#: The averages in closed form.
STR01 = """
, h AS (SELECT run, epoch, f1, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM metric_history)
SELECT run, epoch, round(pow(0.95, i - 1) * first_value(f1) OVER w
       + 0.05 * pow(0.95, i) * sum(CASE WHEN i >= 2 THEN f1 * pow(0.95, -i) ELSE 0 END) OVER w, 6) AS ema_first,
       round(0.05 * pow(0.95, i) * sum(f1 * pow(0.95, -i)) OVER w, 6) AS ema_zero
FROM h WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query("str01_ema_fold", STR01, ("metric_history",))
def str01(spark, sf_dir):
    h = X.metric_history(spark, sf_dir)
    a = ema_fold(h, ["run"], "epoch", "f1", 0.95, seed="first", out="ema_first")
    b = ema_fold(h, ["run"], "epoch", "f1", 0.95, seed=0.0, out="ema_zero")
    return finish(a.join(b, ["run", "epoch"]))


@_recursive("str01c_ema_scan", """
, h AS (SELECT task, rollout_id, ln(1 + list_sum(token_rewards)) AS v, row_number() OVER (PARTITION BY task ORDER BY rollout_id) AS i FROM rollouts)
, rec(task, i, rollout_id, a, b) AS (
    SELECT task, i, rollout_id, v, greatest(4.5, least(5.2, 0.05 * v)) FROM h WHERE i = 1
    UNION ALL
    SELECT h.task, h.i, h.rollout_id, 0.95 * rec.a + 0.05 * h.v, greatest(4.5, least(5.2, 0.95 * rec.b + 0.05 * h.v))
    FROM rec JOIN h ON h.task = rec.task AND h.i = rec.i + 1)
SELECT task, rollout_id, round(a, 6) AS ema_first, round(b, 6) AS ema_bounded FROM rec""")
def str01c(spark, sf_dir):
    """Averages after every rollout of a task, a few long histories, by the scan."""
    h = A.rollout_reward(X.rollouts(spark, sf_dir)).select("task", "rollout_id", F.log1p("raw").alias("v"))
    emas = [Ema("v", 0.95, "ema_first"), Ema("v", 0.95, "ema_bounded", 0.0, (4.5, 5.2))]
    return finish(ema_scan(h, ["task"], "rollout_id", emas))


@query("adv11b_final_advantage_long_history", _BASE + """
SELECT step, rollout_id, round(task_scale, 6) AS task_scale, round(advantage, 6) AS advantage FROM fin""", _V)
def adv11b(spark, sf_dir):
    """The final advantage with the tasks' histories folded by the scan."""
    a = _adv(spark, sf_dir, A.AdvantageConfig(long_history=True))
    return finish(a.select("step", "rollout_id", "task_scale", "advantage"))

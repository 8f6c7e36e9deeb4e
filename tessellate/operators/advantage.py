"""Group-relative advantage with task-density scaling (ADV-01 .. ADV-13).

Input: one row per rollout ``(step, rollout_id, qid, task, dataset,
token_rewards array<double>, response_mask array<int>)``; a *step* is one
training batch.  Output: one advantage per rollout.

Plan shape (statistics of steps, tasks and questions are aggregations with
map-side combining, joined back, so that neither a hot task nor a hot question
lands in one task: its rows meet one row, by a broadcast or a skew-split join):

    rollouts -> reward sum (ADV-01) -> per-step min/max join (ADV-02)
      -> per-(step, qid) mean/std (ADV-04) -> responsibilities (ADV-06)
      -> per-(step, task, qid) means (ADV-10) -> per-(step, task) mass and question statistics
      -> density EMA per task across steps (ADV-07, STR-01 fold)
      -> per-step reference over tasks present -> task scale EMA (ADV-09)
      -> A * task_scale * question_scale (ADV-11) -> token broadcast (ADV-12)

The cross-step state (EMA per task) is folded over the per-(step, task)
table, whose size is steps x tasks, independent of the rollout count.
Defaults follow the published configuration; mode names are parameters.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_once
from ..sources.sinks import rebalanced
from ..streaming.ema import Ema, ema_folds, ema_scan
from .batching import global_row_number


@dataclass(frozen=True)
class AdvantageConfig:
    # FIXED VALUES (defaults of the published configuration)
    mode: str = "no_responsibilities"   # global_norm | z_score | absolute | no_responsibilities
    scaling: str = "geom"               # geom | arith | naive_density
    density: str = "normalized"         # normalized | unnormalized
    rarity: bool = False
    hierarchical: bool = True
    group_norm: bool = True
    minmax: bool = True
    beta_r: float = 4.0
    delta_z: float = 0.25
    a0: float = 0.5
    gamma: float = 1.0
    eta_k: float = 0.5
    k_max: float = 1.5
    rare_ratio: float = 2.5
    alpha_roll: float = 1.0
    hier_min: float = 0.5
    hier_max: float = 3.0
    beta_rho: float = 0.95
    beta_logmult: float = 0.95
    task_min: float = 0.5
    task_max: float = 4.0
    beta_mu: float = 0.95
    beta_sigma: float = 0.95
    eps: float = 1e-6
    #: Fold the tasks' histories by :func:`ema_scan`, for very many steps.
    long_history: bool = False


#: Per-task state that the z_score mode carries, besides density, scale and rarity.
STAT_STATE = ("ema_mu", "ema_sigma", "ema_abs_mu", "ema_abs_sigma")


def _clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def join_back(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``stats`` (unique in ``keys``), null being a key
    like any other."""
    right = stats.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[c for c in stats.columns if c not in keys])
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])
    return df.join(right, on).drop(*[f"_k{i}" for i in range(len(keys))])


def _fold(df: DataFrame, by: str, emas: list[Ema], cfg: AdvantageConfig, state: DataFrame | None) -> DataFrame:
    """``by, step`` and the averages of a per-(step, by) table."""
    return (ema_scan if cfg.long_history else ema_folds)(df, [by], "step", emas, state)


def _sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def rollout_reward(df: DataFrame, col: str = "token_rewards") -> DataFrame:
    """ADV-01: scalar reward = sum of token rewards."""
    return df.withColumn("raw", F.aggregate(F.col(col).cast("array<double>"), F.lit(0.0), lambda a, x: a + x))


def minmax_scale(df: DataFrame, cfg: AdvantageConfig = AdvantageConfig(), col: str = "raw",
                 out: str = "scaled") -> DataFrame:
    """ADV-02: (x - min) / max(max - min, eps) over all rollouts of a step."""
    if not cfg.minmax:
        return df.withColumn(out, F.col(col))
    st = df.groupBy("step").agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    j = df.join(st, "step")
    return j.withColumn(out, (F.col(col) - F.col("_mn")) / F.greatest(F.col("_mx") - F.col("_mn"), F.lit(cfg.eps))) \
            .drop("_mn", "_mx")


def group_norm(df: DataFrame, cfg: AdvantageConfig = AdvantageConfig(), col: str = "scaled",
               out: str = "adv") -> DataFrame:
    """ADV-04: per question (v - mean) / max(std_pop, eps); a question with a
    single rollout keeps its value."""
    if not cfg.group_norm:
        return df.withColumn(out, F.col(col))
    q = df.groupBy("step", "qid").agg(F.count(F.lit(1)).alias("_n"), F.avg(col).alias("_mu"), F.stddev_pop(col).alias("_sd"))
    v = F.when(F.col("_n") < 2, F.col(col)).otherwise((F.col(col) - F.col("_mu")) / F.greatest(F.col("_sd"), F.lit(cfg.eps)))
    return join_back(df, q, ["step", "qid"]).withColumn(out, v).drop("_n", "_mu", "_sd")


def group_stats(df: DataFrame, by: str, col: str, cfg: AdvantageConfig = AdvantageConfig(),
                prefix: str = "", state: DataFrame | None = None) -> DataFrame:
    """ADV-03 / ADV-05: per (step, by) mean, population std, count of ``col``
    and of abs(``col``), plus their EMAs across steps (seeded with the first
    batch value, or going on from ``state`` (key, ema_*); decay ``beta_mu`` /
    ``beta_sigma``), all four in one fold."""
    st = df.groupBy("step", F.col(by).alias("key")).agg(
        F.avg(col).alias("mu"), F.stddev_pop(col).alias("sigma"), F.count(F.lit(1)).alias("count"),
        F.avg(F.abs(col)).alias("abs_mu"), F.stddev_pop(F.abs(col)).alias("abs_sigma"))
    emas = [Ema(c, cfg.beta_mu if c.endswith("mu") else cfg.beta_sigma, f"ema_{c}") for c in ("mu", "sigma", "abs_mu", "abs_sigma")]
    st = join_back(st, _fold(st, "key", emas, cfg, state), ["key", "step"])
    st = st.withColumn("kind", F.lit(by))
    if prefix:
        st = st.withColumn("stage", F.lit(prefix))
    return st


def responsibility(df: DataFrame, cfg: AdvantageConfig = AdvantageConfig(), col: str = "adv",
                   stats: DataFrame | None = None) -> DataFrame:
    """ADV-06: responsibility r per rollout from a = abs(A).

    global_norm: sigmoid(beta * (a / mean_step(a) - 1)); z_score:
    sigmoid(beta * (z - delta)) with the task's EMA abs statistics;
    absolute: sigmoid(beta * (a - a0)); no_responsibilities: 1.  ``stats``
    optionally gives the result of :func:`group_stats` by task (z_score).
    """
    a = F.abs(F.col(col))
    if cfg.mode == "no_responsibilities":
        return df.withColumn("r", F.lit(1.0))
    if cfg.mode == "absolute":
        return df.withColumn("r", _sigmoid(cfg.beta_r * (a - cfg.a0)))
    if cfg.mode == "global_norm":
        g = df.groupBy("step").agg(F.avg(F.abs(col)).alias("_gm"))
        j = df.join(g, "step")
        gm = F.greatest(F.coalesce(F.col("_gm"), F.lit(cfg.eps)), F.lit(cfg.eps))
        return j.withColumn("r", _sigmoid(cfg.beta_r * (a / gm - 1.0))).drop("_gm")
    if cfg.mode == "z_score":
        st = (group_stats(df, "task", col, cfg) if stats is None else stats).select(
            "step", F.col("key").alias("task"), "ema_abs_mu", "ema_abs_sigma", "ema_sigma")
        j = join_back(df, st, ["step", "task"])
        mu = F.greatest(F.col("ema_abs_mu"), F.lit(cfg.eps))
        sd = F.greatest(F.when(F.col("ema_abs_sigma") <= 0, F.col("ema_sigma")).otherwise(F.col("ema_abs_sigma")),
                        F.lit(cfg.eps))
        z = (a - mu) / (sd + cfg.eps)
        return j.withColumn("r", _sigmoid(cfg.beta_r * (z - cfg.delta_z))).drop(
            "ema_abs_mu", "ema_abs_sigma", "ema_sigma")
    raise ValueError(f"unknown mode {cfg.mode}")


def task_mass(df: DataFrame, col: str = "adv") -> DataFrame:
    """Per (step, task): signal mass sum(r * |A|), sum(r), rollout count."""
    return df.groupBy("step", "task").agg(
        F.sum(F.col("r") * F.abs(col)).alias("mass"), F.sum("r").alias("sig"),
        F.count(F.lit(1)).alias("cnt"))


def _carried(state: DataFrame | None, column: str, out: str) -> DataFrame | None:
    return None if state is None else state.select("task", F.col(column).alias(out))


def task_density(mass: DataFrame, cfg: AdvantageConfig = AdvantageConfig(),
                 state: DataFrame | None = None) -> DataFrame:
    """ADV-07: rho per (step, task), its EMA (seeded with the first batch
    value, floored at eps) and the step references over tasks present:
    ``log_rho_ref`` (geometric) and ``rho_ref_arith``."""
    if cfg.density == "normalized":
        rb = F.greatest(F.col("mass") / F.greatest(F.col("cnt"), F.lit(1)), F.lit(cfg.eps))
    elif cfg.density == "unnormalized":
        rb = F.greatest(F.col("mass"), F.lit(cfg.eps))
    else:
        raise ValueError(cfg.density)
    m = mass.withColumn("rho_batch", rb)
    e = _fold(m, "task", [Ema("rho_batch", cfg.beta_rho, "rho_ema")], cfg, _carried(state, "rho_prev", "rho_ema"))
    m = join_back(m, e, ["task", "step"]).withColumn("rho_ema", F.greatest(F.col("rho_ema"), F.lit(cfg.eps)))
    ref = m.groupBy("step").agg(F.avg(F.log("rho_ema")).alias("log_rho_ref"),
                                F.avg("rho_ema").alias("rho_ref_arith"))
    return m.join(ref, "step")


def rarity_boost(dens: DataFrame, cfg: AdvantageConfig = AdvantageConfig(), state: DataFrame | None = None) -> DataFrame:
    """ADV-08: k per (step, task); 1 when rarity is off."""
    if not cfg.rarity:
        return dens.withColumn("k", F.lit(1.0))
    d = dens.withColumn("sig_batch", F.greatest(F.col("sig"), F.lit(cfg.eps)))
    e = _fold(d, "task", [Ema("sig_batch", cfg.beta_rho, "sig_ema")], cfg, _carried(state, "sig_prev", "sig_ema"))
    d = join_back(d, e, ["task", "step"])
    ref = d.groupBy("step").agg(F.exp(F.avg(F.log(F.greatest(F.col("sig_ema"), F.lit(cfg.eps))))).alias("sig_ref"))
    d = d.join(ref, "step")
    ratio = F.col("sig_ref") / F.greatest(F.col("sig_ema"), F.lit(cfg.eps))
    excess = F.greatest(F.lit(0.0), ratio - cfg.rare_ratio)
    import math
    log_k = F.least(cfg.eta_k * F.log1p(excess), F.lit(math.log(cfg.k_max)))
    return d.withColumn("k", F.exp(log_k))


def task_scale(dens: DataFrame, cfg: AdvantageConfig = AdvantageConfig(),
               state: DataFrame | None = None) -> DataFrame:
    """ADV-09: task scale per (step, task).

    geom: EMA (seed 0.0) of gamma*(log rho_ref - log rho) + log k, exp, clamp;
    arith: EMA of (rho_ref_arith / rho) * k whose previous value is the
    clamped scale (seeded with the first instantaneous value);
    naive_density: clamp(1 / rho), no EMA on the scale.
    """
    rho = F.greatest(F.col("rho_ema"), F.lit(cfg.eps))
    if cfg.scaling == "geom":
        d = dens.withColumn("inst", cfg.gamma * (F.col("log_rho_ref") - F.log(rho)) + F.log("k"))
        e = _fold(d, "task", [Ema("inst", cfg.beta_logmult, "log_mult_ema", 0.0)], cfg, _carried(state, "scale_prev", "log_mult_ema"))
        d = join_back(d, e, ["task", "step"])
        return d.withColumn("task_scale", _clamp(F.exp("log_mult_ema"), cfg.task_min, cfg.task_max))
    if cfg.scaling == "arith":
        d = dens.withColumn("inst", F.col("rho_ref_arith") / rho * F.col("k"))
        ema = Ema("inst", cfg.beta_logmult, "task_scale", clamp=(cfg.task_min, cfg.task_max))
        e = _fold(d, "task", [ema], cfg, _carried(state, "scale_prev", "task_scale"))
        return join_back(d, e, ["task", "step"])
    if cfg.scaling == "naive_density":
        return dens.withColumn("task_scale", _clamp(1.0 / rho, cfg.task_min, cfg.task_max))
    raise ValueError(cfg.scaling)


def question_scale(df: DataFrame, cfg: AdvantageConfig = AdvantageConfig(), col: str = "adv") -> DataFrame:
    """ADV-10: per (step, qid) scale inside tasks that have >= 2 questions in
    the step; 1 elsewhere or when the hierarchical mixture is off."""
    q = df.groupBy("step", "task", "qid").agg(
        F.greatest(F.sum(F.col("r") * F.abs(col)) / F.count(F.lit(1)), F.lit(cfg.eps)).alias("m"))
    if not cfg.hierarchical:
        return q.select("step", "qid", F.lit(1.0).alias("question_scale"))
    t = q.groupBy("step", "task").agg(F.count(F.lit(1)).alias("nq"), F.avg(F.log("m")).alias("log_mbar"),
                                      F.avg("m").alias("mbar"))
    return q.join(t, ["step", "task"]).select("step", "qid", _question_factor(cfg).alias("question_scale"))


def _question_factor(cfg: AdvantageConfig) -> Column:
    """ADV-10 from a question's mean ``m`` and its task's ``nq``, ``log_mbar``
    and ``mbar`` in the step."""
    if not cfg.hierarchical:
        return F.lit(1.0)
    if cfg.scaling == "geom":
        s = cfg.alpha_roll * F.exp(F.col("log_mbar") - F.log("m"))
    elif cfg.scaling == "arith":
        s = cfg.alpha_roll * F.col("mbar") / F.col("m")
    else:
        s = cfg.alpha_roll / F.col("m")
    return F.when(F.col("nq") >= 2, _clamp(s, cfg.hier_min, cfg.hier_max)).otherwise(F.lit(1.0))


def question_means(df: DataFrame, cfg: AdvantageConfig = AdvantageConfig(), col: str = "adv") -> DataFrame:
    """``step, task, qid`` and ``m``, the mean signal of the question in its task."""
    return df.groupBy("step", "task", "qid").agg(F.greatest(F.avg(F.col("r") * F.abs(col)), F.lit(cfg.eps)).alias("m"))


def task_signals(df: DataFrame, means: DataFrame, col: str = "adv") -> DataFrame:
    """:func:`task_mass` and the question statistics of ADV-10 per (step, task)
    from the rollouts and the result of :func:`question_means`."""
    q = means.groupBy("step", "task").agg(F.count(F.lit(1)).alias("nq"), F.avg(F.log("m")).alias("log_mbar"), F.avg("m").alias("mbar"))
    return join_back(task_mass(df, col), q, ["step", "task"])


def group_relative_advantage(rollouts: DataFrame, cfg: AdvantageConfig = AdvantageConfig(),
                             state: DataFrame | None = None, with_state: bool = False, hold=lambda d: d):
    """ADV-11: the full per-rollout advantage table.

    The rollouts with their signals are written once, since four aggregations and
    the result read them.  ``hold`` is applied to the small tables that are read
    more than once; a caller that runs several actions passes a writer, which cuts
    the plan, too.

    Columns: step, rollout_id, qid, task, dataset, raw, scaled, adv (after
    group normalisation), r, task_scale, question_scale, advantage.
    """
    base = rollouts.select("step", "rollout_id", "qid", "task", "dataset", "token_rewards")
    df = group_norm(minmax_scale(rollout_reward(base), cfg), cfg)
    stats = None
    if cfg.mode == "z_score":
        df = write_once(df, "normed_rollouts")
        init = None if state is None else state.select(F.col("task").alias("key"), *[F.col(c) for c in STAT_STATE])
        stats = hold(group_stats(df, "task", "adv", cfg, state=init))
    df = write_once(responsibility(df.drop("token_rewards"), cfg, stats=stats), "rollout_signals")
    means = hold(question_means(df, cfg))
    dens = hold(task_density(hold(task_signals(df, means)), cfg, state))
    ts_full = hold(task_scale(hold(rarity_boost(dens, cfg, state)) if cfg.rarity else rarity_boost(dens, cfg, state), cfg, state))
    ts = ts_full.select("step", "task", "task_scale", "rho_ema", "log_rho_ref", "nq", "log_mbar", "mbar")
    out = join_back(join_back(df, means, ["step", "task", "qid"]), ts, ["step", "task"])
    out = out.withColumn("question_scale", F.coalesce(_question_factor(cfg), F.lit(1.0)))
    out = out.withColumn("advantage", F.col("adv") * F.col("task_scale") * F.col("question_scale")) \
             .drop("m", "nq", "log_mbar", "mbar")
    if not with_state:
        return out
    carried = "log_mult_ema" if cfg.scaling == "geom" else "task_scale"
    none = F.lit(None).cast("double")
    last = F.max_by(F.struct(F.col("rho_ema").alias("rho_prev"), F.col(carried).alias("scale_prev"),
                             (F.col("sig_ema") if cfg.rarity else none).alias("sig_prev")), F.col("step"))
    new = ts_full.groupBy("task").agg(last.alias("s")).select("task", "s.*")
    if stats is None:
        new = new.select("*", *[none.alias(c) for c in STAT_STATE])
    else:
        st = stats.groupBy(F.col("key").alias("task")).agg(F.max_by(F.struct(*STAT_STATE), F.col("step")).alias("s"))
        new = join_back(new, st.select("task", "s.*"), ["task"])
    if state is not None:
        now = new.select(F.col("task").alias("_t"))
        new = state.select(*new.columns).join(now, F.col("task").eqNullSafe(F.col("_t")), "left_anti").unionByName(new)
    return out, new


def rollout_pos(df: DataFrame) -> DataFrame:
    """SMP-08: ordinal of a rollout inside its question, in rollout order; a
    question with any share of the rollouts is numbered by all tasks."""
    return global_row_number(df, ["step", "qid"], ["rollout_id"], "rollout_pos").withColumn("rollout_pos", F.col("rollout_pos") - 1)


def to_tokens(df: DataFrame, adv: str = "advantage", mask: str = "response_mask") -> DataFrame:
    """ADV-12: scalar advantage broadcast over the response mask."""
    return df.withColumn("token_advantage", F.transform(mask, lambda m: m.cast("double") * F.col(adv)))


def advantage_log(adv: DataFrame, path: str) -> None:
    """ADV-13: write (stage, qid, task, dataset, advantage, r) per step, in files
    that follow the size of the steps."""
    logged = adv.select("step", F.lit("final").alias("stage"), "qid", "task", "dataset", "advantage",
                        F.col("r").alias("responsibility"))
    post = adv.select("step", F.lit("post_grpo").alias("stage"), "qid", "task", "dataset",
                      F.col("adv").alias("advantage"), F.lit(None).cast("double").alias("responsibility"))
    rebalanced(logged.unionByName(post), ["step"]).write.mode("overwrite").partitionBy("step").parquet(path)

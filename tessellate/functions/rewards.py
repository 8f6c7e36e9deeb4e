"""Rule-based response rewards (RWD-01 .. RWD-06).

Pure column expressions over the text functions, so scoring a billion
responses is one narrow projection: no shuffle, no Python.  Cosine terms take
embedding columns (``array<float>``); producing embeddings is the pluggable
UDF of :mod:`tessellate.functions.udf`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as TX

# FIXED VALUES: reward weights and overlong defaults.
FORMAT_WEIGHT = 0.2
V1_SIMILARITY_WEIGHT = 0.5
V2_MAX_RESPONSE_LENGTH = 812
V2_OVERLONG_BUFFER = 128
V2_OVERLONG_FACTOR = 0.75
NORM_EPS = 1e-12  # the per-vector norm floor of the cosine helper


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _dbl(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def dot(a, b) -> Column:
    a, b = _dbl(_c(a)), _dbl(_c(b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    a = _dbl(_c(a))
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a, b) -> Column:
    """Cosine of two vectors, each norm floored at 1e-12 (zero vector -> 0)."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(NORM_EPS)) * F.greatest(norm(b), F.lit(NORM_EPS)))


def cosine_clipped(a, b) -> Column:
    """RWD-02: max(0, min(1, cos))."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b)))


def cosine_scaled(a, b) -> Column:
    """RWD-03: (cos + 1) / 2."""
    return (cosine(a, b) + 1.0) / 2.0


def overlong_penalty(length, max_len=V2_MAX_RESPONSE_LENGTH, buffer=V2_OVERLONG_BUFFER) -> Column:
    """RWD-04: 0 up to max-buffer, linear down to -1 at max, -1 beyond."""
    length = _c(length)
    max_len = F.lit(max_len) if isinstance(max_len, int) else max_len
    buffer = F.lit(buffer) if isinstance(buffer, int) else buffer
    expected = max_len - buffer
    return (F.when(length <= expected, F.lit(0.0))
            .when(length <= max_len, (expected - length).cast("double") / buffer.cast("double"))
            .otherwise(F.lit(-1.0)))


def reward_v1(response, truth, emb_pred, emb_truth) -> Column:
    """RWD-05: exact + 0.2 * format + 0.5 * cosine_clipped (range 0..1.7).

    Returns struct(score, standard_score, format_score, similarity_score).
    The label is the boxed/bracket/answer extraction of the tag-tightened
    response, lower-cased but not stripped; the truth is lower-cased.
    """
    full = TX.tighten_tags(_c(response))
    label = F.lower(TX.boxed_reward(full))
    exact = F.when(label == F.lower(_c(truth)), F.lit(1.0)).otherwise(F.lit(0.0))
    fmt = TX.format_ok(full)
    sim = cosine_clipped(emb_pred, emb_truth)
    return F.struct((exact + FORMAT_WEIGHT * fmt + V1_SIMILARITY_WEIGHT * sim).alias("score"),
                    exact.alias("standard_score"), fmt.alias("format_score"), sim.alias("similarity_score"))


def reward_v2(response, truth, task, emb_pred=None, emb_truth=None, length=None,
              max_len: int | None = V2_MAX_RESPONSE_LENGTH, buffer: int = V2_OVERLONG_BUFFER,
              factor: float = V2_OVERLONG_FACTOR) -> Column:
    """RWD-06: task-aware reward.

    cls: 0.8 * exact + 0.2 * format; qa: 0.8 * cosine_scaled + 0.2 * format;
    then + factor * overlong penalty (disabled when ``max_len`` is None).
    Length defaults to the character length of the raw response; a null
    response counts as ''; a null task is cls.  Returns the score record
    struct(score, standard_score, format_score, similarity_score,
    overlong_score, task_type).
    """
    resp = F.coalesce(_c(response), F.lit(""))
    full = TX.tighten_tags(resp)
    label = F.lower(TX.py_strip(TX.boxed_reward(full)))
    gold = F.lower(TX.py_strip(F.coalesce(_c(truth), F.lit(""))))
    ttype = TX.task_type(task if task is not None else F.lit(None).cast("string"))
    fmt = TX.format_ok(full)
    exact = F.when(label == gold, F.lit(1.0)).otherwise(F.lit(0.0))
    if emb_pred is not None:
        sim = cosine_scaled(emb_pred, emb_truth)
    else:
        sim = F.lit(None).cast("double")
    is_cls = ttype == "cls"
    std = F.when(is_cls, exact).otherwise(F.lit(0.0))
    simv = F.when(is_cls, F.lit(0.0)).otherwise(sim)
    base = F.when(is_cls, (1 - FORMAT_WEIGHT) * exact + FORMAT_WEIGHT * fmt) \
            .otherwise((1 - FORMAT_WEIGHT) * sim + FORMAT_WEIGHT * fmt)
    if max_len is None:
        over = F.lit(0.0)
    else:
        ln = F.length(resp) if length is None else _c(length)
        over = overlong_penalty(ln, max_len, buffer)
    return F.struct((base + F.lit(factor) * over).alias("score"), std.alias("standard_score"),
                    fmt.alias("format_score"), simv.alias("similarity_score"),
                    over.alias("overlong_score"), ttype.alias("task_type"))

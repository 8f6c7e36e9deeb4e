"""Classification and generation metrics (MET-01 .. MET-18).

Input is a prediction table with one row per sample: ``(keys..., y_true,
y_pred)``.  Everything starts with one hash aggregation to *confusion cells*
``(keys, y_true, y_pred, n)``.  Spark runs it as partial (map-side) plus final
aggregation, so the shuffle carries at most ``datasets x classes^2`` rows per
map task no matter how many predictions there are, and a hot dataset holding a
third of all rows is combined map-side before it is shuffled.  Every metric
after that reads the tiny cell table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scheme


def safe_div(num: Column, den: Column) -> Column:
    """x / y, or 0.0 when y <= 0 (ANSI mode would raise on a zero divisor)."""
    return F.when(den > 0, num / F.when(den > 0, den)).otherwise(F.lit(0.0))


def confusion_cells(preds: DataFrame, keys: Sequence[str] = ("dataset",),
                    y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """MET-13: one row per (keys, y_true, y_pred) with its count ``n``."""
    return (preds.groupBy(*keys, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def class_counts_from_cells(cells: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """MET-01 from confusion cells.

    Classes are the ground-truth classes of each key group only.  A cell adds
    ``n`` to the support (and to tp on the diagonal) of its true class, and
    ``n`` to the fp of its predicted class when that differs.  The fp side is
    restricted to ground-truth classes by the final ``support > 0`` filter, so
    a prediction outside the class set is an fn and never an fp.
    """
    keys = list(keys)
    diag = F.col("y_true") == F.col("y_pred")
    contrib = F.array(
        F.struct(F.col("y_true").alias("cls"), F.col("n").alias("support"),
                 F.when(diag, F.col("n")).otherwise(F.lit(0)).alias("tp"), F.lit(0).cast("bigint").alias("fp")),
        F.struct(F.col("y_pred").alias("cls"), F.lit(0).cast("bigint").alias("support"),
                 F.lit(0).cast("bigint").alias("tp"), F.when(diag, F.lit(0)).otherwise(F.col("n")).alias("fp")),
    )
    out = (cells.select(*keys, F.inline(contrib))
           .groupBy(*keys, "cls")
           .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("support").alias("support"))
           .filter(F.col("support") > 0))
    return out.withColumn("fn", F.col("support") - F.col("tp"))


def class_counts(preds: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """MET-01: per (keys, class) tp, fp, fn, support."""
    return class_counts_from_cells(confusion_cells(preds, keys), keys)


def class_prf(counts: DataFrame) -> DataFrame:
    """MET-02: precision, recall, f1, accuracy (= recall); x/0 = 0."""
    p = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumns({"precision": p, "recall": r})
    return out.withColumns({"f1": safe_div(2 * F.col("precision") * F.col("recall"),
                                           F.col("precision") + F.col("recall")),
                            "accuracy": F.col("recall")})


_KINDS = ("precision", "recall", "f1", "accuracy")


def set_metrics(prf: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """MET-03/04/05: macro, support-weighted and micro metrics per key group."""
    keys = list(keys)
    aggs = [F.avg(k).alias(f"macro_{k}") for k in _KINDS]
    aggs += [F.sum(F.col(k) * F.col("support")).alias(f"_w_{k}") for k in _KINDS]
    aggs += [F.sum("tp").alias("_tp"), F.sum("fp").alias("_fp"), F.sum("fn").alias("_fn"),
             F.sum("support").alias("_n")]
    g = prf.groupBy(*keys).agg(*aggs) if keys else prf.agg(*aggs)
    first = {f"weighted_{k}": safe_div(F.col(f"_w_{k}"), F.col("_n")) for k in _KINDS}
    first["micro_precision"] = safe_div(F.col("_tp"), F.col("_tp") + F.col("_fp"))
    first["micro_recall"] = safe_div(F.col("_tp"), F.col("_tp") + F.col("_fn"))
    first["micro_accuracy"] = safe_div(F.col("_tp"), F.col("_n"))
    g = g.withColumns(first).withColumn(
        "micro_f1", safe_div(2 * F.col("micro_precision") * F.col("micro_recall"),
                             F.col("micro_precision") + F.col("micro_recall")))
    return g.drop(*[c for c in g.columns if c.startswith("_")])


SET_METRIC_NAMES = ([f"macro_{k}" for k in _KINDS] + [f"weighted_{k}" for k in _KINDS]
                    + [f"micro_{k}" for k in _KINDS])


def to_long(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric columns -> (keys, metric, value) rows (``unpivot``)."""
    return wide.unpivot(list(keys), list(metrics), "metric", "value")


def metrics_by_dataset(preds: DataFrame, label_names: DataFrame | None = None) -> DataFrame:
    """MET-06: per-dataset set metrics, per-class f1, and the overall set.

    Output rows ``(scope, metric, value)``: ``scope`` is the dataset name or
    ``__all__`` for the pooled set.  Class f1 is keyed by class index
    (``class_f1/<index>``), or with ``label_names`` (global_index, label) by
    class name (``<name>/class_f1``; the index where a class has no name).
    The pooled class set is computed from the same cells (its fp counts need
    the pooled ground-truth class set, which is not the union of per-dataset
    fp counts).
    """
    cells = confusion_cells(preds, ["dataset"])
    per_ds = class_prf(class_counts_from_cells(cells, ["dataset"]))
    pooled_cells = cells.groupBy("y_true", "y_pred").agg(F.sum("n").alias("n"))
    pooled = class_prf(class_counts_from_cells(pooled_cells, []))
    ds_set = to_long(set_metrics(per_ds, ["dataset"]), ["dataset"], SET_METRIC_NAMES)
    all_set = to_long(set_metrics(pooled, []).withColumn("dataset", F.lit("__all__")),
                      ["dataset"], SET_METRIC_NAMES)
    if label_names is None:
        name = F.concat(F.lit("class_f1/"), F.col("cls").cast("string"))
    else:
        names = label_names.select(F.col("global_index").alias("_gi"), F.col("label").alias("_name"))
        per_ds = per_ds.join(names, F.col("cls") == F.col("_gi"), "left")
        name = F.concat(F.coalesce(F.col("_name"), F.col("cls").cast("string")), F.lit("/class_f1"))
    cls_f1 = per_ds.select("dataset", name.alias("metric"), F.col("f1").alias("value"))
    out = ds_set.unionByName(all_set).unionByName(cls_f1)
    return out.withColumnRenamed("dataset", "scope")


# ---------------------------------------------------------------------------
# Sentiment (MET-07/08/09) and emotion (MET-10)
# ---------------------------------------------------------------------------

def sentiment_position(df: DataFrame, col: str, positions: DataFrame, out: str) -> DataFrame:
    """MET-07: global index -> canonical sentiment position 0..6, else -1.

    ``positions`` is the 7-row broadcast dimension of
    :func:`tessellate.scheme.sentiment_positions`.
    """
    p = positions.select(F.col("global_index").alias("_gi"), F.col("position").alias(out))
    j = df.join(F.broadcast(p), df[col] == p["_gi"], "left").drop("_gi")
    return j.withColumn(out, F.coalesce(F.col(out), F.lit(-1).cast("bigint")))


def collapse(pos: Column, k: Column | int) -> Column:
    """MET-08: collapse a 0..6 position to k classes; outside -> -1.

    k=7 identity; k=5 {0},{1,2},{3},{4,5},{6}; k=3 neg/neu/pos; k=2 neg 0,
    pos 1, neutral -1 (the code's rule, not the docstring's).
    """
    k = F.lit(k) if isinstance(k, int) else k
    valid = (pos >= 0) & (pos <= 6)
    c5 = (F.when(pos == 0, 0).when(pos.isin(1, 2), 1).when(pos == 3, 2)
          .when(pos.isin(4, 5), 3).when(pos == 6, 4).otherwise(-1))
    c3 = F.when(pos.isin(0, 1, 2), 0).when(pos == 3, 1).when(pos.isin(4, 5, 6), 2).otherwise(-1)
    c2 = F.when(pos.isin(4, 5, 6), 1).when(pos.isin(0, 1, 2), 0).otherwise(-1)
    return (F.when(k == 7, F.when(valid, pos).otherwise(pos))
            .when(k == 5, c5).when(k == 3, c3).when(k == 2, c2)).cast("bigint")


def sentiment_metrics(preds: DataFrame, positions: DataFrame, domains: DataFrame) -> DataFrame:
    """MET-09: ACCk and F1wk for k in 7, 5, 3, 2 per sentiment dataset.

    Rows with a sentiment ground truth only.  k=2 drops neutral ground truth
    and reports 0.0 when nothing is left; a dataset without sentiment rows
    gets no metrics.  Output ``(dataset, metric, value)``.
    """
    senti_ds = domains.filter(F.col("domain") == "sentiment_intensity").select("dataset")
    p = preds.join(F.broadcast(senti_ds), "dataset", "left_semi")
    p = sentiment_position(p, "y_true", positions, "t_pos").filter(F.col("t_pos") >= 0)
    p = sentiment_position(p, "y_pred", positions, "p_pos")
    # collapse on the small cell table, not per row
    cells = confusion_cells(p, ["dataset"], "t_pos", "p_pos")
    ks = cells.select("dataset", "y_true", "y_pred", "n",
                      F.explode(F.array(*[F.lit(k) for k in (7, 5, 3, 2)])).alias("k"))
    ks = ks.filter(~((F.col("k") == 2) & (F.col("y_true") == 3)))
    ks = ks.select("dataset", "k", collapse(F.col("y_true"), F.col("k")).alias("y_true"),
                   collapse(F.col("y_pred"), F.col("k")).alias("y_pred"), "n")
    ks = ks.groupBy("dataset", "k", "y_true", "y_pred").agg(F.sum("n").alias("n"))
    sm = set_metrics(class_prf(class_counts_from_cells(ks, ["dataset", "k"])), ["dataset", "k"])
    sm = sm.select("dataset", "k", F.col("micro_accuracy").alias("acc"), F.col("weighted_f1").alias("f1w"))
    # every dataset with sentiment rows reports all four k; k=2 may be empty -> 0.0
    present = cells.select("dataset").distinct().select(
        "dataset", F.explode(F.array(*[F.lit(k) for k in (7, 5, 3, 2)])).alias("k"))
    full = present.join(sm, ["dataset", "k"], "left").fillna(0.0, ["acc", "f1w"])
    return full.select("dataset", F.inline(F.array(
        F.struct(F.concat(F.lit("ACC"), F.col("k").cast("string")).alias("metric"), F.col("acc").alias("value")),
        F.struct(F.concat(F.lit("F1w"), F.col("k").cast("string")).alias("metric"), F.col("f1w").alias("value")),
    )))


def emotion_weighted_accuracy(preds: DataFrame, domains: DataFrame,
                              label_names: DataFrame | None = None) -> DataFrame:
    """MET-10: per ground-truth class 0.5*(TP/P + TN/N), and the class mean.

    Only emotion-domain datasets.  TN = n - tp - fp - fn per class; N = n - P.
    Output ``(dataset, metric, value)``; per-class metric names use the class
    label, or the index as text when the class has no name.
    """
    emo_ds = domains.filter(F.col("domain") == "emotion").select("dataset")
    p = preds.join(F.broadcast(emo_ds), "dataset", "left_semi")
    cells = confusion_cells(p, ["dataset"])
    counts = class_counts_from_cells(cells, ["dataset"])
    totals = cells.groupBy("dataset").agg(F.sum("n").alias("n_all"))
    c = counts.join(totals, "dataset")
    tn = F.col("n_all") - F.col("tp") - F.col("fp") - F.col("fn")
    neg = F.col("n_all") - F.col("support")
    c = c.withColumn("wa", 0.5 * (safe_div(F.col("tp"), F.col("support")) + safe_div(tn, neg)))
    if label_names is not None:
        names = label_names.select(F.col("global_index").alias("cls"), F.col("label").alias("_name"))
        c = c.join(F.broadcast(names), "cls", "left")
    else:
        c = c.withColumn("_name", F.lit(None).cast("string"))
    per_class = c.select("dataset", F.concat(F.coalesce(F.col("_name"), F.col("cls").cast("string")),
                                             F.lit("/emotion_weighted_accuracy")).alias("metric"),
                         F.col("wa").alias("value"))
    mean = c.groupBy("dataset").agg(F.avg("wa").alias("value")).select(
        "dataset", F.lit("emotion_weighted_accuracy_mean").alias("metric"), "value")
    return per_class.unionByName(mean)


def flat_report(preds: DataFrame, label_names: DataFrame, positions: DataFrame, domains: DataFrame) -> DataFrame:
    """MET-06 with MET-09 and MET-10 as one flat result (key, value): the pooled
    set under the bare metric name, everything else under ``dataset/metric``."""
    base = metrics_by_dataset(preds, label_names)
    flat = base.select(F.when(F.col("scope") == "__all__", F.col("metric"))
                       .otherwise(F.concat_ws("/", "scope", "metric")).alias("key"), "value")
    for more in (sentiment_metrics(preds, positions, domains), emotion_weighted_accuracy(preds, domains, label_names)):
        flat = flat.unionByName(more.select(F.concat_ws("/", "dataset", "metric").alias("key"), "value"))
    return flat


# ---------------------------------------------------------------------------
# Generation, judge, loss, simple accuracy
# ---------------------------------------------------------------------------

def generation_accuracy(df: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """MET-11: exact-match accuracy overall, per dataset, per task, plus the
    unweighted mean over datasets.  Output ``(scope, key, correct, total,
    accuracy)``; empty input gives accuracy 0 through the guard.
    """
    hit = F.when(F.col(pred) == F.col(gold), 1).otherwise(0)
    base = df.select(F.col("dataset"), F.coalesce(F.col("task"), F.lit("")).alias("task"), hit.alias("hit"))
    # one pass: grouping sets over (dataset) and (task) plus the grand total
    g = base.groupingSets([["dataset"], ["task"], []], "dataset", "task").agg(
        F.sum("hit").cast("bigint").alias("correct"), F.count(F.lit(1)).alias("total"),
        F.grouping_id().alias("_gid"))
    scope = F.when(F.col("_gid") == 1, "dataset").when(F.col("_gid") == 2, "task").otherwise("overall")
    key = F.when(F.col("_gid") == 1, F.col("dataset")).when(F.col("_gid") == 2, F.col("task")).otherwise(F.lit(""))
    g = g.select(scope.alias("scope"), key.alias("key"), "correct", "total",
                 safe_div(F.col("correct"), F.col("total")).alias("accuracy"))
    mean = (g.filter(F.col("scope") == "dataset")
            .agg(F.avg("accuracy").alias("accuracy"), F.sum("correct").cast("bigint").alias("correct"),
                 F.sum("total").cast("bigint").alias("total"))
            .select(F.lit("dataset_mean").alias("scope"), F.lit("").alias("key"), "correct", "total",
                    F.coalesce(F.col("accuracy"), F.lit(0.0)).alias("accuracy")))
    return g.unionByName(mean)


def judge_accuracy(graded: DataFrame) -> DataFrame:
    """MET-12: per-dataset and overall accuracy/total/correct of judge verdicts."""
    base = graded.select("dataset", F.col("correct").cast("int").alias("c"))
    g = base.rollup("dataset").agg(F.sum("c").cast("bigint").alias("correct"),
                                   F.count(F.lit(1)).alias("total"), F.grouping_id().alias("_gid"))
    return g.select(F.when(F.col("_gid") == 1, F.lit("__all__")).otherwise(F.col("dataset")).alias("dataset"),
                    "correct", "total", safe_div(F.col("correct"), F.col("total")).alias("accuracy"))


def weighted_loss(df: DataFrame, keys: Sequence[str], loss: str, weight: str) -> DataFrame:
    """MET-14: sum(loss * w) / max(sum(w), 1), the true weighted mean."""
    return df.groupBy(*keys).agg(
        (F.sum(F.col(loss) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1))).alias("weighted_loss"))


def accuracy(df: DataFrame, keys: Sequence[str], pred: str = "y_pred", true: str = "y_true") -> DataFrame:
    """MET-15: matches / max(1, n)."""
    return df.groupBy(*keys).agg(
        (F.sum(F.when(F.col(pred) == F.col(true), 1).otherwise(0)) / F.greatest(F.count(F.lit(1)), F.lit(1)))
        .alias("accuracy"))


def label_names(spark) -> DataFrame:
    """LBL-10 dimension (global_index, label)."""
    return scheme.global_classes(spark).select("global_index", "label")


def signature_counts(samples: DataFrame, sig: str = "modality_signature") -> DataFrame:
    """MET-18: rows per modality signature (index build)."""
    return samples.groupBy(sig).agg(F.count(F.lit(1)).alias("n"))

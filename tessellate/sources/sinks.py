"""Sinks (SRC-09 .. SRC-13).  Rows are written as rows: partitioned directories,
so writing is as parallel as the data.  Before a partitioned write the rows are
rebalanced on the partition columns: a large value is split over tasks of the
advisory size, small ones share a task, so the number of files follows the size
of the data and not tasks x values.  The document layouts of SRC-09 are for the
tools that read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scheme


def rebalanced(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` dealt by ``columns`` in partitions of about the advisory size."""
    return df.hint("rebalance", *columns)


def write_predictions(df: DataFrame, path: str, layout: str = "rows") -> None:
    """SRC-09: predictions (step, dataset, pred, gold, ..), one directory per step.

    ``rows``: all columns, a record a line.  ``arrays``: one document a step with
    the parallel lists predictions, ground_truths, datasets.  ``dump``: the same
    with tasks (of column task) and overall_accuracy, the share of rows whose
    pred is gold.  ``records``: one document a step, a list of (dataset, pred,
    gold).  Documents are one record by construction, so a step's predictions
    (an evaluation set) are gathered for them, in the order of ``row_id`` if there
    is such a column; the row layout has no such limit."""
    if layout == "rows":
        rebalanced(df, ["step"]).write.mode("overwrite").partitionBy("step").json(path)
        return
    if layout not in ("arrays", "dump", "records"):
        raise ValueError(f"unknown layout {layout}")
    at = F.col("row_id") if "row_id" in df.columns else F.lit(0).alias("row_id")
    task = [F.col("task")] if layout == "dump" else []
    docs = df.groupBy("step").agg(F.array_sort(F.collect_list(F.struct(at, "dataset", "pred", "gold", *task))).alias("r"),
                                  F.avg(F.when(F.col("pred") == F.col("gold"), 1.0).otherwise(0.0)).alias("overall_accuracy"))
    if layout == "records":
        cols = [F.transform("r", lambda x: F.struct(x["dataset"].alias("dataset"), x["pred"].alias("pred"), x["gold"].alias("gold"))).alias("records")]
        # the list itself is the document
        text = docs.select("step", F.to_json(*cols).alias("value"))
        rebalanced(text, ["step"]).write.mode("overwrite").partitionBy("step").text(path)
        return
    cols = [F.col("r.pred").alias("predictions"), F.col("r.gold").alias("ground_truths"), F.col("r.dataset").alias("datasets")]
    if layout == "dump":
        cols += [F.col("r.task").alias("tasks"), F.col("step").alias("global_step"), F.col("overall_accuracy")]
    rebalanced(docs.select("step", *cols), ["step"]).write.mode("overwrite").partitionBy("step").json(path)


def write_label_scheme(spark: SparkSession, mapping: DataFrame, pairs: DataFrame, path: str) -> None:
    """SRC-10: mapping, class list, per-dataset labels and domain tables."""
    base = path.rstrip("/")
    mapping.select("key", "dataset", "answer", "domain", "unified_label", "global_index", "status") \
        .write.mode("overwrite").parquet(f"{base}/label_mapping")
    scheme.global_classes(spark).write.mode("overwrite").parquet(f"{base}/global_classes")
    pairs.groupBy("dataset").agg(F.sort_array(F.collect_set("answer")).alias("labels")) \
        .write.mode("overwrite").parquet(f"{base}/dataset_labels")
    scheme.dataset_domains(spark).write.mode("overwrite").parquet(f"{base}/dataset_domain")


def write_graded(df: DataFrame, path: str) -> None:
    """SRC-11: graded rows with verdict and explanation."""
    df.write.mode("overwrite").json(path)


def export_by_dataset(df: DataFrame, path: str) -> None:
    """SRC-12: one file set per dataset and split."""
    rebalanced(df, ["dataset", "split"]).write.mode("overwrite").partitionBy("dataset", "split").parquet(path)


def metrics_long(keys: DataFrame, split: str, key: str = "key") -> DataFrame:
    """SRC-13: split ``dataset/metric`` at the first slash; the logged key is
    prefixed with the split name unless it already is."""
    k = F.col(key)
    return keys.select(
        k.alias("key"),
        F.regexp_extract(k, r"^([^/]*)", 1).alias("scope"),
        F.when(k.contains("/"), F.regexp_extract(k, r"^[^/]*/(.*)$", 1)).otherwise(F.lit("")).alias("metric"),
        F.when(k.startswith(split + "/"), k).otherwise(F.concat(F.lit(split + "/"), k)).alias("prefixed"))

"""Structured Streaming forms of the stateful operators (STR-02, STR-03).

STR-02 has two parts, since the step-level reference density mixes all tasks of
a step and so needs whole steps, while a source hands them out in parts:

* :func:`whole_steps` keeps the rows of an unfinished step in keyed list state
  (by step and, if wanted, shards of it) and hands a step on in one micro-batch,
  as soon as it has its known number of rows, or when the watermark, which is
  made of the steps themselves, says that a later step has come.  So the
  micro-batches may cut the steps anywhere.
* ``foreachBatch`` runs the batch operator on the finished steps with the
  per-task state (density, scale, rarity and z-score averages) of the version
  written before, and writes the advantages and the next state version, both
  keyed by batch id.  A replayed batch id overwrites its own output and reads
  the version written before it, so recovery after a lost executor or a
  restarted query is idempotent.  Tables in between that are read twice are
  written: planning the whole operator at once, or with cached parts, takes longer
  than that for all but the largest batches.

Rows of a step that has been handed on are late: the watermark drops them (the
query's progress counts them), unless ``patience`` allows for steps so much out
of order; a step that finishes twice by its number of rows is an error.

STR-03: cumulative confusion cells per dataset as predictions arrive
(streaming aggregation with Spark's state store), written as a table version
per batch; metrics from the cells.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import advantage as A
from ..operators import metrics as M
from ..session import write_once
from .ema_stream import rocksdb

STATE_SCHEMA = ("task string, rho_prev double, scale_prev double, sig_prev double, "
                + ", ".join(f"{c} double" for c in A.STAT_STATE) + ", last_step bigint")


def latest_version(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """The largest batch id (below ``before``) that has a finished version in
    ``path``; None if there is none or no such folder.  Only names are listed."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    done = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batch_id=*/_SUCCESS")) or []
    ids = [int(str(s.getPath().getParent().getName()).split("=")[1]) for s in done]
    return max((i for i in ids if before is None or i < before), default=None)


def read_version(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def _write_version(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


#: Seconds of the time axis that a step stands for: whole steps, with room for
#: a watermark between two of them.
STEP_SECONDS = 10
_ROW = ("rollout_id", "qid", "task", "dataset", "raw")
#: Rows handed on at a time when a step is finished.
CHUNK = 10_000


class StepBuffer(StatefulProcessor):
    """Keeps the rows of one step (of a shard of it) until it is finished."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "rollout_id string, qid string, task string, dataset string, raw double")
        self.seen = handle.getValueState("seen", "n bigint, size bigint")

    def handleInputRows(self, key, rows, timerValues):
        n, size = self.seen.get() if self.seen.exists() else (0, None)
        if not n:
            self.handle.registerTimer(self._end(key))
        for pdf in rows:
            known = pdf["size"].dropna()
            size = int(known.iloc[0]) if len(known) else size
            n += len(pdf)
            part = pdf[list(_ROW)]
            self.rows.appendList(list(part.astype(object).where(part.notna(), None).itertuples(index=False, name=None)))
        if size is not None and n > size:
            raise ValueError(f"step {key[0]} has more than its {size} rows")
        self.seen.update((n, size))
        if n == size:
            self.handle.deleteTimer(self._end(key))
            yield from self._release(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._release(key)

    def _release(self, key):
        chunk = []
        for row in self.rows.get():
            chunk.append(row)
            if len(chunk) == CHUNK:
                yield self._frame(key, chunk)
                chunk = []
        if chunk:
            yield self._frame(key, chunk)
        self.rows.clear()
        self.seen.clear()

    @staticmethod
    def _frame(key, chunk):
        pdf = pd.DataFrame(chunk, columns=list(_ROW))
        pdf.insert(0, "step", int(key[0]))
        return pdf

    @staticmethod
    def _end(key):
        return int(key[0]) * STEP_SECONDS * 1000 + 1

    def close(self) -> None:
        pass


def whole_steps(source: DataFrame, size: str | None = None, shards: int = 1, patience: int = 0) -> DataFrame:
    """The rollouts of ``source`` with their summed reward, each step in one
    micro-batch.  ``size`` names a column with the number of rows of the step
    (steps then arrive in order; one that lacks rows goes on with the rows it has
    when later steps come); without it a step waits for one that is more than
    ``patience`` steps later, and may be spread over ``shards`` tasks."""
    if size is not None and shards != 1:
        raise ValueError("the rows of a step are counted together: shards = 1")
    text = lambda c: F.col(c).cast("string").alias(c)  # noqa: E731  (beside a null, pandas would make ids floats)
    d = A.rollout_reward(source).select(
        F.timestamp_seconds(F.col("step") * STEP_SECONDS).alias("_at"), F.col("step").cast("bigint").alias("step"),
        F.pmod(F.xxhash64("rollout_id"), F.lit(shards)).alias("_shard"), *[text(c) for c in _ROW[:4]], "raw",
        (F.lit(None) if size is None else F.col(size)).cast("bigint").alias("size"))
    d = d.withWatermark("_at", f"{patience * STEP_SECONDS + STEP_SECONDS // 2} seconds")
    kinds = "step bigint, rollout_id string, qid string, task string, dataset string, raw double"
    out = d.groupBy("step", "_shard").transformWithStateInPandas(StepBuffer(), kinds, "append", "EventTime")
    kind = {f.name: f.dataType for f in source.schema.fields}
    return out.select("step", *[F.col(c).cast(kind[c]).alias(c) for c in _ROW[:4]], F.array("raw").alias("token_rewards"))


def advantage_stream(spark: SparkSession, source: DataFrame, out_dir: str, state_dir: str,
                     checkpoint: str, cfg: A.AdvantageConfig = A.AdvantageConfig(), trigger_once: bool = True,
                     size: str | None = None, shards: int = 1, patience: int = 0):
    """STR-02: start the streaming advantage job; returns the query handle.
    ``size``, ``shards`` and ``patience`` are those of :func:`whole_steps`."""

    def run(batch: DataFrame, batch_id: int):
        _advance(batch, batch_id, out_dir, state_dir, cfg)

    w = whole_steps(source, size, shards, patience).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    with rocksdb(spark, timers=size is None):
        return w.start()


def _advance(batch: DataFrame, batch_id: int, out_dir: str, state_dir: str, cfg: A.AdvantageConfig) -> None:
    """Advantages of the finished steps of a micro-batch, and the state after it."""
    spark = batch.sparkSession
    hold = lambda d: write_once(d, "advantage_batch")
    last = latest_version(spark, state_dir, before=batch_id)
    if last is None and batch_id > 0:
        raise ValueError(f"no state before batch {batch_id} in {state_dir}")
    batch = hold(batch)  # taken from the source once
    first, newest = batch.agg(F.min("step"), F.max("step")).first()
    state = None if last is None else read_version(spark, state_dir, last, STATE_SCHEMA)
    if first is None:  # no step is finished: the state goes on
        _write_version(spark.createDataFrame([], STATE_SCHEMA) if state is None else state, state_dir, batch_id)
        return
    if state is not None:
        seen = state.agg(F.max("last_step")).first()[0]
        if seen is not None and first <= seen:
            raise ValueError(f"step {first} of batch {batch_id} is not later than step {seen}: steps must come whole and in order")
    adv, new_state = A.group_relative_advantage(batch, cfg, state, with_state=True, hold=hold)
    _write_version(adv, out_dir, batch_id)
    _write_version(new_state.withColumn("last_step", F.lit(newest).cast("bigint")), state_dir, batch_id)


CELL_SCHEMA = "dataset string, y_true bigint, y_pred bigint, n bigint"


def metric_stream(source: DataFrame, table_dir: str, checkpoint: str):
    """STR-03: running confusion cells in complete mode (bounded by datasets
    x classes^2), a version of the table ``table_dir`` per batch; returns the
    query handle.  Read them with :func:`current_cells`."""
    cells = source.groupBy("dataset", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))

    def run(batch: DataFrame, batch_id: int):
        _write_version(batch.coalesce(1), table_dir, batch_id)

    return (cells.writeStream.outputMode("complete").foreachBatch(run)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_cells(spark: SparkSession, table_dir: str) -> DataFrame:
    """The newest version of the cells of :func:`metric_stream`."""
    last = latest_version(spark, table_dir)
    if last is None:
        return spark.createDataFrame([], CELL_SCHEMA)
    return read_version(spark, table_dir, last, CELL_SCHEMA)


def cells_to_metrics(cells: DataFrame) -> DataFrame:
    prf = M.class_prf(M.class_counts_from_cells(cells, ["dataset"]))
    return M.set_metrics(prf, ["dataset"])

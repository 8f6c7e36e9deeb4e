"""STR-01 as a stream: moving averages in keyed state.

Each key keeps its last averages and the last step folded in a state store
(RocksDB, so state may exceed memory and outlives restarts through the query's
checkpoint).  A key absent from a micro-batch, or from a thousand, keeps them.
Rows of a key within a micro-batch are folded in the order of their steps, so
the result does not depend on how the input is cut into micro-batches as long as
the steps of a key arrive in order; a step that is not later than the last one
folded is an error, since its average can no longer be right.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .ema import Ema

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark, timers: bool = False):
    """Queries started inside keep their state in RocksDB, as keyed state needs;
    they run micro-batches without data only where ``timers`` wait for these."""
    before = {k: spark.conf.get(k) for k in (_PROVIDER, _NO_DATA)}
    spark.conf.set(_PROVIDER, ROCKSDB)
    spark.conf.set(_NO_DATA, str(timers).lower())
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class EmaProcessor(StatefulProcessor):
    """Folds the steps of one key into its stored averages."""

    def __init__(self, keys: Sequence[str], order: str, emas: Sequence[Ema]):
        self.keys, self.order, self.emas = list(keys), order, list(emas)

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"p{i} double" for i in range(len(self.emas)))
        self.state = handle.getValueState("averages", f"last bigint, {fields}")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        held = self.state.get() if self.state.exists() else None
        last, prev = (held[0], list(held[1:])) if held else (None, [None] * len(self.emas))
        steps = [int(s) for s in pdf[self.order]]
        if (last is not None and steps[0] <= last) or len(set(steps)) < len(steps):
            raise ValueError(f"step {steps[0]} of {key} is not later than step {last}, or comes twice: the steps of a key must come in order")
        out = [[] for _ in self.emas]
        for i, m in enumerate(self.emas):
            x = prev[i]
            for v in pdf[m.value]:
                v = None if pd.isna(v) else float(v)
                x = _step(m, x, v)
                out[i].append(x)
            prev[i] = x
        self.state.update((steps[-1], *prev))
        cols = {k: [v] * len(steps) for k, v in zip(self.keys, key)}
        cols |= {self.order: steps, **{m.out: pd.Series(out[i], dtype="float64") for i, m in enumerate(self.emas)}}
        yield pd.DataFrame(cols)

    def close(self) -> None:
        pass


def _step(m: Ema, x: float | None, v: float | None) -> float | None:
    """As :meth:`Ema.step`: a null value leaves no state."""
    if v is None:
        return None
    if x is None:
        x = v if m.seed == "first" else float(m.seed)
    x = m.beta * x + (1.0 - m.beta) * v
    return x if m.clamp is None else max(m.clamp[0], min(m.clamp[1], x))


def ema_stream(source: DataFrame, keys: Sequence[str], order: str, emas: Sequence[Ema]) -> DataFrame:
    """The streaming rows ``keys, order`` and the averages after each step.  The
    query has to be started inside :func:`rocksdb`."""
    keys = list(keys)
    d = source.select(*keys, F.col(order).cast("bigint").alias(order), *dict.fromkeys(m.value for m in emas))
    kinds = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    out = f"{kinds}, `{order}` bigint, " + ", ".join(f"`{m.out}` double" for m in emas)
    return d.groupBy(*keys).transformWithStateInPandas(EmaProcessor(keys, order, emas), out, "append", "None")


def write_ema_stream(source: DataFrame, keys: Sequence[str], order: str, emas: Sequence[Ema], path: str, checkpoint: str):
    """Start the query into the Parquet table ``path`` (exactly once); returns its handle."""
    with rocksdb(source.sparkSession):
        return (ema_stream(source, keys, order, emas).writeStream.format("parquet").outputMode("append")
                .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

"""Pluggable Python hooks (UDF-01, UDF-02).

UDF-01: a user reward function with the batch signature
``fn(sources, responses, truths, extras, task_ids) -> list[dict]`` runs on
Arrow batches, one call per batch, partition parallel; keys pass through as they
are.  UDF-02: a user embedding model, loaded once per Python worker; over whole
tables (:func:`embed_texts`) it sees each distinct text once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..hotkeys import join_unique
from ..session import write_once

SCORE_SCHEMA = ("score double, standard_score double, format_score double, similarity_score double, "
                "overlong_score double, task_type string")


def apply_reward_fn(df: DataFrame, fn: Callable, key_cols: list[str], source: str = "dataset",
                    response: str = "response", truth: str = "truth", extra: str | None = None,
                    task: str = "task", schema: str = SCORE_SCHEMA) -> DataFrame:
    """UDF-01: score records from a batch reward function, keyed by
    ``key_cols`` (results are never re-paired by position across batches)."""
    out_schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key_cols) + ", " + schema
    cols = key_cols + [source, response, truth, task] + ([extra] if extra else [])
    score = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in T.StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [b.column(len(key_cols) + i).to_pylist() for i in range(len(cols) - len(key_cols))]
            extras = values[4] if extra else [None] * b.num_rows
            recs = fn(values[0], values[1], values[2], extras, values[3])
            if len(recs) != b.num_rows:
                raise ValueError("reward function returned a different number of records")
            res = pa.RecordBatch.from_pylist([{n: r.get(n) for n in score.names} for r in recs], score)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(key_cols)], *res.columns], names=[*key_cols, *score.names])
    return df.select(*cols).mapInArrow(run, out_schema)


def hashed_ngram_embedder(dim: int = 64, n: int = 3) -> Callable[[list[str]], np.ndarray]:
    """A model-free stand-in embedder: L2-normalised hashed character
    n-gram counts.  Real deployments pass their own model loader."""
    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            s = f"  {(t or '').lower()}  "
            for j in range(len(s) - n + 1):
                out[i, hash_stable(s[j:j + n]) % dim] += 1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norms, 1e-12)
    return embed


def hash_stable(s: str) -> int:
    import zlib
    return zlib.crc32(s.encode("utf-8"))


def embedding_udf(loader: Callable[[], Callable[[list[str]], np.ndarray]]):
    """UDF-02: build an iterator pandas UDF; ``loader`` runs once per worker
    process and returns the text -> matrix function."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for s in it:
            m = model(s.fillna("").tolist())
            yield pd.Series(list(m.astype(np.float32)))
    return embed


def embed_texts(df: DataFrame, columns: list[str], loader: Callable[[], Callable[[list[str]], np.ndarray]],
                suffix: str = "_embedding") -> DataFrame:
    """UDF-02 over a table: ``df`` with the embedding of each of ``columns`` as
    ``<column><suffix>``.  A text is embedded once however often it occurs, in
    whichever column; null is the empty text.  A text that a third of the rows
    have is joined back without a shuffle of those rows."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    every = reduce(DataFrame.unionByName, [df.select(text(c).alias("_text")) for c in columns])
    counts = write_once(every.groupBy("_text").agg(F.count(F.lit(1)).alias("_n")), "distinct_texts")
    # written: the model is not asked again by the branches of the joins
    known = write_once(counts.withColumn("_e", embedding_udf(loader)("_text")), "embeddings")
    total = known.agg(F.sum("_n")).first()[0] or 0
    out = df
    for c in columns:
        one = known.select("_text", "_n", F.col("_e").alias(c + suffix))
        out = join_unique(out.withColumn("_text", text(c)), one, "_text", "_n", total).drop("_text", "_n")
    return out


#: Characters beyond which the example plug-in takes a tenth off.
LONG_RESPONSE = 400


def containment_reward(sources, responses, truths, extras, task_ids):
    """An example plug-in, one vectorised pass over a batch: 1 where a response
    mentions the truth (in any case), else the share of the truth's letters that
    are in it; responses over LONG_RESPONSE characters lose a tenth."""
    resp, gold = pd.Series(responses, dtype="object").fillna("").str.lower(), pd.Series(truths, dtype="object").fillna("").str.lower()
    found = np.fromiter((g in r for r, g in zip(resp, gold)), bool, len(resp))
    letters = np.fromiter((len(set(g) & set(r)) / max(1, len(set(g))) for r, g in zip(resp, gold)), float, len(resp))
    near = np.where(found, 1.0, letters)
    late = np.where(resp.str.len() > LONG_RESPONSE, -0.1, 0.0)
    out = pd.DataFrame({"score": near + late, "standard_score": found.astype(float), "format_score": 0.0,
                        "similarity_score": near, "overlong_score": late, "task_type": "plugin"})
    return out.to_dict("records")

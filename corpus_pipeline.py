"""A training-corpus pipeline: each stage's rows are written as Parquet in the
shared folder and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessellate.llm.common import materialise
from tessellate.llm.exact_dedup import stage_exact_dedup
from tessellate.llm.mixing import stage_mixing
from tessellate.llm.packing import stage_packing
from tessellate.llm.simhash import stage_near_dedup
from tessellate.llm.toxicity import stage_toxicity

STAGES = [
    ("toxicity", stage_toxicity),
    ("exact dedup", stage_exact_dedup),
    ("SimHash near-dedup", stage_near_dedup),
    ("mixing to target weights", stage_mixing),
    ("best-fit packing", stage_packing),
]

#: The classifier, the fingerprints, the raking and the packing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

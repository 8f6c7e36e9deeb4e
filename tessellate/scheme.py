"""The unified label scheme as small dimension DataFrames.

All lists below are FIXED VALUES: they define the class space and must equal
the published label scheme exactly (order included), because class indices
are positions in this order.  They are tiny and bounded (25 classes, 13
datasets, a few dozen synonyms), so every join against them is a broadcast
join of a proven-small side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (class space, synonyms, dataset domains)
# ---------------------------------------------------------------------------
DOMAINS = [
    ("sentiment_intensity", ["highly negative", "negative", "weakly negative", "neutral",
                             "weakly positive", "positive", "highly positive"]),
    ("emotion", ["anger", "disgust", "fear", "happy", "neutral", "calm", "sad", "surprise"]),
    ("mental_health_ptsd", ["no ptsd", "ptsd"]),
    ("mental_health_depression", ["no depression", "depression"]),
    ("mental_health_anxiety", ["no anxiety", "anxiety"]),
    ("sarcasm", ["not sarcasm", "sarcasm"]),
    ("humour", ["not humour", "humour"]),
]

EMOTION_SYNONYMS = {
    "angry": "anger",
    "happiness": "happy",
    "joy": "happy",
    "sadness": "sad",
    "fearful": "fear",
    "surprised": "surprise",
    "pleasant surprise": "surprise",
}

SENTIMENT_SYNONYMS = {
    "strongly negative": "highly negative",
    "negative": "negative",
    "weakly negative": "weakly negative",
    "neutral": "neutral",
    "weakly positive": "weakly positive",
    "positive": "positive",
    "strongly positive": "highly positive",
}

BOOL_TRUE = ["true", "yes", "1", "y", "t"]
BOOL_FALSE = ["false", "no", "0", "n", "f"]

DATASET_DOMAIN = {
    "chsimsv2": "sentiment_intensity",
    "mosei_senti": "sentiment_intensity",
    "meld_senti": "sentiment_intensity",
    "cremad": "emotion",
    "meld_emotion": "emotion",
    "mosei_emotion": "emotion",
    "tess": "emotion",
    "ptsd_in_the_wild": "mental_health_ptsd",
    "mmpsy_depression": "mental_health_depression",
    "mmpsy_anxiety": "mental_health_anxiety",
    "daicwoz": "mental_health_depression",
    "mmsd": "sarcasm",
    "urfunny": "humour",
}

QA_DATASETS = ["intentqa", "mimeqa", "siq2"]

# Canonical order of the seven sentiment labels (positions 0..6).
SENTIMENT_ORDER = DOMAINS[0][1]
# ---------------------------------------------------------------------------


def global_classes_rows():
    """(global_index, domain_id, domain, label) in scheme order."""
    rows, i = [], 0
    for d_id, (domain, labels) in enumerate(DOMAINS):
        for lab in labels:
            rows.append((i, d_id, domain, lab))
            i += 1
    return rows


NUM_CLASSES = len(global_classes_rows())

GLOBAL_CLASS_SCHEMA = T.StructType([
    T.StructField("global_index", T.LongType(), False),
    T.StructField("domain_id", T.LongType(), False),
    T.StructField("domain", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
])


def global_classes(spark: SparkSession) -> DataFrame:
    """LBL-04: the 25-row class dimension, broadcast-ready."""
    return F.broadcast(spark.createDataFrame(global_classes_rows(), GLOBAL_CLASS_SCHEMA))


def dataset_domains(spark: SparkSession) -> DataFrame:
    """(dataset, domain, domain_id) for the 13 classification datasets."""
    d_ids = {d: i for i, (d, _) in enumerate(DOMAINS)}
    rows = [(ds, dom, d_ids[dom]) for ds, dom in DATASET_DOMAIN.items()]
    schema = "dataset string, domain string, domain_id bigint"
    return F.broadcast(spark.createDataFrame(rows, schema))


def synonyms(spark: SparkSession) -> DataFrame:
    """(domain, raw_low, canonical) synonym table for sentiment and emotion."""
    rows = [("sentiment_intensity", k, v) for k, v in SENTIMENT_SYNONYMS.items()]
    rows += [("emotion", k, v) for k, v in EMOTION_SYNONYMS.items()]
    return F.broadcast(spark.createDataFrame(rows, "domain string, raw_low string, canonical string"))


def sentiment_positions(spark: SparkSession) -> DataFrame:
    """MET-07 dimension: global index -> canonical sentiment position 0..6.

    Built by joining the canonical order against the class dimension, so a
    scheme that lacks one of the seven labels yields fewer than 7 rows;
    :func:`tessellate.operators.metrics.sentiment_position` checks that.
    """
    order = spark.createDataFrame([(lab, i) for i, lab in enumerate(SENTIMENT_ORDER)],
                                  "label string, position bigint")
    gc = global_classes(spark).filter(F.col("domain") == "sentiment_intensity")
    return F.broadcast(gc.join(order, "label").select("global_index", "position"))

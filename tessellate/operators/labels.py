"""Label unification (LBL-01 .. LBL-10) and the lookup joins (JON-01/04).

Raw rows are reduced to distinct ``(dataset, answer)`` pairs first (a
partial + final aggregation, so a dataset holding a third of all rows is
combined map-side); everything after that touches only the label vocabulary.
Dimension tables (classes, dataset domains, synonyms) have a fixed, proven
size and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import scheme
from ..functions import text as TX


def qa_datasets(rows: DataFrame) -> DataFrame:
    """LBL-01: datasets with any row whose task has '_' and ends in '_qa'."""
    t = F.col("task")
    return (rows.filter(t.contains("_") & (F.substring_index(t, "_", -1) == "qa")
                        & F.col("dataset").isNotNull() & (F.col("dataset") != ""))
            .select("dataset").distinct())


def label_pairs(rows: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """LBL-02 / JON-04: distinct (dataset, answer), no nulls, QA datasets removed."""
    p = rows.filter(F.col("dataset").isNotNull() & F.col("answer").isNotNull()).select("dataset", "answer")
    if exclude is not None:
        p = p.join(exclude.select("dataset"), "dataset", "left_anti")
    return p.distinct()


def _collapse_ws(c: Column) -> Column:
    """Python ``" ".join(s.split())``."""
    return F.regexp_replace(TX.py_strip(c), r"(?U)\s+", " ")


def canonical_label(pairs: DataFrame, spark) -> DataFrame:
    """LBL-03: add ``domain``, ``unified_label`` and ``reason``.

    ``reason`` is what the build report lists: unknown_dataset,
    noncanonical_sentiment, noncanonical_emotion, noncanonical_binary
    (sarcasm/humour answers that are not boolean words, valid labels such as
    'sarcasm' included), or null.  PTSD/depression/anxiety notes are never
    reported.
    """
    dd = scheme.dataset_domains(spark)
    syn = scheme.synonyms(spark)
    p = pairs.join(dd.select("dataset", "domain"), "dataset", "left")
    raw = TX.py_strip(F.col("answer"))
    p = p.withColumn("_low", F.lower(raw)).withColumn("_low2", _collapse_ws(F.col("_low")))
    p = p.join(syn.select("domain", F.col("raw_low").alias("_low"), "canonical"), ["domain", "_low"], "left")
    b_raw = TX.boolean_word(F.col("answer"))
    b_low2 = TX.boolean_word(F.col("_low2"))
    d = F.col("domain")
    uni = (F.when(d.isin("sentiment_intensity", "emotion"), F.coalesce(F.col("canonical"), F.col("_low")))
           .when(d == "mental_health_depression",
                 F.when(b_low2 == F.lit(True), "depression").when(b_low2 == F.lit(False), "no depression")
                 .otherwise(F.col("_low2")))
           .when(d.isin("mental_health_ptsd", "mental_health_anxiety"), F.col("_low2"))
           .when(d == "sarcasm", F.when(b_raw == F.lit(True), "sarcasm").when(b_raw == F.lit(False), "not sarcasm")
                 .otherwise(F.col("_low")))
           .when(d == "humour", F.when(b_raw == F.lit(True), "humour").when(b_raw == F.lit(False), "not humour")
                 .otherwise(F.col("_low")))
           .otherwise(F.col("_low")))
    p = p.withColumn("unified_label", uni)
    gc = scheme.global_classes(spark).select(F.col("domain").alias("_d"), F.col("label").alias("_l"),
                                             F.lit(True).alias("_canon"))
    p = p.join(gc, (p["domain"] == gc["_d"]) & (p["unified_label"] == gc["_l"]), "left").drop("_d", "_l")
    canon = F.coalesce(F.col("_canon"), F.lit(False))
    reason = (F.when(d.isNull(), "unknown_dataset")
              .when((d == "sentiment_intensity") & ~canon, "noncanonical_sentiment")
              .when((d == "emotion") & ~canon, "noncanonical_emotion")
              .when(d.isin("sarcasm", "humour") & b_raw.isNull(), "noncanonical_binary"))
    return p.withColumn("reason", reason).drop("_low", "_low2", "canonical", "_canon")


def resolve_index(canon: DataFrame, spark, strict: bool = False) -> DataFrame:
    """LBL-05: (domain, unified_label) -> global index; key = dataset_answer.

    ``status`` is ok / unknown_dataset / unmappable.  With ``strict`` an
    unresolved pair raises through ``raise_error`` when the rows are
    computed, as the reference build does.
    """
    gc = scheme.global_classes(spark).select(F.col("domain").alias("_d"), F.col("label").alias("_l"),
                                             "global_index")
    j = canon.join(gc, (canon["domain"] == gc["_d"]) & (canon["unified_label"] == gc["_l"]), "left")
    j = j.drop("_d", "_l")
    status = (F.when(F.col("domain").isNull(), "unknown_dataset")
              .when(F.col("global_index").isNull(), "unmappable").otherwise("ok"))
    j = j.withColumn("status", status).withColumn("key", F.concat_ws("_", "dataset", "answer"))
    if strict:
        j = j.withColumn("global_index", F.when(F.col("status") == "ok", F.col("global_index"))
                         .otherwise(F.raise_error(F.concat(F.lit("cannot resolve label "), F.col("key"))).cast("bigint")))
    return j


def label_report(resolved: DataFrame, qa: DataFrame | None = None) -> DataFrame:
    """LBL-06: the build report as rows (reason, item): the key of every pair
    with a reason (unknown dataset or spelling outside the class list), of every
    pair of a known dataset that resolves to no class (``unmappable``), and the
    excluded QA datasets (``excluded_qa_datasets``) of ``qa``.  ``resolved`` is
    the result of :func:`resolve_index`."""
    named = resolved.filter(F.col("reason").isNotNull()).select("reason", F.col("key").alias("item"))
    lost = resolved.filter(F.col("status") == "unmappable").select(F.lit("unmappable").alias("reason"), F.col("key").alias("item"))
    out = named.unionByName(lost)
    if qa is not None:
        out = out.unionByName(qa.select(F.lit("excluded_qa_datasets").alias("reason"), F.col("dataset").alias("item")).distinct())
    return out


def dataset_labels(pairs: DataFrame) -> DataFrame:
    """LBL-07: sorted distinct answers per dataset (bounded by the vocabulary)."""
    return pairs.groupBy("dataset").agg(F.sort_array(F.collect_set("answer")).alias("labels"))


def lookup_label(samples: DataFrame, mapping: DataFrame) -> DataFrame:
    """LBL-08 / JON-01: lower(dataset_answer) (or lower(answer) when the
    dataset is empty) against the lower-cased mapping keys.

    ``mapping`` is (key, global_index) from :func:`resolve_index`; it is the
    label vocabulary, so it is reduced to distinct keys and broadcast when
    small (AQE picks the strategy from its runtime size otherwise).
    ``label_status`` is 'missing' for keys not in the map.
    """
    ds = F.lower(F.coalesce(F.col("dataset"), F.lit("")))
    ans = F.lower(F.coalesce(F.col("answer"), F.lit("")))
    key = F.when(ds != "", F.concat(ds, F.lit("_"), ans)).otherwise(ans)
    m = (mapping.select(F.lower("key").alias("_lkey"), F.col("global_index").alias("label"))
         .groupBy("_lkey").agg(F.min("label").alias("label")))
    out = samples.withColumn("_lkey", key).join(m, "_lkey", "left")
    return out.withColumn("label_status", F.when(F.col("label").isNull(), "missing").otherwise("ok")).drop("_lkey")


def domain_id(df: DataFrame, spark, qa: DataFrame | None = None) -> DataFrame:
    """LBL-09: domain ordinal in scheme order; QA datasets -1; unknown null
    with ``domain_status`` 'unknown'."""
    dd = scheme.dataset_domains(spark).select("dataset", "domain_id")
    out = df.join(dd, "dataset", "left")
    qa_names = qa if qa is not None else df.sparkSession.createDataFrame(
        [(d,) for d in scheme.QA_DATASETS], "dataset string")
    qa_flag = qa_names.select("dataset").distinct().withColumn("_qa", F.lit(True))
    out = out.join(qa_flag, "dataset", "left")
    did = F.when(F.col("_qa"), F.lit(-1).cast("bigint")).otherwise(F.col("domain_id"))
    return (out.withColumn("domain_id", did)
            .withColumn("domain_status", F.when(F.col("domain_id").isNull(), "unknown").otherwise("ok"))
            .drop("_qa"))


def label_name(df: DataFrame, spark, col: str, out: str = "class_name", missing: str = "empty") -> DataFrame:
    """LBL-10: class label text; missing -> '' (``missing='empty'``) or the
    index as text (``missing='index'``, the emotion metric's rule)."""
    names = scheme.global_classes(spark).select(F.col("global_index").alias("_gi"), F.col("label").alias(out))
    j = df.join(names, df[col] == names["_gi"], "left").drop("_gi")
    fill = F.lit("") if missing == "empty" else F.col(col).cast("string")
    return j.withColumn(out, F.coalesce(F.col(out), fill))


def include_datasets(df: DataFrame, include: DataFrame | None, counts: Observation | None = None) -> DataFrame:
    """PRJ-09 / JON-04: keep listed datasets (None = all).  ``counts`` fills, in
    the pass that reads the result, with the rows ``kept`` and ``skipped``; the
    listed names that no row has are :func:`unknown_datasets`."""
    if include is None:
        return df
    listed = include.select("dataset").distinct()
    if counts is None:
        return df.join(listed, "dataset", "left_semi")
    hit = F.col("_listed").isNotNull()
    j = df.join(listed.withColumn("_listed", F.lit(True)), "dataset", "left")
    return j.observe(counts, F.count_if(hit).alias("kept"), F.count_if(~hit).alias("skipped")).filter(hit).select(*df.columns)


def unknown_datasets(include: DataFrame, df: DataFrame) -> DataFrame:
    """PRJ-09 warning side: listed names that no row carries."""
    return include.select("dataset").distinct().join(df.select("dataset").distinct(), "dataset", "left_anti")

"""Label unification and lookup-join queries (LBL-*, JON-01/04, SET-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scheme
from ..operators import labels as L
from . import fixtures as X
from .registry import query

_TRUE = "('true','yes','1','y','t')"
_FALSE = "('false','no','0','n','f')"

_SQL_CANON = rf"""
, qa AS (SELECT DISTINCT dataset FROM label_pairs_in
         WHERE contains(task, '_') AND list_last(string_split(task, '_')) = 'qa'
           AND dataset IS NOT NULL AND dataset <> '')
, lp AS (SELECT DISTINCT dataset, answer FROM label_pairs_in
         WHERE dataset IS NOT NULL AND answer IS NOT NULL AND dataset NOT IN (SELECT dataset FROM qa))
, c0 AS (SELECT l.dataset, l.answer, d.domain, lower(regexp_replace(l.answer, '^\s+|\s+$', '', 'g')) AS low
         FROM lp l LEFT JOIN dsdomain d ON l.dataset = d.dataset)
, c1 AS (SELECT c0.*, regexp_replace(regexp_replace(c0.low, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS low2,
                s.canonical,
                CASE WHEN c0.low IN {_TRUE} THEN true WHEN c0.low IN {_FALSE} THEN false END AS b_raw
         FROM c0 LEFT JOIN synonyms s ON s.domain = c0.domain AND s.raw_low = c0.low)
, c2 AS (SELECT *, CASE
     WHEN domain IN ('sentiment_intensity', 'emotion') THEN coalesce(canonical, low)
     WHEN domain = 'mental_health_depression' THEN CASE WHEN low2 IN {_TRUE} THEN 'depression'
          WHEN low2 IN {_FALSE} THEN 'no depression' ELSE low2 END
     WHEN domain IN ('mental_health_ptsd', 'mental_health_anxiety') THEN low2
     WHEN domain = 'sarcasm' THEN CASE WHEN b_raw THEN 'sarcasm' WHEN NOT b_raw THEN 'not sarcasm' ELSE low END
     WHEN domain = 'humour' THEN CASE WHEN b_raw THEN 'humour' WHEN NOT b_raw THEN 'not humour' ELSE low END
     ELSE low END AS unified_label FROM c1)
, c3 AS (SELECT c2.*, g.global_index FROM c2 LEFT JOIN gclass g ON g.domain = c2.domain AND g.label = c2.unified_label)
, canon AS (SELECT *, CASE WHEN domain IS NULL THEN 'unknown_dataset'
       WHEN domain = 'sentiment_intensity' AND global_index IS NULL THEN 'noncanonical_sentiment'
       WHEN domain = 'emotion' AND global_index IS NULL THEN 'noncanonical_emotion'
       WHEN domain IN ('sarcasm', 'humour') AND b_raw IS NULL THEN 'noncanonical_binary' END AS reason,
     CASE WHEN domain IS NULL THEN 'unknown_dataset' WHEN global_index IS NULL THEN 'unmappable' ELSE 'ok' END
       AS status,
     dataset || '_' || answer AS key
   FROM c3)
"""
_V = ("label_pairs_in", "dsdomain", "synonyms", "gclass")


def _canon(spark, sf_dir):
    rows = X.label_pairs_in(spark, sf_dir)
    pairs = L.label_pairs(rows, L.qa_datasets(rows))
    return L.canonical_label(pairs, spark)


@query("lbl01_qa_datasets", _SQL_CANON + "SELECT dataset FROM qa", _V)
def lbl01(spark, sf_dir):
    return L.qa_datasets(X.label_pairs_in(spark, sf_dir))


@query("lbl02_label_pairs", _SQL_CANON + "SELECT dataset, answer FROM lp", _V)
def lbl02(spark, sf_dir):
    rows = X.label_pairs_in(spark, sf_dir)
    return L.label_pairs(rows, L.qa_datasets(rows))


@query("lbl03_canonical_label", _SQL_CANON + "SELECT dataset, answer, domain, unified_label, reason FROM canon", _V)
def lbl03(spark, sf_dir):
    return _canon(spark, sf_dir).select("dataset", "answer", "domain", "unified_label", "reason")


@query("lbl04_global_class", _SQL_CANON + """
SELECT g.global_index, g.domain_id, g.domain, g.label, count(c.key) AS n_pairs
FROM gclass g LEFT JOIN canon c ON c.global_index = g.global_index
GROUP BY 1, 2, 3, 4""", _V)
def lbl04(spark, sf_dir):
    res = L.resolve_index(_canon(spark, sf_dir), spark)
    used = res.filter(F.col("status") == "ok").groupBy("global_index").agg(F.count(F.lit(1)).alias("n_pairs"))
    gc = scheme.global_classes(spark)
    return gc.join(used, "global_index", "left").fillna(0, ["n_pairs"])


@query("lbl05_resolve_index", _SQL_CANON + "SELECT dataset, answer, key, global_index, status FROM canon", _V)
def lbl05(spark, sf_dir):
    return L.resolve_index(_canon(spark, sf_dir), spark).select("dataset", "answer", "key", "global_index", "status")


@query("lbl06_label_report", _SQL_CANON + """
SELECT reason, key AS item FROM canon WHERE reason IS NOT NULL
UNION ALL SELECT 'unmappable', key FROM canon WHERE status = 'unmappable'
UNION ALL SELECT 'excluded_qa_datasets', dataset FROM qa""", _V)
def lbl06(spark, sf_dir):
    rows = X.label_pairs_in(spark, sf_dir)
    return L.label_report(L.resolve_index(_canon(spark, sf_dir), spark), L.qa_datasets(rows))


@query("lbl07_dataset_labels", _SQL_CANON + """
SELECT dataset, array_to_string(list_sort(list(answer)), '|') AS labels FROM lp GROUP BY 1""", _V)
def lbl07(spark, sf_dir):
    rows = X.label_pairs_in(spark, sf_dir)
    dl = L.dataset_labels(L.label_pairs(rows, L.qa_datasets(rows)))
    return dl.select("dataset", F.array_join("labels", "|").alias("labels"))


@query("lbl08_lookup_label", _SQL_CANON + """
, m AS (SELECT lower(key) AS lkey, min(global_index) AS label FROM canon WHERE status = 'ok' GROUP BY 1)
, s AS (SELECT row_id, CASE WHEN coalesce(dataset, '') <> ''
                  THEN lower(dataset) || '_' || lower(coalesce(answer, '')) ELSE lower(coalesce(answer, '')) END AS lkey
        FROM label_pairs_in WHERE NOT ends_with(lower(task), '_qa'))
SELECT s.row_id, m.label, CASE WHEN m.label IS NULL THEN 'missing' ELSE 'ok' END AS label_status
FROM s LEFT JOIN m ON s.lkey = m.lkey""", _V)
def lbl08(spark, sf_dir):
    rows = X.label_pairs_in(spark, sf_dir)
    mapping = L.resolve_index(L.canonical_label(L.label_pairs(rows, L.qa_datasets(rows)), spark), spark)
    mapping = mapping.filter(F.col("status") == "ok")
    cls_rows = rows.filter(~F.lower("task").endswith("_qa"))
    return L.lookup_label(cls_rows, mapping).select("row_id", "label", "label_status")


@query("lbl09_domain_id", """
, ds AS (SELECT DISTINCT dataset FROM (SELECT dataset FROM label_pairs_in UNION ALL SELECT dataset FROM samples))
SELECT ds.dataset, CASE WHEN ds.dataset IN ('intentqa', 'mimeqa', 'siq2') THEN -1 ELSE d.domain_id END AS domain_id,
       CASE WHEN ds.dataset IN ('intentqa', 'mimeqa', 'siq2') OR d.domain_id IS NOT NULL THEN 'ok' ELSE 'unknown' END
         AS domain_status
FROM ds LEFT JOIN dsdomain d ON d.dataset = ds.dataset""", ("label_pairs_in", "samples", "dsdomain"))
def lbl09(spark, sf_dir):
    ds = (X.label_pairs_in(spark, sf_dir).select("dataset")
          .unionByName(X.samples(spark, sf_dir).select("dataset")).distinct())
    return L.domain_id(ds, spark).select("dataset", "domain_id", "domain_status")


@query("lbl10_label_name", """
SELECT p.y_pred, coalesce(g.label, '') AS class_name, coalesce(g.label, CAST(p.y_pred AS VARCHAR)) AS class_name_emo,
       count(*) AS n
FROM (SELECT y_pred FROM preds UNION ALL SELECT y_pred + 20 FROM preds) p
LEFT JOIN gclass g ON g.global_index = p.y_pred GROUP BY 1, 2, 3""", ("preds", "gclass"))
def lbl10(spark, sf_dir):
    p = X.preds(spark, sf_dir).select("y_pred")
    p = p.unionByName(p.select((F.col("y_pred") + 20).alias("y_pred")))
    a = L.label_name(p, spark, "y_pred", "class_name", "empty")
    a = L.label_name(a, spark, "y_pred", "class_name_emo", "index")
    return a.groupBy("y_pred", "class_name", "class_name_emo").agg(F.count(F.lit(1)).alias("n"))


@query("jon01_scheme_lookup", _SQL_CANON + """
, m AS (SELECT lower(key) AS lkey, min(global_index) AS label FROM canon WHERE status = 'ok' GROUP BY 1)
SELECT r.row_id, m.label AS global_index, g.label AS class_name, g.domain_id
FROM label_pairs_in r JOIN m ON m.lkey = lower(r.dataset) || '_' || lower(r.answer)
JOIN gclass g ON g.global_index = m.label""", _V)
def jon01(spark, sf_dir):
    rows = X.label_pairs_in(spark, sf_dir)
    mapping = L.resolve_index(L.canonical_label(L.label_pairs(rows, L.qa_datasets(rows)), spark), spark)
    hit = L.lookup_label(rows.filter(F.col("answer").isNotNull()), mapping.filter(F.col("status") == "ok"))
    hit = hit.filter(F.col("label_status") == "ok").select("row_id", F.col("label").alias("global_index"))
    gc = scheme.global_classes(spark).select("global_index", F.col("label").alias("class_name"), "domain_id")
    return hit.join(gc, "global_index")


@query("jon04_qa_exclusion_and_include", """
, qa AS (SELECT DISTINCT dataset FROM label_pairs_in
         WHERE contains(task, '_') AND list_last(string_split(task, '_')) = 'qa')
, inc AS (SELECT dataset FROM dsdomain WHERE domain IN ('emotion', 'sarcasm'))
SELECT dataset, count(*) AS n FROM label_pairs_in
WHERE dataset NOT IN (SELECT dataset FROM qa) AND dataset IN (SELECT dataset FROM inc)
GROUP BY 1""", ("label_pairs_in", "dsdomain"))
def jon04(spark, sf_dir):
    rows = X.label_pairs_in(spark, sf_dir)
    kept = rows.join(L.qa_datasets(rows), "dataset", "left_anti")
    inc = scheme.dataset_domains(spark).filter(F.col("domain").isin("emotion", "sarcasm")).select("dataset")
    return L.include_datasets(kept, inc).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("prj09_include_datasets", """
, inc AS (SELECT 'src' || i AS dataset FROM range(0, 30, 3) t(i))
SELECT 'kept' AS kind, dataset, count(*) AS n FROM samples WHERE dataset IN (SELECT dataset FROM inc) GROUP BY 2
UNION ALL
SELECT 'unknown' AS kind, dataset, 0 AS n FROM inc WHERE dataset NOT IN (SELECT dataset FROM samples)""",
       ("samples",))
def prj09(spark, sf_dir):
    s = X.samples(spark, sf_dir)
    inc = spark.range(0, 30, 3).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("dataset"))
    kept = L.include_datasets(s, inc).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    unk = L.unknown_datasets(inc, s).select("dataset", F.lit(0).cast("bigint").alias("n"))
    return (kept.select(F.lit("kept").alias("kind"), "dataset", "n")
            .unionByName(unk.select(F.lit("unknown").alias("kind"), "dataset", "n")))


@query("set01_concat", """
SELECT 'assistant' AS part, count(*) AS n FROM responses
UNION ALL SELECT 'user', count(*) FROM judge_replies""", ("responses", "judge_replies"))
def set01(spark, sf_dir):
    a = X.responses(spark, sf_dir).select("conv_id", "turn", "dataset")
    b = X.judge_replies(spark, sf_dir).select("conv_id", "turn", "dataset")
    u = a.withColumn("part", F.lit("assistant")).unionByName(b.withColumn("part", F.lit("user")))
    return u.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("set02_union_distinct_datasets", """
SELECT dataset FROM samples UNION SELECT dataset FROM label_pairs_in""", ("samples", "label_pairs_in"))
def set02(spark, sf_dir):
    a = X.samples(spark, sf_dir).select("dataset")
    b = X.label_pairs_in(spark, sf_dir).select("dataset")
    return a.union(b).distinct()

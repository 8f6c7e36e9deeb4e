"""Metric queries (MET-*) over the prediction views."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scheme
from ..operators import metrics as M
from . import fixtures as X
from .registry import finish, query

# Shared oracle fragments: per-(dataset, class) counts with the pooled fp rule.
_COUNTS_SQL = """
, sup AS (SELECT dataset, y_true AS cls, count(*) AS support,
                 sum(CASE WHEN y_pred = y_true THEN 1 ELSE 0 END) AS tp
          FROM {src} GROUP BY 1, 2)
, fpc AS (SELECT dataset, y_pred AS cls, count(*) AS fp FROM {src} WHERE y_pred <> y_true GROUP BY 1, 2)
, cnt AS (SELECT s.dataset, s.cls, CAST(s.tp AS BIGINT) AS tp, CAST(coalesce(f.fp, 0) AS BIGINT) AS fp,
                 CAST(s.support - s.tp AS BIGINT) AS fn, CAST(s.support AS BIGINT) AS support
          FROM sup s LEFT JOIN fpc f ON s.dataset = f.dataset AND s.cls = f.cls)
, prf0 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
                     CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM cnt)
, prf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                         ELSE 0.0 END AS f1, recall AS accuracy FROM prf0)
, setm AS (SELECT dataset,
       avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
       avg(accuracy) AS macro_accuracy,
       sum(precision * support) / sum(support) AS weighted_precision,
       sum(recall * support) / sum(support) AS weighted_recall,
       sum(f1 * support) / sum(support) AS weighted_f1,
       sum(accuracy * support) / sum(support) AS weighted_accuracy,
       CASE WHEN sum(tp) + sum(fp) > 0 THEN sum(tp) / (sum(tp) + sum(fp)) ELSE 0.0 END AS micro_precision,
       CASE WHEN sum(tp) + sum(fn) > 0 THEN sum(tp) / (sum(tp) + sum(fn)) ELSE 0.0 END AS micro_recall,
       sum(tp) / sum(support) AS micro_accuracy
   FROM prf GROUP BY dataset)
, setx AS (SELECT *, CASE WHEN micro_precision + micro_recall > 0
                  THEN 2 * micro_precision * micro_recall / (micro_precision + micro_recall) ELSE 0.0 END AS micro_f1
           FROM setm)
"""


def counts_sql(src: str) -> str:
    return _COUNTS_SQL.format(src=src)


@query("met01_class_counts", counts_sql("preds") + "SELECT * FROM cnt", ("preds",))
def met01(spark, sf_dir):
    return M.class_counts(X.preds(spark, sf_dir), ["dataset"])


@query("met02_class_prf", counts_sql("preds") + """
SELECT dataset, cls, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM prf""", ("preds",))
def met02(spark, sf_dir):
    return finish(M.class_prf(M.class_counts(X.preds(spark, sf_dir), ["dataset"])))


def _set_cols(prefix):
    return ", ".join(f"round({prefix}_{k}, 6) AS {prefix}_{k}" for k in ("precision", "recall", "f1", "accuracy"))


for _pfx, _id in (("macro", "met03_macro"), ("weighted", "met04_weighted"), ("micro", "met05_micro")):
    def _mk(pfx):
        def fn(spark, sf_dir):
            prf = M.class_prf(M.class_counts(X.preds(spark, sf_dir), ["dataset"]))
            sm = M.set_metrics(prf, ["dataset"])
            return finish(sm.select("dataset", *[f"{pfx}_{k}" for k in ("precision", "recall", "f1", "accuracy")]))
        fn.__doc__ = f"MET {pfx} precision/recall/f1/accuracy per dataset."
        return fn
    query(_id, counts_sql("preds") + f"SELECT dataset, {_set_cols(_pfx)} FROM setx", ("preds",))(_mk(_pfx))


_MET06_SQL = """
, preds_all AS (SELECT dataset, y_true, y_pred FROM preds
                UNION ALL SELECT '__all__' AS dataset, y_true, y_pred FROM preds)
""" + counts_sql("preds_all") + """
SELECT dataset AS scope, metric, round(value, 6) AS value FROM (
  UNPIVOT setx ON macro_precision, macro_recall, macro_f1, macro_accuracy,
                 weighted_precision, weighted_recall, weighted_f1, weighted_accuracy,
                 micro_precision, micro_recall, micro_f1, micro_accuracy
  INTO NAME metric VALUE value)
UNION ALL
SELECT dataset AS scope, 'class_f1/' || cls AS metric, round(f1, 6) AS value FROM prf WHERE dataset <> '__all__'
"""


@query("met06_metrics_by_dataset", _MET06_SQL, ("preds",))
def met06(spark, sf_dir):
    return finish(M.metrics_by_dataset(X.preds(spark, sf_dir)))


@query("met06b_named_classes", _MET06_SQL.replace(
    "SELECT dataset AS scope, 'class_f1/' || cls AS metric, round(f1, 6) AS value FROM prf WHERE dataset <> '__all__'",
    "SELECT p.dataset, coalesce(g.label, CAST(p.cls AS VARCHAR)) || '/class_f1', round(p.f1, 6) "
    "FROM prf p LEFT JOIN gclass g ON g.global_index = p.cls WHERE p.dataset <> '__all__'"), ("preds", "gclass"))
def met06b(spark, sf_dir):
    return finish(M.metrics_by_dataset(X.preds(spark, sf_dir), M.label_names(spark)))


@query("met07_sentiment_position", """
SELECT u.y_true, coalesce(g.pos, -1) AS position, count(*) AS n
FROM (SELECT y_true FROM preds UNION ALL SELECT y_true FROM emo_preds) u
LEFT JOIN (SELECT global_index, CAST(global_index AS BIGINT) AS pos FROM gclass
           WHERE domain = 'sentiment_intensity') g ON u.y_true = g.global_index
GROUP BY 1, 2""", ("preds", "emo_preds", "gclass"))
def met07(spark, sf_dir):
    u = X.preds(spark, sf_dir).select("y_true").unionByName(X.emo_preds(spark, sf_dir).select("y_true"))
    pos = M.sentiment_position(u, "y_true", scheme.sentiment_positions(spark), "position")
    return pos.groupBy("y_true", "position").agg(F.count(F.lit(1)).alias("n"))


@query("met08_collapse", """
, pos0 AS (SELECT y_true AS q FROM preds UNION ALL SELECT y_pred FROM preds)
, pos AS (SELECT CASE WHEN q BETWEEN 0 AND 6 THEN q ELSE -1 END AS p FROM pos0)
, ks AS (SELECT p, k FROM pos, (VALUES (7), (5), (3), (2)) t(k))
SELECT CAST(k AS BIGINT) AS k, p AS position,
  CAST(CASE WHEN k = 7 THEN p
       WHEN k = 5 THEN CASE WHEN p = 0 THEN 0 WHEN p IN (1, 2) THEN 1 WHEN p = 3 THEN 2
                            WHEN p IN (4, 5) THEN 3 WHEN p = 6 THEN 4 ELSE -1 END
       WHEN k = 3 THEN CASE WHEN p IN (0, 1, 2) THEN 0 WHEN p = 3 THEN 1 WHEN p IN (4, 5, 6) THEN 2 ELSE -1 END
       ELSE CASE WHEN p IN (4, 5, 6) THEN 1 WHEN p IN (0, 1, 2) THEN 0 ELSE -1 END END AS BIGINT) AS collapsed,
  count(*) AS n
FROM ks GROUP BY 1, 2, 3""", ("preds",))
def met08(spark, sf_dir):
    p = X.preds(spark, sf_dir)
    pos = p.select(F.col("y_true").alias("p")).unionByName(p.select(F.col("y_pred").alias("p")))
    pos = M.sentiment_position(pos, "p", scheme.sentiment_positions(spark), "position")
    ks = pos.select("p", "position", F.explode(F.array(*[F.lit(k).cast("bigint") for k in (7, 5, 3, 2)])).alias("k"))
    ks = ks.withColumn("collapsed", M.collapse(F.col("position"), F.col("k")))
    return ks.groupBy("k", "position", "collapsed").agg(F.count(F.lit(1)).alias("n"))


_MET09_SQL = """
, sp AS (SELECT p.dataset, p.y_true AS t, CASE WHEN p.y_pred BETWEEN 0 AND 6 THEN p.y_pred ELSE -1 END AS pr
         FROM preds p JOIN dsdomain d ON p.dataset = d.dataset AND d.domain = 'sentiment_intensity'
         WHERE p.y_true BETWEEN 0 AND 6)
, kk AS (SELECT * FROM sp, (VALUES (7), (5), (3), (2)) v(k) WHERE NOT (k = 2 AND t = 3))
, col AS (SELECT dataset || '#' || k AS dataset,
  CASE WHEN k = 7 THEN t WHEN k = 5 THEN CASE WHEN t = 0 THEN 0 WHEN t IN (1, 2) THEN 1 WHEN t = 3 THEN 2
       WHEN t IN (4, 5) THEN 3 WHEN t = 6 THEN 4 ELSE -1 END
       WHEN k = 3 THEN CASE WHEN t IN (0, 1, 2) THEN 0 WHEN t = 3 THEN 1 WHEN t IN (4, 5, 6) THEN 2 ELSE -1 END
       ELSE CASE WHEN t IN (4, 5, 6) THEN 1 WHEN t IN (0, 1, 2) THEN 0 ELSE -1 END END AS y_true,
  CASE WHEN k = 7 THEN pr WHEN k = 5 THEN CASE WHEN pr = 0 THEN 0 WHEN pr IN (1, 2) THEN 1 WHEN pr = 3 THEN 2
       WHEN pr IN (4, 5) THEN 3 WHEN pr = 6 THEN 4 ELSE -1 END
       WHEN k = 3 THEN CASE WHEN pr IN (0, 1, 2) THEN 0 WHEN pr = 3 THEN 1 WHEN pr IN (4, 5, 6) THEN 2 ELSE -1 END
       ELSE CASE WHEN pr IN (4, 5, 6) THEN 1 WHEN pr IN (0, 1, 2) THEN 0 ELSE -1 END END AS y_pred
  FROM kk)
""" + counts_sql("col") + """
, present AS (SELECT DISTINCT s.dataset, k FROM sp s, (VALUES (7), (5), (3), (2)) v(k))
, res AS (SELECT p.dataset, p.k, coalesce(x.micro_accuracy, 0.0) AS acc, coalesce(x.weighted_f1, 0.0) AS f1w
          FROM present p LEFT JOIN setx x ON x.dataset = p.dataset || '#' || p.k)
SELECT dataset, 'ACC' || k AS metric, round(acc, 6) AS value FROM res
UNION ALL SELECT dataset, 'F1w' || k AS metric, round(f1w, 6) AS value FROM res
"""


@query("met09_sentiment_metrics", _MET09_SQL, ("preds", "dsdomain"))
def met09(spark, sf_dir):
    return finish(M.sentiment_metrics(X.preds(spark, sf_dir), scheme.sentiment_positions(spark),
                                      scheme.dataset_domains(spark)))


@query("met10_emotion_weighted_accuracy", """
, ep AS (SELECT p.* FROM emo_preds p JOIN dsdomain d ON p.dataset = d.dataset AND d.domain = 'emotion')
""" + counts_sql("ep") + """
, tot AS (SELECT dataset, count(*) AS n_all FROM ep GROUP BY 1)
, wa AS (SELECT c.dataset, c.cls,
   0.5 * ((CASE WHEN c.support > 0 THEN c.tp / c.support ELSE 0.0 END)
        + (CASE WHEN t.n_all - c.support > 0 THEN (t.n_all - c.tp - c.fp - c.fn) / (t.n_all - c.support) ELSE 0.0 END)) AS wa
   FROM cnt c JOIN tot t ON c.dataset = t.dataset)
SELECT w.dataset, coalesce(g.label, CAST(w.cls AS VARCHAR)) || '/emotion_weighted_accuracy' AS metric,
       round(w.wa, 6) AS value
FROM wa w LEFT JOIN gclass g ON g.global_index = w.cls
UNION ALL
SELECT dataset, 'emotion_weighted_accuracy_mean' AS metric, round(avg(wa), 6) AS value FROM wa GROUP BY dataset
""", ("emo_preds", "dsdomain", "gclass"))
def met10(spark, sf_dir):
    return finish(M.emotion_weighted_accuracy(X.emo_preds(spark, sf_dir), scheme.dataset_domains(spark),
                                              M.label_names(spark)))


@query("met13_confusion_matrix", """
SELECT dataset, y_true, y_pred, count(*) AS n FROM preds GROUP BY 1, 2, 3""", ("preds",))
def met13(spark, sf_dir):
    return M.confusion_cells(X.preds(spark, sf_dir), ["dataset"])


@query("met15_accuracy", """
SELECT dataset, round(sum(CASE WHEN y_pred = y_true THEN 1 ELSE 0 END) / greatest(count(*), 1), 6) AS accuracy
FROM binary_preds GROUP BY 1""", ("binary_preds",))
def met15(spark, sf_dir):
    return finish(M.accuracy(X.binary_preds(spark, sf_dir), ["dataset"]))


@query("met14_weighted_loss", """
SELECT run, round(sum(loss * n_samples) / greatest(sum(n_samples), 1), 6) AS loss_by_samples,
       round(sum(loss * n_tokens) / greatest(sum(n_tokens), 1), 6) AS loss_by_tokens
FROM metric_history GROUP BY 1""", ("metric_history",))
def met14(spark, sf_dir):
    h = X.metric_history(spark, sf_dir)
    a = M.weighted_loss(h, ["run"], "loss", "n_samples").withColumnRenamed("weighted_loss", "loss_by_samples")
    b = M.weighted_loss(h, ["run"], "loss", "n_tokens").withColumnRenamed("weighted_loss", "loss_by_tokens")
    return finish(a.join(b, "run"))


@query("met01b_binary_class_counts", counts_sql("binary_preds") + "SELECT * FROM cnt", ("binary_preds",))
def met01b(spark, sf_dir):
    return M.class_counts(X.binary_preds(spark, sf_dir), ["dataset"])

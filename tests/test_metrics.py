"""Golden values re-derived from the documented formulas."""
import pytest
from pyspark.sql import functions as F

from tessellate import scheme
from tessellate.operators import metrics as M


def _rows(*cells):
    """(dataset, truth, prediction, times) -> rows."""
    return [(d, t, p) for d, t, p, n in cells for _ in range(n)]


def _cells(spark, *cells):
    return spark.createDataFrame(_rows(*cells), "dataset string, y_true bigint, y_pred bigint")


def test_counts_and_sets_by_hand(spark):
    # class 3 is predicted twice but is nobody's truth: it is a miss of class 1 and no false positive of any class
    df = _cells(spark, ("x", 0, 0, 4), ("x", 0, 1, 1), ("x", 1, 1, 2), ("x", 1, 3, 2), ("x", 2, 2, 1))
    c = {r.cls: (r.tp, r.fp, r.fn, r.support) for r in M.class_counts(df).collect()}
    assert c == {0: (4, 0, 1, 5), 1: (2, 1, 2, 4), 2: (1, 0, 0, 1)}
    s = M.set_metrics(M.class_prf(M.class_counts(df))).first()
    f1 = [8 / 9, 4 / 7, 1]
    assert s.macro_precision == pytest.approx((1 + 2 / 3 + 1) / 3)
    assert s.macro_recall == pytest.approx((0.8 + 0.5 + 1) / 3)
    assert s.macro_f1 == pytest.approx(sum(f1) / 3)
    assert s.weighted_precision == pytest.approx((5 + 4 * 2 / 3 + 1) / 10)
    assert s.weighted_f1 == pytest.approx((5 * f1[0] + 4 * f1[1] + f1[2]) / 10)
    assert s.micro_precision == pytest.approx(7 / 8) and s.micro_recall == pytest.approx(7 / 10)
    assert s.micro_accuracy == pytest.approx(7 / 10)


def test_pooled_set_counts_other_datasets_truth_classes(spark):
    # in x alone, class 5 is nobody's truth; pooled with y it is, so its prediction becomes a false positive
    df = _cells(spark, ("x", 0, 5, 1), ("x", 0, 0, 3), ("y", 5, 5, 2))
    got = {(r.scope, r.metric): r.value for r in M.metrics_by_dataset(df).collect()}
    assert got["x", "micro_precision"] == pytest.approx(1.0)
    assert got["__all__", "micro_precision"] == pytest.approx(5 / 6)
    assert got["x", "class_f1/0"] == pytest.approx(6 / 7) and ("x", "class_f1/5") not in got


def test_class_names_and_flat_report(spark):
    df = _cells(spark, ("chsimsv2", 0, 0, 2), ("chsimsv2", 4, 5, 1), ("tess", 7, 7, 1), ("tess", 8, 7, 1))
    names = M.label_names(spark)
    label = {r.global_index: r.label for r in names.collect()}
    flat = {r.key: r.value for r in M.flat_report(df, names, scheme.sentiment_positions(spark), scheme.dataset_domains(spark)).collect()}
    assert flat[f"chsimsv2/{label[0]}/class_f1"] == pytest.approx(1.0)
    assert flat[f"tess/{label[7]}/emotion_weighted_accuracy"] == pytest.approx(0.5)  # 0.5 * (1/1 + 0/1)
    assert flat["micro_accuracy"] == pytest.approx(3 / 5) and flat["chsimsv2/ACC7"] == pytest.approx(2 / 3)
    assert flat["chsimsv2/ACC3"] == pytest.approx(1.0)  # 4 and 5 are both positive


def test_sentiment_table_by_hand(spark):
    # positions: 0 highly negative .. 3 neutral .. 6 highly positive
    df = _cells(spark, ("chsimsv2", 1, 2, 2), ("chsimsv2", 3, 3, 1), ("chsimsv2", 6, 5, 1), ("other", 0, 0, 1))
    out = M.sentiment_metrics(df, scheme.sentiment_positions(spark), scheme.dataset_domains(spark))
    got = {(r.dataset, r.metric): r.value for r in out.collect()}
    assert got["chsimsv2", "ACC7"] == pytest.approx(1 / 4)  # the neutral one
    assert got["chsimsv2", "ACC5"] == pytest.approx(3 / 4)  # 1 and 2 fall together, 5 and 6 do not
    assert got["chsimsv2", "ACC3"] == pytest.approx(1.0) and got["chsimsv2", "F1w3"] == pytest.approx(1.0)
    assert got["chsimsv2", "ACC2"] == pytest.approx(1.0)  # without the neutral truth
    assert got["chsimsv2", "F1w7"] == pytest.approx(1 / 4)
    assert not any(d == "other" for d, _ in got)  # not in the domain map


def test_properties_support_and_recall(spark):
    from tessellate.plans import fixtures as X
    p = X.preds(spark, "/root/testdata/sf0.001")
    c = M.class_counts(p)
    assert c.filter(F.col("tp") + F.col("fn") != F.col("support")).count() == 0
    assert c.agg(F.sum("support")).first()[0] == p.count()
    s = M.set_metrics(M.class_prf(c)).collect()
    for r in s:
        assert r.micro_recall == pytest.approx(r.micro_accuracy)


def test_repartition_invariance(spark):
    from tessellate.plans import fixtures as X
    p = X.preds(spark, "/root/testdata/sf0.001")
    a = sorted(M.metrics_by_dataset(p.repartition(1)).collect())
    b = sorted(M.metrics_by_dataset(p.repartition(17)).collect())
    assert [(x.scope, x.metric) for x in a] == [(x.scope, x.metric) for x in b]
    for x, y in zip(a, b):
        assert x.value == pytest.approx(y.value, abs=1e-12)

import math
import os
import random
import zlib

import numpy as np
import pytest

from tessellate.llm import toxicity as T

from .conftest import ODD

BAD = ["blarg", "snurk", "vorpel"]


def _corpus(n=1500):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(4, 9))) for _ in range(3000)]
    rows, toxic = [], {}
    for i in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randint(10, 80))]
        toxic[i] = i % 8 == 0
        if toxic[i]:
            for _ in range(rnd.randint(1, 4)):
                w.insert(rnd.randrange(len(w)), rnd.choice(BAD) + rnd.choice(["", "", ",", "isch", "!"]))
        rows.append((i, " ".join(w)))
    return rows, toxic


def test_learns_from_positives_and_unlabelled_text(spark, make_docs):
    rows, toxic = _corpus()
    docs = make_docs(rows + [(-1 - i, t) for i, (_, t) in enumerate(ODD)])
    # labels for some documents only; held-out ones carry the opposite, which must do no harm
    out = [(i, 0, int(toxic[i])) for i in range(0, len(rows), 2) if zlib.crc32(str(i).encode()) % 5]
    lies = [(i, 0, int(not toxic[i])) for i in range(0, len(rows), 2) if not zlib.crc32(str(i).encode()) % 5]
    labels = spark.createDataFrame(out + lies + [(None, 0, 1), (5, 0, None)], "doc_id bigint, quality int, toxic int")
    scored = T.score(docs, T.train(docs, labels), out="verdict").select("doc_id", "verdict").collect()
    assert len(scored) == docs.count() and all(0 <= r.verdict <= 1 for r in scored)
    held = [r for r in scored if r.doc_id >= 0 and not zlib.crc32(str(r.doc_id).encode()) % 5]
    right = sum((r.verdict >= 0.5) == toxic[r.doc_id] for r in held)
    assert right / len(held) > 0.97
    assert all(r.verdict < 0.5 for r in scored if r.doc_id < 0)


def test_nothing_to_learn(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = make_docs(ODD)
    assert T.train(docs, labels) is None
    assert {r.verdict for r in T.score(docs, None, out="verdict").collect()} == {0.0}
    one = spark.createDataFrame([(4, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert T.score(docs, T.train(docs, one), out="verdict").count() == len(ODD)
    assert T.train(make_docs([]), one) is None


def test_features_read_whole_texts():
    read = T.FeatureReader(keep=3)
    assert set(read("x " * 100_000 + "blarg")) >= set(T.word_features("blarg"))
    assert set(read("Blarg!")) == set(read("blarg")) and len(read(None)) == 0


def _fitted():
    rows, toxic = _corpus(600)
    read = T.FeatureReader()
    pos = [read(t) for i, t in rows if toxic[i] and i % 3]
    return rows, toxic, pos, [read(t) for _, t in rows]


def test_scores_equal_brute_force(make_docs):
    rows, _, pos, unl = _fitted()
    model = T.fit_nnpu(pos, unl, 0.125)
    weight = dict(zip(model.ids.tolist(), model.weights.tolist()))
    docs = rows[:80] + [(5000 + i, t) for i, (_, t) in enumerate(ODD)]
    got = {r.doc_id: r.verdict for r in T.score(make_docs(docs), model, out="verdict").collect()}
    for i, t in docs:
        held = {f for w in (t or "").lower().split() for f in T.word_features(w)}
        z = model.bias + sum(weight.get(f, 0.0) for f in held)
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-6


def test_risk_and_its_slope_equal_the_formula():
    rnd = np.random.default_rng(2)
    rows = [np.flatnonzero(rnd.random(6) < 0.5) for _ in range(30)]
    risk, prior = T.Risk(rows, 8, 0.3), 0.3
    sig = lambda z: 1 / (1 + math.exp(-z))
    for sign in (1, -1):  # the estimated negative risk above and below zero
        theta = rnd.normal(size=7) - 2 * (sign < 0)
        if sign < 0:
            theta[:6] = 3 * np.array([x[0] if len(x) else 1 for x in np.array_split(np.bincount(np.concatenate(rows[:8]), minlength=6) - np.bincount(np.concatenate(rows[8:]), minlength=6) / 3, 6)])
        s = [sig(sum(theta[r]) + theta[-1]) for r in rows]
        neg = np.mean(s[8:]) - prior * np.mean(s[:8])
        assert risk.of(risk.scores(theta)) == pytest.approx(prior * (1 - np.mean(s[:8])) + max(0.0, neg))

        def value(t):
            s = risk.scores(t)
            return prior * (1 - s[:8]).mean() + risk.negative(s) if risk.negative(s) >= 0 else -risk.negative(s)

        step = 1e-6 * np.eye(7)
        near = [(value(theta + e) - value(theta - e)) / 2e-6 for e in step]
        assert risk.slope(risk.scores(theta), 6) == pytest.approx(near, abs=1e-5)


def test_the_fit_does_not_hang_on_the_bound_of_features(monkeypatch):
    """More and weaker features, copies and another order leave the verdicts as they are."""
    rows, toxic, pos, unl = _fitted()
    read = T.FeatureReader()
    right = []
    for least, p, u in ((15.0, pos, unl), (5.0, pos, unl), (15.0, pos[::-1] + pos[:5] * 20, unl[::-1] + unl[:9] * 30)):
        monkeypatch.setattr(T, "MIN_RATIO", least)
        m = T.fit_nnpu(p, u, 0.125)
        w = m.dense()
        right.append(np.mean([(w[read(t)].sum() + m.bias >= 0) == toxic[i] for i, t in rows]))
    assert min(right) > 0.97


def test_fitting_holds_no_second_copy_of_the_rows():
    """Drawn rows are told apart and counted in less memory than they take."""
    import tracemalloc

    rnd = np.random.default_rng(5)
    rows = [rnd.integers(0, T.BUCKETS, 4000).astype(np.int32) for _ in range(3000)]  # 48 MB
    rows += [rows[0][::-1].copy(), np.empty(0, np.int32)]
    tracemalloc.start()
    kept = T.distinct_rows(rows)
    n = T.counts(kept)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert len(kept) == 3000 and (n == np.bincount(np.concatenate(kept), minlength=T.BUCKETS)).all()
    assert peak < sum(r.nbytes for r in rows) / 1e6


def test_drawn_rows_are_fitted_away_from_the_driver(spark, make_docs, monkeypatch):
    rows, toxic = _corpus(300)
    labels = spark.createDataFrame([(i, 0, int(toxic[i])) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    here = T.train(make_docs(rows), labels)
    assert len(here.ids) == len(here.weights) > 0 and here.ids.dtype == np.int32 and here.weights.dtype == np.float32
    monkeypatch.setattr(T, "fit_nnpu", lambda pos, unl, prior: T.Model(np.array([len(pos)], np.int32), np.array([len(unl)], np.float32), float(os.getpid())))
    model = T.train(make_docs(rows), labels)
    taught = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    assert model.ids[0] == sum(toxic[i] for i in taught) and model.weights[0] == len(taught)
    assert model.bias != os.getpid()

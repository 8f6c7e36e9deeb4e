"""Operator 5: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all training documents
is the unlabelled text, which holds toxic ones too.  A linear model
over hashed features is trained in numpy on the non-negative risk
``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))`` with the sigmoid loss; where the
estimated negative risk falls below zero the step goes the other way.  ``pi``,
the class prior, is the toxic share of labelled training rows unless given.  The
risk is not convex: descent starts from the features' log-likelihood ratios, cut
to a small range, with the bias of least risk, and the weights of least risk on
its way are taken.

The model is fitted on at most ``POSITIVES`` and ``UNLABELLED`` documents, drawn
by hash (a documented bound); every document is scored over its whole text.
Features are the distinct words of a text and their first letters, so inflected
and compounded insults count as well.

Defined results.  A null or empty text has the score of a text without
features.  Repeated rows are scored each.  Without positives or without
unlabelled text nothing is learned and every score is 0.  Labels with a null
toxic or id are ignored; a document with conflicting labels is a positive.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batches, free_name, held_out, same_columns

BUCKETS = 1 << 20
#: Most documents the model is fitted on.
POSITIVES, UNLABELLED = 4000, 12000
#: Most features the model has, and the least likelihood ratio of one.
FEATURES, MIN_RATIO = 1000, 15.0
#: Weights at the start are log-likelihood ratios between 0 and this.
START = 1.0
#: Steps over the whole sample: the correction is sound where the risks are, not in small batches.
STEPS, RATE = 300, 0.02
BETA, GAMMA = 0.0, 1.0
_STRIP = ".,;:!?\"'()[]{}<>«»¡¿*#$%&|-_/\\"


def word_features(word: str) -> tuple[int, ...]:
    w = word.strip(_STRIP)
    if not w:
        return ()
    parts = [f"w{w}", *[f"p{w[:k]}" for k in (4, 5, 6) if len(w) >= k]]
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts)


class FeatureReader:
    """Text -> distinct feature ids; words seen lately are kept, within a bound."""

    def __init__(self, keep: int = 200_000):
        self.keep, self.known = keep, {}

    def __call__(self, text: str | None) -> np.ndarray:
        out: set[int] = set()
        known = self.known
        for w in set((text or "").lower().split()):
            f = known.get(w)
            if f is None:
                if len(known) >= self.keep:
                    known.clear()
                f = known[w] = word_features(w)
            out.update(f)
        return np.fromiter(out, np.int32, len(out))


class Model:
    """Weights by feature bucket (0 for most), and a bias."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float):
        self.ids, self.weights, self.bias = ids, weights, bias

    def dense(self) -> np.ndarray:
        w = np.zeros(BUCKETS, np.float32)
        w[self.ids] = self.weights
        return w


def distinct_rows(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of other features than every earlier one, so that copies don't pass
    for independent evidence; empty ones go.  Digests of rows are held, not rows."""
    seen, out = set(), []
    for r in rows:
        key = hashlib.blake2b(np.sort(r), digest_size=16).digest()
        if len(r) and key not in seen:
            seen.add(key)
            out.append(r)
    return out


def counts(rows: list[np.ndarray]) -> np.ndarray:
    """How many rows hold each bucket, some rows at a time: no copy of all is made."""
    total = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(rows), 500):
        total += np.bincount(np.concatenate(rows[i:i + 500]), minlength=BUCKETS)
    return total


def select_features(pos: list[np.ndarray], unl: list[np.ndarray], most: int) -> np.ndarray:
    """Buckets held by surely more positives than unlabelled documents: those with
    the largest likelihood ratio of the positives' count against a Poisson count
    at the unlabelled rate, raised where positives are longer."""
    size = lambda rows: np.mean([len(r) for r in rows])
    k, rate = counts(pos).astype(float), (counts(unl) + 0.5) / (len(unl) + 1)
    mean = rate * len(pos) * max(1.0, size(pos) / size(unl))
    ratio = np.where(k > mean, 2 * (k * np.log(np.maximum(k, 1) / mean) - (k - mean)), 0.0)
    best = np.argsort(-ratio, kind="stable")[:most]
    return np.sort(best[ratio[best] > MIN_RATIO])


class Risk:
    """The non-negative PU risk of a linear model (weights, then the bias) over
    sparse binary features; positives come first in ``rows``."""

    def __init__(self, rows: list[np.ndarray], n_pos: int, prior: float):
        self.flat = np.concatenate(rows).astype(np.int64)
        self.owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n, self.n_p, self.prior = len(rows), n_pos, prior

    def scores(self, theta: np.ndarray) -> np.ndarray:
        z = np.bincount(self.owner, theta[self.flat], self.n) + theta[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def negative(self, s: np.ndarray) -> float:
        """The estimated risk of the negatives, which may fall below zero."""
        return s[self.n_p:].mean() - self.prior * s[:self.n_p].mean()

    def of(self, s: np.ndarray) -> float:
        return self.prior * (1 - s[:self.n_p]).mean() + max(0.0, self.negative(s))

    def slope(self, s: np.ndarray, features: int) -> np.ndarray:
        n_p, n_u = self.n_p, self.n - self.n_p
        d = s * (1 - s)  # sigmoid loss: l(+) = 1 - s, l(-) = s; bounded, so a prior somewhat off does little
        if self.negative(s) >= -BETA:
            g = np.append(-2 * self.prior * d[:n_p] / n_p, d[n_p:] / n_u)
        else:
            g = GAMMA * np.append(self.prior * d[:n_p] / n_p, -d[n_p:] / n_u)
        return np.append(np.bincount(self.flat, g[self.owner], features), g.sum())


def first_weights(pos: list[np.ndarray], unl: list[np.ndarray], ids: np.ndarray, prior: float) -> np.ndarray:
    """Log-likelihood ratios of the features ``ids`` between positives and the
    rest of the unlabelled documents, between 0 and ``START``."""
    share = lambda rows, add: (counts(rows)[ids] + add) / (len(rows) + 2 * add)
    rest = np.maximum(share(unl, 0.0) - prior * share(pos, 0.0), 0.0) + 0.5 / len(unl)
    return np.clip(np.log(share(pos, 0.5)) - np.log(rest), 0.0, START)


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, steps: int = STEPS, rate: float = RATE,
             features: int = FEATURES) -> Model | None:
    """Adam on the non-negative PU risk over sparse binary features."""
    pos, unl = distinct_rows(pos), distinct_rows(unl)
    if not pos or not unl:
        return None
    ids = select_features(pos, unl, features)
    slot = np.full(BUCKETS, -1, np.int32)
    slot[ids] = np.arange(len(ids))
    risk = Risk([r[r >= 0] for r in (slot[d] for d in pos + unl)], len(pos), prior)
    theta = np.append(first_weights(pos, unl, ids, prior), 0.0)
    z = np.bincount(risk.owner, theta[risk.flat], risk.n)[len(pos):]
    starts = [np.append(theta[:-1], -c - 0.5) for c in np.quantile(z, np.linspace(0.5, 0.995, 60))]
    theta = min(starts, key=lambda t: risk.of(risk.scores(t)))
    least, best = np.inf, theta
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 2):
        s = risk.scores(theta)
        if t % 10 == 1 and (now := risk.of(s)) < least:
            least, best = now, theta.copy()
        grad = risk.slope(s, len(ids))
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        theta = theta - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return Model(ids.astype(np.int32), best[:-1].astype(np.float32), float(best[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float | None = None,
          positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Fit on documents outside the held-out fold; None if nothing can be learned.
    The sampled documents' feature ids, a bounded number, meet in one task; only the
    model reaches the driver."""
    lab = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
           .groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("__toxic")))
    n_pos, n_lab = lab.agg(F.sum((F.col("__toxic") == 1).cast("long")), F.count(F.lit(1))).first()
    if not n_pos:
        return None
    prior = min(0.9, n_pos / n_lab) if prior is None else prior
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    d = d.filter(F.col("id").isNotNull() & ~held_out(F.col("id")))
    n_all = d.count()

    def drawn(key, most, total):  # by hash; what comes above the bound (also where rows repeat an id) is cut in read()
        return F.pmod(F.xxhash64(key, F.lit(71)), F.lit(1 << 30)) < F.lit(int(min(1.0, 1.05 * most / max(1, total)) * (1 << 30)))

    # the drawn ids are about ``positives`` in number whatever the input, so they are broadcast
    ids = F.broadcast(lab.filter((F.col("__toxic") == 1) & drawn("__id", positives, n_pos)).select("__id"))
    pos = d.join(ids, F.col("id") == F.col("__id")).drop("__id")
    unl = d.filter(drawn("id", unlabelled, n_all))  # of all documents, as the risk estimator asks

    def read(frame, most, positive):
        def run(batches):
            reader = FeatureReader()
            for b in as_batches()(batches):
                yield pa.RecordBatch.from_arrays([pa.array([reader(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["f"])

        return frame.mapInArrow(run, "f binary").limit(most).select("f", F.lit(positive).alias("positive"))

    # the drawn rows meet in one task and not in the driver, which would keep their memory for the rest of the job
    both = read(pos, positives, True).unionByName(read(unl, unlabelled, False))
    got = both.coalesce(1).mapInArrow(fit_batches(prior), "ids array<int>, weights array<float>, bias double").first()
    return Model(np.array(got.ids, np.int32), np.array(got.weights, np.float32), got.bias) if got else None


def fit_batches(prior: float):
    """A function for ``mapInArrow``: all batches of ``f, positive`` (feature ids and
    whether the row is a drawn positive) -> a row of the fitted model, or none."""
    def run(batches):
        rows = {True: [], False: []}
        for b in batches:
            for f, positive in zip(b.column(0), b.column(1).to_pylist()):
                rows[positive].append(np.frombuffer(f.as_buffer(), np.int32))
        model = fit_nnpu(rows[True], rows[False], prior) if rows[True] and rows[False] else None
        if model is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([model.ids], pa.list_(pa.int32())), pa.array([model.weights], pa.list_(pa.float32())), pa.array([model.bias])],
                names=["ids", "weights", "bias"])

    return run


def score(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the score (0 to 1) in ``out``."""
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, bias, reader = shared.value.dense(), shared.value.bias, FeatureReader()
        for texts in batches:
            z = np.array([w[reader(t)].sum(dtype=np.float64) for t in texts], np.float64) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(out, scored(F.col(text_col)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with score and prediction."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.select("doc_id", "text"), model).withColumn("held_out", held_out(F.col("doc_id")))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score below 0.5."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs, "__score")
    return same_columns(score(docs, model, out=name).filter(F.col(name) < 0.5), docs.columns)

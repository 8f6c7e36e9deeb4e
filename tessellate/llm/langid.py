"""Operator 8: language identification by multinomial naive Bayes over hashed
character n-grams.

N-grams of one to three letters (with word ends) are hashed to ``BUCKETS``
columns in numpy.  Training counts them by language on at most ``TRAIN``
documents drawn by hash (a documented bound); every task adds its documents up
before it emits counts.  The matrix of log probabilities (languages times
buckets, at most ``LANGUAGES`` rows) is broadcast, and batches are scored by
sparse sums: one gather and one segmented sum per block of texts.

Defined results.  A null text or one without any letter is ``und`` with score
0.  Repeated rows are scored each.  Null languages and ids are not learned
from.  With no training rows every text is ``und``.  Ties go to the language
that sorts first.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batches, held_out

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Most documents the model is fitted on, and languages it holds.
TRAIN, LANGUAGES = 60_000, 500
SMOOTHING = 0.5
#: Characters looked at together.
BLOCK = 1 << 18
UNDETERMINED = "und"


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with each run of other characters as
    one zero, between two zeros."""
    t = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    keep = _is_letter(t)
    t = np.where(keep, t, 0)
    run = np.r_[True, keep[1:] | keep[:-1]] if len(t) else np.zeros(0, bool)
    return np.concatenate([[0], t[run], [0]]).astype(np.uint64)


_LETTER = np.zeros(0x110000, np.int8)  # 0 not looked up, 1 letter, -1 other


def _is_letter(points: np.ndarray) -> np.ndarray:
    got = _LETTER[points]
    if not got.all():
        for p in np.unique(points[got == 0]):
            _LETTER[p] = 1 if chr(p).isalpha() else -1
        got = _LETTER[points]
    return got > 0


def ngrams(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Hashed n-grams of the whole text, in blocks of bounded size."""
    points = _letters(text)
    top = max(ORDERS)
    for i in range(0, len(points), BLOCK):
        t = points[i:i + BLOCK + top - 1]  # blocks overlap: no n-gram is lost or counted twice
        out = []
        for n in ORDERS:
            m = min(len(t), BLOCK + n - 1) - n + 1
            if m <= 0:
                continue
            h, any_letter = np.full(m, n, np.uint64), np.zeros(m, bool)
            for k in range(n):
                h = (h ^ t[k:k + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                any_letter |= t[k:k + m] > 0
            out.append((h[any_letter] % np.uint64(buckets)).astype(np.int64))
        yield np.concatenate(out) if out else np.zeros(0, np.int64)


class Model:
    def __init__(self, languages: list[str], log_p: np.ndarray):
        self.languages, self.log_p = languages, log_p  # log_p[bucket, language]

    def posterior(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(best language or -1, its probability) of each text."""
        best, prob = np.full(len(texts), -1), np.zeros(len(texts))
        total, has = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        hold, owner, size = [], [], 0

        def flush():
            if hold:
                g = np.concatenate(hold)
                ends = np.cumsum([len(x) for x in hold])
                sums = np.add.reduceat(self.log_p[g], np.r_[0, ends[:-1]], axis=0, dtype=np.float64)
                np.add.at(total, owner, sums)
                has[owner] = True
            hold.clear(), owner.clear()

        for i, text in enumerate(texts):
            for g in ngrams(text or ""):
                if len(g):
                    hold.append(g), owner.append(i)
                    size += len(g)
                    if size >= BLOCK:
                        flush()
                        size = 0
        flush()
        if self.languages and has.any():
            z = total[has]
            k = z.argmax(axis=1)
            best[has] = k
            prob[has] = 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)
        return best, prob


def shares(sizes: list[int], most: int) -> list[float]:
    """Rows to take of each size, ``most`` in all: the small ones whole, the
    others alike."""
    left, out = float(most), [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    for k, i in enumerate(order):
        out[i] = min(float(sizes[i]), left / (len(order) - k))
        left -= out[i]
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN) -> Model:
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    d = d.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    sizes = d.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    share = {lang: min(1.0, rows / n) for (lang, n), rows in zip(sizes, shares([n for _, n in sizes], most))}
    if any(x < 1 for x in share.values()):
        table = F.create_map(*[x for lang, p in share.items() for x in (F.lit(lang), F.lit(int(p * (1 << 30))))])
        d = d.filter(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 30)) < F.try_element_at(table, F.col("lang")))

    def run(batches):
        counts: dict[str, np.ndarray] = {}

        def rows(lang, c):
            at = np.flatnonzero(c)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())],
                                              names=["lang", "bucket", "n"])

        for b in as_batches()(batches):
            for text, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if lang not in counts and len(counts) >= LANGUAGES:  # bounded memory: what is held goes out first
                    yield from (rows(k, c) for k, c in counts.items())
                    counts.clear()
                c = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for g in ngrams(text):
                    c += np.bincount(g, minlength=BUCKETS)
        yield from (rows(k, c) for k, c in counts.items())

    sums = d.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(share)
    got = sums.toArrow()
    counts = np.zeros((BUCKETS, len(langs)))
    if got.num_rows:
        column = np.searchsorted(np.array(langs, object), np.array(got.column("lang").to_pylist(), object))
        counts[got.column("bucket").to_numpy(), column] = got.column("n").to_numpy()
    log_p = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)
    return Model(langs, log_p)


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct of lang and score in ``out``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = np.array([*shared.value.languages, UNDETERMINED], object)
        for texts in batches:
            best, prob = shared.value.posterior(texts.tolist())
            yield pd.DataFrame({"lang": names[best], "score": prob})

    return docs.withColumn(out, scored(F.col(text_col)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with predicted language and score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), train(docs)).withColumn("held_out", held_out(F.col("doc_id")))
    return out.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellate.llm import packing as P
from tessellate.llm.tokens import encoder, vocabulary_path

from .conftest import ODD


def _reference_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    return [np.array(e.ids + [0], "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_those_of_the_vocabulary():
    texts = ["", "Hello  world\n\n don't 123 !!", "é ß 漢字   \t", "<|endoftext|>x", "a" * 5000, "\n" * 300 + "x  "]
    for ids, want in zip(map(encoder(), texts), _reference_ids(texts)):
        assert ids.tolist() == want[:-1].tolist()


def test_long_runs_of_blanks():
    texts = [" " * 1_100_000 + "x", "a" + "\n" * 1_500_000]
    for ids, want in zip(map(encoder(), texts), _reference_ids(texts)):
        assert ids.dtype == np.uint32 and ids.tolist() == want[:-1].tolist()


def test_added_tokens_are_those_of_an_unmodified_tokenizer(make_docs):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>  \n y", "<|endoftext", "<|ENDOFTEXT|>", "plain",
             " " * 1_100_000 + "<|endoftext|>x"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert 50256 in want[0]
    assert [ids.tolist() for ids in map(encoder(added=True), texts)] == want
    got = P.pieces(make_docs(list(enumerate(texts[:6])))).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in got} == {
        i: (len(w) + 1, zlib.crc32(np.array([*w, 0], "<u4").tobytes())) for i, w in enumerate(want[:6])}


def test_cut():
    assert P.cut(1, 4) == [(0, 1)] and P.cut(4, 4) == [(0, 4)] and P.cut(5, 4) == [(0, 1), (1, 4)] and P.cut(8, 4) == [(0, 4), (4, 4)]


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(100, 1000, 10_000), (100, 3, 10_000), (100, 1000, 2500)])
def test_best_fit_obeys_every_capacity(score, caps):
    rnd = random.Random(1)
    top = min(100, int(caps[2] ** 0.5))
    lengths = np.array([rnd.randint(1, top) for _ in range(3000)] + [top] * 50 + [1] * 100)
    bins, offsets = P.best_fit(lengths, *caps, score=score)
    for b in range(bins.max() + 1):
        at = np.flatnonzero(bins == b)
        x = lengths[at][np.argsort(offsets[at])]
        assert len(at) and x.sum() <= caps[0] and len(x) <= caps[1] and (x ** 2).sum() <= caps[2]
        assert np.sort(offsets[at]).tolist() == (np.cumsum(x) - x).tolist()
    if caps == (100, 1000, 10_000):
        assert bins.max() + 1 <= 1.02 * lengths.sum() / 100


def test_documents_exact_round_trip(make_docs):
    rnd = random.Random(4)
    rows = list(ODD) + [(10 + i, " ".join(str(rnd.random()) for _ in range(rnd.choice([3, 40, 400])))) for i in range(60)]
    size = 256
    out = P.pack(P.pieces(make_docs(rows), size=size), tokens=size, group=50).toPandas()
    want = sorted((str(i), s, len(ids[s:s + n]), zlib.crc32(ids[s:s + n].tobytes()))
                  for (i, t), ids in zip(rows, _reference_ids([t or "" for _, t in rows])) for s, n in P.cut(len(ids), size))
    got = sorted((str(None if i != i else int(i)), s, n, c) for i, s, n, c in zip(out.doc_id, out.start, out.length, out.ids_crc32))
    assert got == want
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= size and g.offset.tolist() == (g.length.cumsum() - g.length).tolist()
    assert P.pack(P.pieces(make_docs([]))).count() == 0
    with pytest.raises(ValueError):
        P.pack(P.pieces(make_docs([])), attention=100)


def test_ids_beside_a_null_stay_whole_and_tiny_documents_fill_sequences(spark, make_docs):
    big = [(1 << 60) + 1, (1 << 60) + 3, None]
    got = P.pack(P.pieces(make_docs([(i, "some words") for i in big]))).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, big))
    many = spark.range(20_480).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    out = P.pack(P.pieces(many))
    assert out.select("sequence_id").distinct().count() == 10 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessellate.llm import simhash as S

from .conftest import ODD


def _slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def _classes(values, radius):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, v in enumerate(values):
        for j in range(i):
            if bin(v ^ values[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("text", [None, "", " \t ", "One", "one two", "a b c a b c a b c", "Ünï cödé wörds hére", "x " * 40_000])
def test_fingerprint(text):
    assert S.fingerprint(text) == _slow_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    got = spark.createDataFrame([("a b c",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got % (1 << 64) == xxh64_intdigest(b"a b c", 42)


def _near(rnd, n, centres=6):
    base = [rnd.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        v = rnd.choice(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5, 9])):
            v ^= 1 << rnd.randrange(64)
        out.add(v)
    return sorted(out)


def test_forest_finds_every_link():
    rnd = random.Random(0)
    shards = [np.array(_near(rnd, n), np.uint64) for n in (1, 2, 40, 150)]
    values = np.concatenate(shards)
    tree = np.repeat(np.arange(len(shards)), [len(s) for s in shards])
    roots, child = S.build_forest(values, tree)
    for radius in (0, 2, 4):
        got = {(int(a), int(b)) for q in range(len(values)) for x, y in S.search_forest(values, child, np.array([q]), roots[tree[[q]]], radius) for a, b in zip(x, y)}
        want = {(i, j) for i in range(len(values)) for j in range(len(values)) if tree[i] == tree[j] and bin(int(values[i]) ^ int(values[j])).count("1") <= radius}
        assert got == want


@pytest.mark.parametrize("max_shard", [4096, 16, 6])
def test_refined_shards_lose_no_link(spark, max_shard):
    values = _near(random.Random(5), 120)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    from tessellate.llm.components import connected_components
    links = S.link_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp bigint"), 2, max_shard)
    assert links.count() < 3 * 120 * 40  # stars, not pairs
    root = {r.node: r.root for r in connected_components(links).collect()}
    got = [root.get(v, v) for v in signed]
    want = _classes(values, 2)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_documents_against_brute_force(spark, make_docs):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    long = [rnd.choice(words) for _ in range(300)]
    rows = list(ODD) + [(100 + i, " ".join(long[:150] + ["x" * i] + long[150:])) for i in range(12)]
    rows += [(200 + i, " ".join(rnd.choice(words) for _ in range(60))) for i in range(30)] + [(300, "same words here"), (301, "SAME words here")]
    out = S.near_duplicates(make_docs(rows)).collect()
    assert len(out) == len(rows)
    fps = sorted({_slow_fingerprint(t) for _, t in rows})
    root = dict(zip(fps, _classes(fps, 2)))
    best = {}
    for i, t in rows:
        if i is not None:
            c = root[_slow_fingerprint(t)]
            best[c] = min(best.get(c, i), i)
    for r in out:
        assert r.component_id == best.get(root[r.fp % (1 << 64)])
    kept = S.stage_near_dedup(spark, make_docs(rows), "")
    assert kept.count() == len(set(root.values())) and kept.columns == make_docs([]).columns
    assert S.near_duplicates(make_docs([])).count() == 0 and S.stage_near_dedup(spark, make_docs([]), "").count() == 0

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tessellate.llm import periodic as P

from .conftest import ODD


def brute_runs(w, periods=4, least=6):
    """Every stretch tried at every period, straight from the definition."""
    n, out = len(w), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, periods * q) and (i, length) not in out:
                out[i, length] = q
            i = max(j, i + 1) if j > i else i + 1
    return sorted([(s, n, q) for (s, n), q in out.items()], key=lambda r: (r[0], r[2]))


def _codes(docs):
    sizes = np.array([len(d) for d in docs], np.int64)
    return np.array([x for d in docs for x in d], np.int64), sizes


@pytest.mark.parametrize("periods,least", [(4, 6), (2, 2), (3, 9)])
def test_runs_equal_brute_force(periods, least):
    rnd = random.Random(periods)
    docs = []
    for _ in range(400):
        base = [rnd.randint(1, rnd.choice([1, 2, 3, 6])) for _ in range(rnd.randint(0, 60))]
        if base and rnd.random() < 0.6:
            block = base[:rnd.randint(1, 9)]
            base += block * rnd.randint(2, 9) + block[:rnd.randint(0, len(block))] + [rnd.randint(1, 6) for _ in range(rnd.randint(0, 9))]
        docs.append(base)
    got = P.find_runs(*_codes(docs), periods, least)
    assert sum(map(len, got)) > 200
    for d, g in zip(docs, got):
        assert g == brute_runs(d, periods, least)


def test_long_and_nested_runs():
    inner = [1, 1, 1, 1, 1, 1, 2]
    docs = [[3] * 20_000, inner * 3000, list(range(1, 3001)) * 5, [], [7], list(range(1, 5000)), ([1, 2] * 200 + [3]) * 6]
    got = P.find_runs(*_codes(docs))
    assert got[0] == [(0, 20_000, 1)]
    assert (0, 21_000, 7) in got[1] and len(got[1]) == 3001
    assert got[2] == [(0, 15_000, 3000)] and got[3] == got[4] == got[5] == []
    assert got[6] == brute_runs(docs[6])


def test_many_positions_in_one_node_go_by_stretch_and_left_word():
    rnd = random.Random(5)
    docs = [[x for _ in range(60) for x in [1, 2, 3] * rnd.randint(2, 7) + [rnd.randint(4, 6)]] for _ in range(4)]
    for d, g in zip(docs, P.find_runs(*_codes(docs))):
        assert g == brute_runs(d)


def _expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    keep = [True] * n
    for s, length, q in runs:
        keep[s + q:s + length] = [False] * (length - q)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for x, k in zip(w, keep) if k)))


def test_query_equals_brute_force(spark, tmp_path, make_docs):
    rnd = random.Random(8)
    words = ["a", "b", "c d", "é", "x\x1cy", "　"]
    rows = [r for r in ODD if r[0] is not None and r[0] != 6] + [(6, "word " * 700)]
    rows += [(100 + i, rnd.choice([" ", "\n", "\t ", "\x0b"]).join(rnd.choice(words) for _ in range(rnd.choice([3, 40, 150])))) for i in range(600)]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = P.op11_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: str(r)
    assert sorted([tuple(r) for r in got], key=key) == sorted([(i, *_expected(i, t)) for i, t in rows], key=key)
    assert sum(r.n_runs > 0 for r in got) > 20


def test_odd_rows_and_empty_table(make_docs):
    out = P.repetitions(make_docs(ODD)).collect()
    assert len(out) == len(ODD) and sum(r.doc_id is None for r in out) == 2
    long = [r for r in out if r.n_words == 60_000]
    assert [tuple(x) for x in long[0].runs] == [(0, 60_000, 1)] and long[0].collapsed == "word"
    assert all(r.collapsed == "" and r.runs == [] for r in out if r.n_words == 0)
    assert P.repetitions(make_docs([])).count() == 0

import random

import numpy as np

from tessellate.llm import langid as L

from .conftest import ODD

LETTERS = {"aa": "abcdefgh", "bb": "efghijklé", "cc": "ßäöüklmn"}


def _text(rnd, lang, n=40):
    return " ".join("".join(rnd.choice(LETTERS[lang]) for _ in range(rnd.randint(2, 7))) for _ in range(n))


def test_ngrams_in_blocks_equal_whole(monkeypatch):
    text = _text(random.Random(0), "bb", 500)
    whole = np.sort(np.concatenate(list(L.ngrams(text))))
    monkeypatch.setattr(L, "BLOCK", 17)
    assert np.array_equal(np.sort(np.concatenate(list(L.ngrams(text)))), whole)


def test_languages_and_odd_rows(spark, make_docs):
    rnd = random.Random(1)
    rows = [(i, _text(rnd, lang), lang) for i, lang in enumerate(rnd.choice(sorted(LETTERS)) for _ in range(400))]
    docs = make_docs(rows + [(1000 + k, t, None) for k, (_, t) in enumerate(ODD)] + [(2000, "123 !?", "aa"), (2001, "abc", None)])
    out = {r.doc_id: r["found"] for r in L.identify(docs, L.train(docs), out="found").collect()}
    assert all(out[i].lang == lang for i, _, lang in rows) and all(0 <= v.score <= 1 for v in out.values())
    assert out[2000].lang == "und" and out[2000].score == 0 and out[1000].lang == "und" and out[1001].lang == "und"
    empty = L.train(make_docs([]))
    assert empty.languages == [] and {r.found.lang for r in L.identify(docs, empty, out="found").collect()} == {"und"}
    assert L.identify(make_docs([]), L.train(docs), out="found").count() == 0


def test_a_rare_language_is_learned_beside_common_ones(make_docs):
    rnd = random.Random(2)
    rows = [(i, _text(rnd, "cc" if i < 12 else rnd.choice(["aa", "bb"]), 12), None) for i in range(3000)]
    rows = [(i, t, "cc" if i < 12 else "aa" if set(t) <= set(LETTERS["aa"] + " ") else "bb") for i, t, _ in rows]
    docs = make_docs(rows)
    model = L.train(docs, most=100)
    assert model.languages == ["aa", "bb", "cc"]
    out = {r.doc_id: r["found"].lang for r in L.identify(docs, model, out="found").collect()}
    assert all(out[i] == "cc" for i in range(12)) and sum(out[i] == lang for i, _, lang in rows) > 2900


def test_small_languages_give_all_their_rows():
    assert L.shares([5, 1000, 10, 500], 100) == [5, 42.5, 10, 42.5] and L.shares([5, 6], 100) == [5, 6] and L.shares([], 5) == []

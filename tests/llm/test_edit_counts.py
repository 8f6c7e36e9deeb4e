import random

import pytest

from tessellate.llm import edit_counts as E

from .conftest import ODD

PARTS = ["a", "b", " ", "  ", "\n", "\n\n", " don't", "'l", "l", "12", " 7", "é", "ß", "!!", " ?", "\t", "word ", " the"]


@pytest.fixture(scope="module")
def pre():
    return E.PreTokens()


def _text(rnd, n):
    return "".join(rnd.choice(PARTS) for _ in range(n))


def test_edits_in_sequence_equal_a_full_count(pre):
    rnd = random.Random(1)
    for _ in range(400):
        text = _text(rnd, rnd.randint(0, 500))
        tree = E.Tree.of_text(text, pre)
        assert tree.sums[1, 1] == len(pre.encode(text))
        for _ in range(3):
            edits = [(s := rnd.randint(0, len(text) + 2), s + rnd.choice([0, 0, 1, 2, 5, 60, -1]), _text(rnd, rnd.choice([0, 1, 3, 30]))) for _ in range(rnd.randint(0, 6))]
            good, skipped = E.clean_edits(edits, len(text))
            want, at = [], 0
            for s, e, r in good:
                want += [text[at:s], r]
                at = e
            want = "".join([*want, text[at:]])
            text, tree, _ = E.apply_edits(text, tree, good, pre)
            assert text == want and len(good) + skipped == len(edits)
            assert tree.sums[1, 1] == len(pre.encode(text)) and tree.sums[1, 0] == len(text)


def test_only_the_region_is_encoded_again(pre):
    text = "some plain words in a row " * 4000
    tree = E.Tree.of_text(text, pre)
    _, _, encoded = E.apply_edits(text, tree, [(50_000, 50_004, "other")], pre)
    assert encoded < 1000


def test_overlaps_and_clipping():
    assert E.clean_edits([(5, 9, "x"), (0, 6, None), (20, 30, "y"), (3, 2, "z"), (None, 4, "w")], 10) == ([(0, 6, ""), (10, 10, "y")], 3)


def test_tables(spark, make_docs, pre):
    docs = make_docs(ODD + [(20, "write to a.b@c.example.org or +1 (578) 555-6437 now")])
    edits = E.redactions(docs).dropDuplicates()
    assert {(r.start, r.end, r.replacement) for r in edits.collect()} == {(9, 26, "<mail>"), (30, 47, "<number>")}
    edits = edits.drop("row_key")  # edits of ids, for all their rows
    extra = spark.createDataFrame([(1, 0, 0, "new text"), (4, 0, 5, None), (None, 0, 1, "x"), (999, 0, 1, "x")], edits.schema)
    out = E.recount(docs, E.build_trees(docs), edits.unionByName(extra))
    got = sorted((r.doc_id, r.n_tokens_before, r.n_tokens, r.n_edits) for r in out.collect() if r.doc_id is not None)
    want = []
    for i, t in ODD + [(20, "write to a.b@c.example.org or +1 (578) 555-6437 now")]:
        if i is not None:
            t = t or ""
            new, n = {1: ("new text" + t, 1), 4: (t[5:], 1), 20: ("write to <mail> or <number> now", 2)}.get(i, (t, 0))
            want.append((i, len(pre.encode(t)), len(pre.encode(new)), n))
    assert got == sorted(want) and out.count() == len(ODD) + 1
    none = make_docs([])
    assert E.recount(none, E.build_trees(none), edits).count() == 0


def test_texts_under_one_id_keep_their_own_edits(make_docs, pre):
    texts = ["write to a.b@c.example.org", "no address in this text at all, but many words", "call +1 (578) 555-6437"]
    docs = make_docs([(7, t) for t in texts] + [(None, texts[0]), (None, texts[1])])
    out = E.recount(docs, E.build_trees(docs), E.redactions(docs).dropDuplicates())
    new = {texts[0]: "write to <mail>", texts[1]: texts[1], texts[2]: "call <number>"}
    want = [(i, len(pre.encode(t)), len(pre.encode(new[t]))) for i, t in [(7, t) for t in texts] + [(None, texts[0]), (None, texts[1])]]
    assert sorted(map(str, ((r.doc_id, r.n_tokens_before, r.n_tokens) for r in out.collect()))) == sorted(map(str, want))

import hashlib
import random
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from tessellate.llm import align as A
from tessellate.llm.tokens import _byte_letters

from .conftest import ODD


def _plain(a, b):
    """Overlaps and common ends by trying every pair."""
    sa, sb = [0, *a[:-1]], [0, *b[:-1]]
    return ({(i, j) for i in range(len(a)) for j in range(len(b)) if max(sa[i], sb[j]) < min(a[i], b[j])},
            [x in set(b) for x in a], [x in set(a) for x in b])


@pytest.mark.parametrize("steps", [1, 2, 3, 7, 1000])
def test_pieces_equal_every_pair(steps):
    rnd = random.Random(steps)
    for _ in range(150):
        n = rnd.randint(1, 60)
        a, b = (np.array(sorted({*rnd.sample(range(1, n + 1), rnd.randint(0, n)), n})) for _ in range(2))
        left, right, both_a, both_b = A.overlaps(a, b, steps)
        want = _plain(a.tolist(), b.tolist())
        assert sorted(zip(left.tolist(), right.tolist())) == sorted(want[0])
        assert both_a.tolist() == want[1] and both_b.tolist() == want[2]
        i, j = A.diagonals(a, b, steps)
        assert (np.diff(i + j)[:-1] == steps).all() and i[-1] == len(a) and j[-1] == len(b)


@lru_cache
def _libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    from tessellate.llm.tokens import vocabulary_path

    t = Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


def _tokens(text):
    """Ids and bytes of the tokens of both sides by the plain libraries, or None."""
    if not text:
        return None
    t, s = _libraries()
    e = t.encode(" " + text, add_special_tokens=False)
    letters = _byte_letters()
    a = [(i, bytes(letters[c] for c in p)) for i, p in zip(e.ids, e.tokens)]
    b = [(i, bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()) for i in s.encode(text)]
    if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
        return None
    return a, b


def _expected(rows):
    docs, count, best = [], Counter(), defaultdict(int)
    for i, text in rows:
        both = _tokens(text)
        if both is None:
            docs.append((i, 0, 0, 0, [], ""))
            continue
        a, b = both
        links, groups = [], [[[], []]]
        x = y = p = q = 0
        while x < len(a):  # byte by byte along both sides
            links.append((a[x][0], b[y][0]))
            ea, eb = p + len(a[x][1]), q + len(b[y][1])
            if ea <= eb:
                groups[-1][0].append(a[x][0])
                x, p = x + 1, ea
            if eb <= ea:
                groups[-1][1].append(b[y][0])
                y, q = y + 1, eb
            if ea == eb and x < len(a):
                groups.append([[], []])
        text_of = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        docs.append((i, len(a), len(b), len(groups), links, hashlib.sha256(text_of.encode()).hexdigest()))
        count.update(set(links))
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(i, na, nb, g, len(ls), sum(count[x] == best[x[0]] for x in ls), sum(count[x] for x in ls), h) for i, na, nb, g, ls, h in docs]


def test_query_equals_plain_alignment(spark, tmp_path, make_docs):
    rnd = random.Random(3)
    words = ["the", "The", "antidisestablishmentarianism", "naïve", "漢字", "  ", "\n\n", "x" * 40, "1234567", "<|endoftext|>", "<s>", "<0x41>",
             "▁", "🙂🙃", "\x00", "don't", "é"]
    rows = [r for r in ODD if r[0] != 6] + [(6, "word " * 500), (70, "a▁b"), (71, "\t"), (72, " lead"), (73, "trail \n ")]
    rows += [(100 + i, rnd.choice([" ", "", "\n"]).join(rnd.choice(words) for _ in range(rnd.choice([1, 5, 60])))) for i in range(120)]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in A.op12_token_alignment(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(_expected(rows), key=str)
    assert sum(r[1] == 0 for r in got) >= 5 and sum(r[1] > 0 for r in got) > 70


def test_heavy_and_other_pairs_meet_alike(spark, make_docs, monkeypatch):
    rows = [(i, "the cat and the hat " * 3 + f"n{i % 7}") for i in range(40)]
    t = A.materialise(A.align(make_docs(rows)).withColumn("row", A.F.col("doc_id")), "t")
    counts = A.materialise(A.pair_counts(t), "c")
    want = sorted(map(tuple, A.score(t, counts).collect()))
    for heavy in (1, 20, 10_000):
        monkeypatch.setattr(A, "HEAVY", heavy)
        assert sorted(map(tuple, A.score(t, counts).collect())) == want


def test_pieces_of_any_length_and_empty_table(make_docs):
    rows = [(i, t) for i, t in enumerate(["one two three", "", None, "x" * 3000, "word " * 3000, "é漢" * 50])]
    want = sorted(map(str, A.align(make_docs(rows)).collect()))
    assert sorted(map(str, A.align(make_docs(rows), steps=5).collect())) == want
    assert A.align(make_docs([])).count() == 0

import random
import re
from collections import Counter

from tessellate.llm import quality as Q

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(t):
    t = t or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    rep = {j for i in range(len(w) - 4) if c[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep),
            len(w) < 10 or 100 * len(rep) > 20 * len(w))


def test_statistics_against_brute_force(make_docs):
    rnd = random.Random(3)
    rows = [r for r in ODD if r[0] != 6] + [(6, "w%d " * 3000 % tuple(rnd.randrange(40) for _ in range(3000)))]
    for i in range(120):
        words = [rnd.choice(["a", "b", "cc", "d|", "<e>", "é x", "\n", "\n\n", "\x0b", "#"]) for _ in range(rnd.randint(0, 90))]
        rows.append((100 + i, rnd.choice([" ", "\t", "  "]).join(words)))
    out = Q.statistics(make_docs(rows)).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == sorted((str(i), *_brute(t)) for i, t in rows)


def test_rules_are_learned_and_applied(spark, make_docs):
    rnd = random.Random(5)
    words = [f"wort{i}" for i in range(900)]
    rows = []
    for i in range(900):
        w = rnd.sample(words, rnd.randint(12, 60))
        if i % 6 == 0:
            w = [x + "%%%" for x in w]
        elif i % 6 == 1:
            w = [x.upper() for x in w]
        rows.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, int(i % 6 > 1), 0) for i in range(700)] + [(None, 0, 0), (800, None, 0)], "doc_id bigint, quality int, toxic int")
    out = {r.doc_id: r for r in Q.judge(make_docs(rows), labels).collect()}
    assert len(out) == 900 and all(out[i].kept == (i % 6 > 1) for i in range(900))
    assert {out[0].rule is None, out[1].rule is None, out[2].rule is None} == {False, True} and out[2].rule is None


def test_without_labels_the_base_rule_alone(spark, make_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = Q.judge(make_docs(ODD), none).collect()
    assert len(out) == len(ODD) and all(r.kept == (not r.base_failed) for r in out)
    good = spark.createDataFrame([(4, 1, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert Q.judge(make_docs(ODD), good).filter("kept = base_failed").count() == 0
    assert Q.judge(make_docs([]), good).count() == 0

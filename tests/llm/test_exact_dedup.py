import hashlib
import string
import uuid

from .conftest import ODD
from tessellate.llm import exact_dedup as E

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _index(spark):
    return E.DigestIndex(spark, f"t_{uuid.uuid4().hex}")


def test_decisions_against_brute_force(spark, make_docs):
    out = _index(spark).admit(make_docs(ODD)).collect()
    assert len(out) == len(ODD)
    norm = [(i, (t or "").translate(LOWER)) for i, t in ODD]
    groups = {}
    for i, t in norm:
        groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(i)
    for r in out:
        ids = groups[r.text_sha256]
        best = max((i for i in ids if i is not None), default=None)
        assert r.keep_id == best and r.group_size == len(ids)
    for digest, ids in groups.items():
        assert sum(r.kept for r in out if r.text_sha256 == digest) == 1


def test_second_batch_meets_the_index(spark, make_docs):
    index = _index(spark)
    index.admit(make_docs([(1, "a"), (2, "b")]))
    out = {r.doc_id: (r.keep_id, r.kept) for r in index.admit(make_docs([(9, "A"), (8, "c"), (7, "C")])).collect()}
    assert out == {9: (1, False), 8: (8, True), 7: (8, False)}
    assert spark.table(index.table).count() == 3
    empty = index.admit(make_docs([]))
    assert empty.count() == 0 and spark.table(index.table).count() == 3


def test_stage_keeps_one_row_of_each_text(spark, make_docs):
    docs = make_docs(ODD)
    out = E.stage_exact_dedup(spark, docs, "")
    assert out.columns == docs.columns
    texts = [(r.text or "").translate(LOWER) for r in out.collect()]
    assert sorted(texts) == sorted({(t or "").translate(LOWER) for _, t in ODD})
    assert E.stage_exact_dedup(spark, make_docs([]), "").count() == 0


def test_a_batch_admitted_again_under_its_name_keeps_the_same_rows(spark, make_docs):
    index = _index(spark)
    index.admit(make_docs([(1, "a")]), name="first").collect()
    rows = [(5, "A"), (6, "b"), (7, "B"), (8, None), (None, "c")]
    once = sorted(map(str, index.admit(make_docs(rows), name="second").collect()))
    size = spark.table(index.table).count()
    # the driver was lost after the append: the batch comes again, its rows in another order
    again = index.admit(make_docs(rows[::-1]), name="second")
    assert sorted(map(str, again.collect())) == once and spark.table(index.table).count() == size == 4
    assert not any(r.kept for r in index.admit(make_docs(rows), name="third").collect())
    index.drop()
    assert not spark.catalog.tableExists(index.table) and sorted(map(str, again.collect())) == once

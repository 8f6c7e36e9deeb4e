import os

import pytest

SF = "/root/testdata/sf0.001"

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, digest string, fp string, score double, __row_key string, __cell string, __mix string, __score string"


@pytest.fixture
def make_docs(spark):
    """Rows (doc_id, text[, lang, source]) as documents with extra columns whose
    names clash with those that the operators use inside."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""),
                 "x", "x", "x", 0.5, "k", "c", "m", "s") for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


#: Null ids and texts, empty and blank texts, repeated rows, one very long text.
ODD = [(1, None), (2, ""), (3, "  \n "), (4, "Hello World again"), (4, "Hello World again"), (5, "hello world again"),
       (None, "hello world AGAIN"), (None, None), (6, "word " * 60_000), (7, "é" * 30), (8, "É" * 30)]

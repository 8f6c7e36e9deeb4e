import zlib

from .conftest import ODD, SF


def test_stages_and_run(spark, make_docs):
    import corpus_pipeline
    from tessellate.llm.common import materialise
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing to target weights", "best-fit packing"]
    docs, n = make_docs(ODD), len(ODD)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, SF), "test-stage")
        assert out.columns == docs.columns and out.count() <= n
        docs, n = out, out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_run_packs_only_given_documents(spark):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, SF).toPandas()
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(out.doc_id) <= ids and len(out) and (out.groupby("sequence_id").length.sum() <= 2048).all()
    assert (out.ids_crc32 > 0).any() and zlib.crc32(b"") == 0


def test_queries_are_registered():
    import __spark_entry__ as E
    q, sql = E.queries(), E.oracle_sql()
    assert {int(k[2:].split("_")[0]) for k in q if k.startswith("op")} == set(range(1, 14)) and "pipeline" in q
    assert "op10_exact_dedup" in sql and "op6_url_filters" in sql

from collections import Counter

import pytest
from conftest import SF, duck, same

from graphloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_duckdb(spark, name):
    assert same([r.asDict() for r in queries.QUERIES[name](spark, SF).collect()], duck(queries.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_one_row_for_each_document(spark, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == [r["doc_id"] for r in duck("SELECT doc_id FROM documents ORDER BY doc_id")]


def test_pipeline(spark, docs, none):
    import corpus_pipeline

    assert [f for _, f in corpus_pipeline.STAGES] == [corpus_pipeline.identify_language, corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources, corpus_pipeline.encode_bytes]
    for start in (docs, none, spark.read.parquet(f"{SF}/documents.parquet")):
        at = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            after = stage(spark, at, SF)
            assert i == 4 or after.columns == start.columns
            if i < 3:
                key = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
                before, later = key(at), key(after)
                assert not later - before
            at = after
        at.count()
    full = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.identify_language(spark, full, SF).count() == full.count()
    assert corpus_pipeline.run(spark, SF).count() > 0

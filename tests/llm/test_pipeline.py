"""The pipeline's contract on driver tables (test_pipeline_rows.py holds its rows against plain Python), and the queries' SQL."""

import os

import pytest

import corpus_pipeline
from vicinal.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= count, name
        count = docs.count()
    final = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and final.count() == count
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, final.collect()))


def test_clean_documents_stay(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    long_and_good = docs.join(labels.where("quality = 1"), "doc_id").where("size(split(text, ' ')) >= 40").select("doc_id")
    kept = corpus_pipeline.quality_rules(spark, docs, DATA).select("doc_id")
    assert long_and_good.join(kept, "doc_id", "left_anti").count() <= 0.02 * long_and_good.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA), con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(str(tuple(r[i] for i in places)) for r in want.fetchall())

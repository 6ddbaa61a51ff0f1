"""Each query runs at the smallest size, and its SQL, where there is some, gives the same rows."""

import duckdb
import pytest

import corpus_pipeline
from retort.llm import queries

D, PIPELINE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "documents pages benchmark labels embeddings".split()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, D).toPandas()
    assert len(got)
    if name in queries.SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
        want = con.sql(queries.SQL[name]).df()
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns
        rows = lambda x: sorted(map(str, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None)))
        assert rows(got) == rows(want)


def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark):
    docs = spark.read.parquet(f"{PIPELINE}/documents.parquet")
    ids = [set(r.doc_id for r in docs.collect())]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, PIPELINE)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        docs = docs.cache()
        ids.append(set(r.doc_id for r in docs.collect()))
        assert ids[-1] <= ids[-2]
    labels = spark.read.parquet(f"{PIPELINE}/labels.parquet")
    bad = {r.doc_id for r in labels.where("quality = 0").collect()} & ids[0]
    assert len(bad & ids[1]) <= 0.2 * len(bad)
    good = {r.doc_id for r in labels.where("quality = 1").collect()} & ids[0]
    assert len(good - ids[1]) <= 0.05 * len(good)
    assert {r["size"] - 16 for r in docs.collect()} == {len((r.text or "").encode()) for r in docs.collect()}

"""Each pipeline stage on nulls, empty and long texts, repeated rows, clashing columns and an empty table."""

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, int(k % 4 > 0), 0) for k in range(60)] + [(100, 0, 0), (None, 1, 1), (5, None, None), (7, 1, 0)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    items = [(1, "these words stand in no document of all the ones that there are here"), (2, None), (None, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage_on_edge_cases(spark, folder, edge_docs, no_docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, edge_docs, folder)
    rows = got.collect()
    before = {(r.doc_id, r.text) for r in edge_docs.collect()}
    assert {(r.doc_id, r.text) for r in rows} <= before
    if k < len(corpus_pipeline.STAGES) - 1:
        assert tuple(got.columns) == corpus_pipeline.COLUMNS
    if name == "near duplicates":
        ids = [r.doc_id for r in rows]
        assert len(ids) == len(set(ids)) and None in ids
        assert ids.count(110) == 1 and not {111, 112, 113, 114} & set(ids) and {100, 101, 102} <= set(ids)
    if name == "benchmark decontamination":
        assert len(rows) == edge_docs.count()
    if name == "sharding":
        assert len(rows) == edge_docs.count() and all(0 <= r.shard < 40 for r in rows)
    assert stage(spark, no_docs, folder).count() == 0


def test_near_copies_leave_one(spark, folder):
    text = " ".join(f"w{k}" for k in range(100))
    docs = spark.createDataFrame([(k, text + f" end{k}", "en", "s", 1) for k in range(9)] + [(50, "something else entirely, of a few words", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert sorted(r.doc_id for r in got.collect()) == [0, 50]


def test_leaks_go_and_the_rest_stays(spark, folder):
    item = "these words stand in no document of all the ones that there are here"
    docs = spark.createDataFrame([(1, "before it " + item + " and after", "en", "s", 1), (2, "words that stand in a document of their own, all of them", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.benchmark_decontamination(spark, docs, folder).collect()] == [2]

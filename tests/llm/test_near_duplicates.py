"""The stage judges rows: repeats of an id, null ids, and different texts of one id."""

import corpus_pipeline
from tests.llm.test_operators import A, B, docs


def test_near_duplicates_by_row(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, A), (1, A), (2, A), (None, A), (None, B), (None, B), (7, long), (8, long + " end"), (8, B + " and nothing else at all in here"), (9, None), (9, None), (None, "")]
    got = corpus_pipeline.near_duplicate_stage(spark, docs(spark, rows), "")
    assert got.columns == docs(spark, rows).columns
    want = [(1, A), (None, B), (7, long), (8, rows[8][1]), (9, None), (9, None), (None, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_near_duplicates_of_plain_ids(spark):
    rows = [(1, A), (1, A), (2, A), (3, B), (4, None), (5, "")]
    got = corpus_pipeline.near_duplicate_stage(spark, docs(spark, rows), "")
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == [(1, A), (3, B), (4, None), (5, "")]


def test_texts_are_dealt_alike_at_every_size(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine {i // 2}", "en", "s", 9) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4]

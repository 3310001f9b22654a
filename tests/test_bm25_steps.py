"""BM25 carries the terms that an issue asks for, and matches of a document are summed up where it lies."""

from pyspark.sql import functions as F

from orrery.operators import retrieval
from orrery.plans import text_plans as X

D = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_of_no_task_count_together(spark):
    tf = spark.createDataFrame([("a", "p", 2), ("a", "x", 1), ("a", "y", 3), ("b", "q", 1), ("b", "x", 4)], "doc string, term string, tf long")
    less = spark.createDataFrame([("a", "p", 2), ("a", None, 4), ("b", "q", 1), ("b", None, 4)], "doc string, term string, tf long")
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc string")
    terms = spark.createDataFrame([(1, "p"), (1, "q"), (2, "p")], "task int, term string")
    got = [{(r.task, r.doc): (r.score, r.found) for r in retrieval.bm25(t, docs, terms).collect()} for t in (tf, less)]
    assert got[0] == got[1] and {k: v[1] for k, v in got[0].items()} == {(1, "a"): 1, (1, "b"): 1, (2, "a"): 1}


def test_matches_are_not_shuffled_by_task(spark):
    assert "hashpartitioning(task" not in _plan(X._bm25(spark, D))


def test_keys_need_no_order(spark):
    plan = _plan(X.oracle_order(spark, D))
    assert plan.count("Window ") == 1 and "avg_len" not in plan
    o = X._order(spark, D).where("in_key = 1").select("task", "doc", "cost")
    k = X._keys(spark, D).select("task", "doc", F.col("cost"))
    assert o.count() == k.count() and o.exceptAll(k).isEmpty()

"""BM25 of a task's files counts for repositories and takes the seed off; a walk makes one method's scores only."""

import math

from orrery.operators import retrieval
from orrery.plans import ordering_plans as P


def test_scores_without_the_seed(spark):
    tf = spark.createDataFrame([("r", "s", "p", 3), ("r", "a", "p", 1), ("r", "a", "q", 2), ("r", "b", "q", 1)], "repo string, path string, term string, tf long")
    nodes = spark.createDataFrame([("r", x) for x in "sabc"], "repo string, path string")
    tasks = spark.createDataFrame([("t", "r", "s"), ("none", "r", "a")], "task string, repo string, seed string")
    terms = spark.createDataFrame([("t", "p"), ("t", "x")], "task string, term string")
    got = {(r.task, r.path): r.score for r in retrieval.bm25_files(tf, nodes, tasks, terms).collect()}
    want = math.log(1 + (3 - 1 + 0.5) / 1.5) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / (4 / 3)))
    assert set(got) == {("t", "a"), ("t", "b"), ("t", "c")} and got["t", "b"] == got["t", "c"] == 0
    assert abs(got["t", "a"] - want) < 1e-12


def test_walk_makes_its_own_scores_only(spark):
    P._CORPORA.clear()
    made = P.corpus(spark, "/root/testdata/sf0.001").walk("ppr_und")
    assert "method" not in made.columns and "walks" not in P.corpus(spark, "/root/testdata/sf0.001")._made

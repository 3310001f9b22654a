"""The study keeps the rows of key files only, and what follows from keys alone needs no ordering."""

from orrery.plans import analysis_plans as A
from orrery.plans import ordering_plans as P

D = "/root/testdata/sf0.001"


def test_shared_without_orderings(spark):
    A._MADE.clear()
    P._CORPORA.clear()
    assert A.study_shared_prs(spark, D).columns == ["pr"] and A.key_sizes(spark, D).count() == A._grid(spark, D).select("task", "source").distinct().count()
    assert not [k for k in P.corpus(spark, D)._made if k.startswith("ordering")]


def test_found_has_key_files_only(spark):
    n = {r.method: r.n for r in A._found(spark, D).groupBy("method").agg({"*": "count"}).toDF("method", "n").collect()}
    assert n["oracle"] == n["hops_lines"] == A._key(spark, D).count()

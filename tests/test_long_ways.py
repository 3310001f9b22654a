"""Searches along imports: no table is written for a level, and the numbers are those of plain searches."""

import random

import numpy as np

from orrery.operators import levels as L
from orrery.operators import orderings as O


def test_tables_do_not_grow_with_ways(spark, monkeypatch):
    names = [f"d/f{i:02}.py" for i in range(30)]
    df = spark.createDataFrame
    c = O.Corpus(df([("r", p, 1) for p in names], "repo string, path string, cost long"), df([("r", *e) for e in zip(names, names[1:])], "repo string, src string, dst string"), df([("t", "r", names[3])], "task string, repo string, seed string"), None, None, None)
    made, real = [], L.stage
    monkeypatch.setattr(L, "stage", lambda d, name="table", *a, **b: made.append(name) or real(d, name, *a, **b))
    got = {n: [r.path for r in c.search(n).orderBy("pos").collect()] for n in ("bfs_fwd", "bfs_rev", "topo_fwd", "closure_fwd")}
    assert got["bfs_fwd"] == names[4:] and got["bfs_rev"] == names[2::-1] and got["topo_fwd"] == names[:3:-1] and sorted(got["closure_fwd"]) == names[4:]
    assert len(made) <= 8


def test_peeling_is_that_of_the_rounds(spark):
    r = random.Random(5)
    edges = sorted({(k, r.randrange(25), r.randrange(25)) for k in "ab" for _ in range(32)})
    e = spark.createDataFrame([x for x in edges if x[1] != x[2]], "repo string, src long, dst long")
    nodes = spark.createDataFrame([(k, v) for k in "abc" for v in range(25)], "repo string, node long")
    want = L.heights(L.strong_components(nodes, e), e)
    rows = lambda d: {(x.repo, x.node, x.root, x.height) for x in d.select("repo", "node", "root", "height").collect()}
    assert rows(L.peeled(nodes, e)) == rows(want)
    root, height = L._peel(5000, np.arange(4999), np.arange(1, 5000))
    assert (root == np.arange(5000)).all() and (height == np.arange(5000)[::-1]).all()

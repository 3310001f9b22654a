"""Level searches and rank iterations that go to their end, against brute force."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import graph as G
from orrery.plans import graph_plans
from orrery.plans.graph_plans import QUERIES
from orrery.sources import tables as S

#: A triangle and a tail of 8 nodes.
CHAIN = [(i, i + 1) for i in range(8)] + [(0, 20), (20, 21), (21, 0), (21, 3), (1, 3)]


@pytest.fixture
def chain(spark, monkeypatch):
    """The graph tables as CHAIN, with seed 0."""
    e = spark.createDataFrame(CHAIN, "src long, dst long")
    n = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumns({"cost": F.lit(2).cast("long"), "kind": F.lit("k"), "brand": F.lit("b")})
    monkeypatch.setattr(graph_plans.R, "WIDTH", 1)
    monkeypatch.setattr(S, "graph_edges", lambda *_: e)
    monkeypatch.setattr(S, "graph_nodes", lambda *_: n)
    monkeypatch.setattr(S, "seeds", lambda *_: spark.createDataFrame([("t", 0)], "task string, node long"))
    monkeypatch.setattr(graph_plans, "_keys", lambda *_: n.where("node <> 0").select(F.lit("symbol").alias("source"), F.lit("t").alias("task"), "node"))


def levels(pairs, seed):
    after, found, front, d = defaultdict(set), {seed: 0}, {seed}, 0
    for a, b in pairs:
        after[a].add(b)
    while front:
        d += 1
        front = {b for a in front for b in after[a]} - found.keys()
        found |= dict.fromkeys(front, d)
    return found


def test_levels_without_cutoff(spark, chain):
    back = [(b, a) for a, b in CHAIN]
    for name, pairs in (("bfs_fwd", CHAIN), ("bfs_rev", back), ("bfs_und", CHAIN + back)):
        got = {r.node: r.dist for r in QUERIES[name](spark, "").collect()}
        assert got == {n: d for n, d in levels(pairs, 0).items() if d}, name
    want = levels(CHAIN + back, 0)
    assert 6 < max(want.values()) < graph_plans.DEPTH
    assert [r.node for r in QUERIES["hops_lines"](spark, "").orderBy("pos").collect()] == sorted(want.keys() - {0}, key=lambda n: (want[n], n))
    assert {r.node: r.dist for r in QUERIES["distances"](spark, "").collect()} == {n: d for n, d in want.items() if d}
    assert {r.bucket for r in QUERIES["distance_profile"](spark, "").collect()} == {"1", "2", "3+"}
    assert {r.dist for r in G.bfs(S.graph_edges(), S.seeds(), 2).collect()} == {0, 1, 2}


def walk(pairs, restart):
    """Scores of the random walk by a dense solve; the mass of nodes without successors restarts."""
    m = np.zeros((len(restart), len(restart)))
    at = {n: i for i, n in enumerate(sorted({n for p in CHAIN for n in p}))}
    for a, b in pairs:
        m[at[b], at[a]] = 1 / sum(x == a for x, _ in pairs)
    m[:, m.sum(axis=0) == 0] = restart[:, None]
    return dict(zip(at, np.linalg.solve(np.eye(len(restart)) - 0.85 * m, 0.15 * restart), strict=True))


def test_ranks_settle(spark, chain):
    n = len({n for p in CHAIN for n in p})
    want = {k: v for k, v in walk(CHAIN, np.eye(n)[0]).items() if v > 0}
    # The query stops where a round changes less than 1e-6 for each node in sum.
    got = {r.node: r.score for r in QUERIES["ppr_out"](spark, "").collect()}
    assert got.keys() >= want.keys() and got == pytest.approx({k: want.get(k, 0) for k in got}, abs=n * 1e-6 * 0.85 / 0.15)
    a = np.zeros((32, 32))
    for s, d in CHAIN:
        a[s, d] = 1
    v = np.linalg.eigh(a.T @ a)[1][:, -1]
    got = {r.node: r.score for r in QUERIES["hits_fixed"](spark, "").collect()}
    assert got == pytest.approx({k: (v / v.sum())[k] for k in got}, abs=1e-7)

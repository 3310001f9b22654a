"""Levels, components, heights and betweenness by joins against plain walks on small random graphs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from orrery.operators import levels as L


def made(seed, n, m, repos=2):
    r = random.Random(seed)
    nodes = [(f"r{k}", f"n{i:03}") for k in range(repos) for i in range(n + k)]
    edges = {(f"r{k}", f"n{r.randrange(n):03}", f"n{r.randrange(n):03}") for k in range(repos) for _ in range(m)}
    return nodes, sorted(e for e in edges if e[1] != e[2])


def frames(spark, nodes, edges):
    return spark.createDataFrame(nodes, "repo string, node string"), spark.createDataFrame(edges, "repo string, src string, dst string")


def hops(edges, repo, start):
    out = {}
    for k, a, b in edges:
        if k == repo:
            out.setdefault(a, set()).add(b)
    found, queue = {start: 0}, deque([start])
    while queue:
        v = queue.popleft()
        for w in out.get(v, ()):
            if w not in found:
                found[w] = found[v] + 1
                queue.append(w)
    return found


@pytest.mark.parametrize("depth", [None, 2])
def test_many_sources(spark, depth):
    nodes, edges = made(1, 70, 120)
    n, e = frames(spark, nodes, edges)
    sources = n.select("repo", F.concat_ws("|", "repo", "node").alias("source"), "node")
    got = {}
    for r in L.reached(e, sources, depth).collect():
        assert got.setdefault((r.source, r.node), r.dist) == r.dist
    want = {(f"{k}|{v}", w): d for k, v in nodes for w, d in hops(edges, k, v).items() if depth is None or d <= depth}
    assert got == want


def test_closeness(spark):
    nodes, edges = made(2, 70, 60)
    both = [(k, b, a) for k, a, b in edges] + edges
    got = {(r.repo, r.node): r.score for r in L.closeness(*frames(spark, nodes, edges)).collect()}
    for k, v in nodes:
        d, n = hops(both, k, v), sum(x == k for x, _ in nodes)
        assert got[k, v] == pytest.approx((len(d) - 1) / sum(d.values()) * (len(d) - 1) / (n - 1) if len(d) > 1 else 0.0)
    assert len(got) == len(nodes)


def components(nodes, edges):
    reach = {(k, v): hops(edges, k, v) for k, v in nodes}
    return {(k, v): min(w for w in reach[k, v] if v in reach[k, w]) for k, v in nodes}


def test_strong_components_and_heights(spark):
    nodes, edges = made(4, 45, 60)
    n, e = frames(spark, nodes, edges)
    want = components(nodes, edges)
    found = L.strong_components(n, e)
    rows = found.collect()
    assert {(r.repo, r.node): r.root for r in rows} == want and len(rows) == len(nodes)
    height = {(r.repo, r.node): r.height for r in L.heights(found, e).collect()}
    assert height.keys() == want.keys()
    for k, a, b in edges:
        if want[k, a] != want[k, b]:
            assert height[k, a] > height[k, b]
        else:
            assert height[k, a] == height[k, b]
    sources = n.select("repo", F.concat_ws("|", "repo", "node").alias("source"), "node")
    order = L.dependencies_first(L.reached(e, sources), L.heights(found, e), lambda s, v: F.sha2(F.concat(s, v), 256))
    pos = {(r.source, r.node): r.pos for r in order.collect()}
    for k, v in nodes:
        s, d = f"{k}|{v}", hops(edges, k, v)
        assert sorted(w for x, w in pos if x == s) == sorted(w for w in d if w != v)
        for x, a, b in edges:
            if x == k and a in d and v not in (a, b) and want[k, a] != want[k, b]:
                assert pos[s, a] > pos[s, b]


def test_loops_and_empty(spark):
    nodes = [("r", "a"), ("r", "b"), ("s", "a")]
    n, e = frames(spark, nodes, [("r", "a", "a"), ("r", "b", "b")])
    assert {(r.repo, r.node, r.root) for r in L.strong_components(n, e).collect()} == {("r", "a", "a"), ("r", "b", "b"), ("s", "a", "a")}
    assert L.strong_components(n.limit(0), e.limit(0)).count() == 0
    assert L.reached(e.limit(0), n.withColumn("source", F.col("node")).limit(0)).count() == 0


def test_a_component_larger_than_a_chain(spark):
    ring = [("r", f"n{i:02}", f"n{(i + 1) % 14:02}") for i in range(14)]
    nodes = [("r", f"n{i:02}") for i in range(14)]
    rows = L.strong_components(*frames(spark, nodes, ring)).collect()
    assert {r.root for r in rows} == {"n00"} and len(rows) == 14


def test_betweenness(spark):
    nodes, edges = made(6, 60, 160)
    got = {(r.repo, r.node): r.score for r in L.betweenness(*frames(spark, nodes, edges)).collect()}
    want = {}
    for repo in {k for k, _ in nodes}:
        own = [v for k, v in nodes if k == repo]
        out = {v: [b for k, a, b in edges if k == repo and a == v] for v in own}
        total = dict.fromkeys(own, 0.0)
        far = {v: hops(edges, repo, v) for v in own}
        ways = {}
        for s in own:
            ways[s] = dict.fromkeys(own, 0)
            ways[s][s] = 1
            for v in sorted(far[s], key=far[s].get):
                for w in out[v]:
                    if far[s].get(w) == far[s][v] + 1:
                        ways[s][w] += ways[s][v]
        for s in own:
            for t in own:
                for v in own:
                    if s != v != t and s != t and t in far[s] and v in far[s] and t in far[v] and far[s][v] + far[v][t] == far[s][t]:
                        total[v] += ways[s][v] * ways[v][t] / ways[s][t]
        want |= {(repo, v): x / ((len(own) - 1) * (len(own) - 2)) for v, x in total.items()}
    assert got == pytest.approx(want, abs=1e-9)


def test_betweenness_of_a_long_way(spark, monkeypatch):
    """The number of staged tables does not grow with the length of ways; sources beyond one slice and one chunk are all counted."""
    made_ = []
    monkeypatch.setattr(L, "stage_if", lambda *a, _f=L.stage_if: made_.append(a) or _f(*a))
    monkeypatch.setattr(L, "CELLS", 100)
    n = 40
    nodes, edges = [("r", f"n{i:03}") for i in range(n)], [("r", f"n{i:03}", f"n{i + 1:03}") for i in range(n - 1)]
    got = {r.node: r.score for r in L.betweenness(*frames(spark, nodes, edges)).collect()}
    assert got == pytest.approx({f"n{i:03}": i * (n - 1 - i) / ((n - 1) * (n - 2)) for i in range(n)}) and not made_

"""Rounds send no tables to all tasks by way of the driver (F37, F39)."""

import random

from orrery.operators import levels as L


def graph(spark):
    r = random.Random(5)
    edges = sorted({(r.randrange(30), r.randrange(30)) for _ in range(45)} | {(40, 41), (41, 42), (42, 40), (42, 43), (50, 51), (51, 50)})
    edges = [e for e in edges if e[0] != e[1]]
    return edges, spark.createDataFrame([("r", v) for v in range(60)], "repo string, node long"), spark.createDataFrame([("r", *e) for e in edges], "repo string, src long, dst long")


def plans(monkeypatch):
    """The plans of all tables that are staged, by name."""
    made, real = [], L.stage
    monkeypatch.setattr(L, "FEW", 0, raising=False)
    monkeypatch.setattr(L, "stage", lambda d, name="table", *a, **b: made.append((name, d._jdf.queryExecution().executedPlan().toString())) or real(d, name, *a, **b))
    monkeypatch.setattr(L, "stage_if", lambda d, name="table", of=None: (out := L.stage(d, name), not (out if of is None else out.where(of)).isEmpty()))
    return made


def closure(edges):
    reach = {v: {v} for v in range(60)}
    while any(reach[a] >= reach[b] or reach[a].update(reach[b]) is None for a, b in edges if not reach[a] >= reach[b]):
        pass
    return reach


def test_components(spark, monkeypatch):
    edges, nodes, e = graph(spark)
    made = plans(monkeypatch)
    found = L.strong_components(nodes, e)
    reach = closure(edges)
    assert {x.node: x.root for x in found.collect()} == {v: min(w for w in reach[v] if v in reach[w]) for v in reach}
    assert len(made) > 10 and not [name for name, plan in made if "BroadcastHashJoin" in plan]


def test_heights(spark, monkeypatch):
    edges, nodes, e = graph(spark)
    root = {v: min(w for w in r if v in closure(edges)[w]) for v, r in closure(edges).items()}
    of = spark.createDataFrame([("r", v, w) for v, w in root.items()], "repo string, node long, root long")
    made = plans(monkeypatch)
    got = {x.node: x.height for x in L.heights(of, e).collect()}
    up = {(root[a], root[b]) for a, b in edges if root[a] != root[b]}
    want = dict.fromkeys(root.values(), 0)
    for _ in range(60):
        for a, b in up:
            want[a] = max(want[a], want[b] + 1)
    assert got == {v: want[w] for v, w in root.items()}
    assert len(made) > 2 and not [name for name, plan in made if "BroadcastHashJoin" in plan]

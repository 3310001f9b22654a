"""Closures by way of a pivot (F34)."""

import random

from pyspark.sql import functions as F

from orrery.operators import levels as L
from orrery.operators import orderings as O


def reach(edges, start):
    seen, front = {start}, [start]
    while front:
        a = front.pop()
        for b in (y for x, y in edges if x == a and y not in seen):
            seen.add(b)
            front.append(b)
    return seen


def test_closures_are_those_of_plain_searches(spark):
    """A core with tails, trees, loops apart, no edges at all, more sources than a block, a source that is no end of an edge."""
    r = random.Random(3)
    core = [(r.randrange(12), r.randrange(30)) for _ in range(30)] + [(r.randrange(30), r.randrange(12)) for _ in range(25)]
    graphs = {"core": core, "tree": [(i // 2, i) for i in range(1, 20)], "apart": [(0, 1), (1, 0), (2, 3), (3, 2), (2, 4), (5, 3)], "ring": [(i, (i + 1) % 70) for i in range(70)]}
    graphs = {k: sorted({e for e in v if e[0] != e[1]}) for k, v in graphs.items()}
    edges = spark.createDataFrame([(k, *e) for k, v in graphs.items() for e in v], "repo string, src long, dst long").cache()
    starts = {k: sorted({x for e in v for x in e}) + [99] for k, v in graphs.items()} | {"none": [0]}
    sources = L.numbered(spark.createDataFrame([(k, f"s{v:03}", v) for k, own in starts.items() for v in own], "repo string, source string, node long")).cache()
    at = {(x.repo, x.block, x.bit): x.node for x in sources.collect()}
    hub = L.around(edges).cache()
    marks = L.marked(edges, hub).cache()
    for ways in (("out",), ("in",), ("out", "in")):
        got = {(x.repo, at[x.repo, s.block, b], x.node) for x in L.closures(marks, hub, sources, *ways).collect() for s in x.sets for b in range(64) if s.seen >> b & 1}
        want = {(k, s, v) for k, own in starts.items() for s in own for way in ways for v in reach([e if way == "out" else e[::-1] for e in graphs.get(k, [])], s)}
        assert got == want


def test_seeds_in_one_component_are_not_searched_one_by_one(spark, monkeypatch):
    nodes = [f"m{i:02}.py" for i in range(40)]
    edges = sorted({(a, nodes[(i * k + 1) % 40]) for i, a in enumerate(nodes) for k in (1, 3)} | {(nodes[-1], nodes[0])})
    df = spark.createDataFrame
    c = O.Corpus(df([("r", p, 1) for p in nodes], "repo string, path string, cost long"), df([("r", *e) for e in edges if e[0] != e[1]], "repo string, src string, dst string"), df([(f"t{i:03}", "r", nodes[i % 40]) for i in range(130)], "task string, repo string, seed string"), None, None, None)
    made, real = [], L.stage
    monkeypatch.setattr(L, "stage", lambda d, name="table", *a, **b: made.append((name, out := real(d, name, *a, **b))) or out)
    monkeypatch.setattr(L, "stage_if", lambda d, name, of: (out := L.stage(d, name), not out.where(of).isEmpty()))
    got = {}
    for x in c.search("closure_comb", keep=False).orderBy("task", "pos").collect():
        got.setdefault(x.task, []).append(x.path)
    assert len(got) == 130
    rows = [e for e in edges if e[0] != e[1]]
    for i in range(0, 130, 13):
        want = (reach(rows, nodes[i % 40]) | reach([e[::-1] for e in rows], nodes[i % 40])) - {nodes[i % 40]}
        assert got[f"t{i:03}"] == [x.path for x in df([(f"t{i:03}", p) for p in sorted(want)], "task string, path string").orderBy(F.sha2(F.concat_ws("|", "task", "path"), 256)).collect()]
    states = [d for name, d in made if name == "levels"]
    # Numbers instead of paths; one bit a repository goes round by round, not three blocks of seeds in each direction.
    assert states and all(d.schema["node"].dataType.simpleString() == "bigint" for d in states)
    assert sum(d.count() for d in states) < 2 * 3 * 40 * 5

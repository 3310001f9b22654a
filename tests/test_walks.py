"""Grouped graph methods and orderings against plain versions of them, on random small repositories."""

import itertools
import random
from collections import deque
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import orderings as O
from orrery.operators import ranks, walks

NODES = [f"{d}m{i}.py" for i, d in enumerate(["", "lib/", "lib/", "lib/io/", "app/", "app/", "app/ui/", "x/", ""])]


def random_graph(seed):
    r = random.Random(seed)
    pairs = list(itertools.permutations(NODES[:-1], 2))
    return walks.Graph(NODES, r.sample(pairs, 13))


def hops(adjacent, s):
    d, q = {s: 0}, deque([s])
    while q:
        v = q.popleft()
        for w in adjacent[v]:
            if w not in d:
                d[w] = d[v] + 1
                q.append(w)
    return d


@pytest.mark.parametrize("seed", range(6))
def test_against_plain_versions(seed):
    g = random_graph(seed)
    n, task = len(NODES), f"t{seed}"
    for s in range(n):
        orders = {k: f(g, s, task) for k, f in walks.ORDERS.items()}
        for k, o in orders.items():
            assert s not in o and len(set(o)) == len(o) and o == walks.ORDERS[k](random_graph(seed), s, task), k
        und = hops(g.und, s)
        assert set(orders["dfs_und"]) == set(orders["robillard"]) == und.keys() - {s}
        # A node met at the limit on a longer way is not expanded there, so deepening can miss some.
        assert set(g.und[s]) <= set(orders["ids_und"]) <= und.keys()
        # A first visit is next to something visited before it.
        for k in ("dfs_und", "robillard"):
            assert all(set(g.und[v]) & {s, *orders[k][:i]} for i, v in enumerate(orders[k]))
        assert set(orders["louvain"]) <= und.keys() and set(orders["labelprop"]) <= und.keys()


def test_communities_of_two_cliques():
    a, b = NODES[:4], NODES[4:8]
    g = walks.Graph(NODES, [*itertools.permutations(a, 2), *itertools.permutations(b, 2), (a[0], b[0])])
    for name in ("louvain", "labelprop"):
        assert {g.paths[v] for v in walks.ORDERS[name](g, g.at[a[1]], "t")} == set(a) - {a[1]}


def test_graph_without_edges():
    g = walks.Graph("ab", [])
    assert g.authority.tolist() == [0, 0] and all(len(f(g, 0, "t")) <= 1 for f in walks.ORDERS.values())


def test_orders_by_joins(spark):
    r = random.Random(8)
    pairs = list(itertools.permutations(NODES[:-1], 2))
    edges, refs, calls = r.sample(pairs, 12), [(*p, r.randint(1, 3), r.random() * 5) for p in r.sample(pairs, 9)], r.sample(pairs, 5)
    df = spark.createDataFrame
    at = lambda rows: [("r", *x) for x in rows]
    junk = [("r", NODES[0], NODES[0]), ("r", NODES[0], "gone.py")]
    c = O.Corpus(df([("r", p, 1) for p in NODES], "repo string, path string, cost long"), df(at(edges) + junk, "repo string, src string, dst string"), df([("t1", "r", NODES[0]), ("t2", "r", NODES[4]), ("t3", "r", "missing.py"), ("t4", "r", NODES[-1])], "task string, repo string, seed string"), None, None, None, refs=df(at(refs), "repo string, src string, dst string, weight long, names double"), calls=df(at(calls), "repo string, src string, dst string"))

    def adjacent(rows, both=False):
        out = {p: set() for p in NODES}
        for a, b, *_ in rows:
            out[a].add(b)
            if both:
                out[b].add(a)
        return out

    way = {"out": adjacent(edges), "in": adjacent([(b, a) for a, b in edges]), "und": adjacent(edges, True), "refs": adjacent(refs, True), "calls": adjacent(calls, True), "mixed": adjacent(edges + [x[:2] for x in refs], True)}
    dist = {(k, s): hops(a, s) for k, a in way.items() for s in NODES}
    tried = ("bfs_fwd", "closure_comb", "khop2_und", "repograph_k2", "cosil_bfs", "locagent_bfs", "topo_fwd", "betweenness")
    got = {}
    for x in reduce(DataFrame.unionByName, [c.search(k).withColumn("name", F.lit(k)) for k in tried]).orderBy("name", "task", "pos").collect():
        got.setdefault((x.name, x.task), []).append(x.path)
    assert {t for _, t in got} == {"t1", "t2", "t4"}
    for task, s in (("t1", NODES[0]), ("t2", NODES[4]), ("t4", NODES[-1])):
        near = lambda k, most=99: {p: d for p, d in dist[k, s].items() if 0 < d <= most}  # noqa: B023, E731
        listed = lambda rows, *by: sorted(rows, key=lambda p: (*(f(p) for f in by), walks.tie(task, p)))  # noqa: B023, E731
        want = {
            "bfs_fwd": listed(near("out"), near("out").get), "closure_comb": listed(near("out") | near("in")), "khop2_und": listed(near("und", 2)),
            "repograph_k2": listed(near("refs", 2), near("refs").get), "cosil_bfs": listed(near("calls"), near("calls").get),
            "locagent_bfs": listed(near("mixed"), near("mixed").get, lambda p: not any(dist["mixed", s].get(q) == dist["mixed", s][p] - 1 for q in way["und"][p])),  # noqa: B023
        }
        for name, order in want.items():
            assert got.get((name, task), []) == order, (name, task)
        assert set(got["betweenness", task]) == set(NODES) - {s}
        place = {p: i for i, p in enumerate(got.get(("topo_fwd", task), []))}
        assert place.keys() == near("out").keys()
        assert all(place[b] < place[a] for a, b in edges if a in place and b in place and a not in dist["out", b])


def test_ranks_are_those_of_the_walk(spark, monkeypatch):
    """Weighed edges, ends without successors, restarts at a seed and anywhere, more tasks than a block holds, a seed that is no node."""
    monkeypatch.setattr(ranks, "WIDTH", 4)
    monkeypatch.setattr(ranks, "TOLERANCE", 1e-4)
    r = random.Random(9)
    nodes = {f"r{k}": [f"n{i:02}" for i in range(9 + k)] for k in range(2)}
    edges = {(k, *p): r.random() + 0.1 for k, own in nodes.items() for p in r.sample(list(itertools.permutations(own[:-2], 2)), 30)}
    tasks = [(k, k, None) for k in nodes] + [(f"{k}|{s}", k, s) for k, own in nodes.items() for s in own] + [("gone", "r0", "gone")] + [(f"again{i}", "r1", "n03") for i in range(3)]
    df = spark.createDataFrame
    rows = ranks.ranked(df([(k, v) for k, own in nodes.items() for v in own], "repo string, node string"), df([(*e, w) for e, w in edges.items()], "repo string, src string, dst string, weight double"), df(tasks, "task string, repo string, seed string")).collect()
    got = {}
    for x in rows:
        assert got.setdefault((x.task, x.node), x.score) == x.score
    assert len(rows) == len(got) == sum(len(nodes[k]) for t, k, _ in tasks if t != "gone")
    for task, repo, seed in tasks:
        if task == "gone":
            continue
        own = nodes[repo]
        n = len(own)
        m, p = np.zeros((n, n)), np.full(n, 1 / n) if seed is None else np.array([float(v == seed) for v in own])
        for (k, a, b), w in edges.items():
            if k == repo:
                m[own.index(b), own.index(a)] = w
        total = m.sum(axis=0)
        m = np.where(total > 0, m / np.where(total > 0, total, 1), p[:, None])
        want = np.linalg.solve(np.eye(n) - 0.85 * m, 0.15 * p)
        assert [got[task, v] for v in own] == pytest.approx(want, abs=n * 1e-3)


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    nodes = [("r", p, i + 1) for i, p in enumerate(NODES)] + [("q", "only.py", 1)]
    edges = [("r", a, b) for a, b in r.sample(list(itertools.permutations(NODES[:-1], 2)), 12)]
    tasks = [("t1", "r", NODES[0]), ("t2", "r", NODES[4]), ("t3", "q", "only.py"), ("t4", "r", "missing.py")]
    words = ["cart", "price", "user", "store", "view"]
    bags = [("r", p, w, r.randint(1, 4)) for p in NODES[:-1] for w in r.sample(words, 2)]
    paths = [("r", p, w, 1) for p in NODES for w in p.removesuffix(".py").split("/")] + [("q", "only.py", "only", 1)]
    queries = [("t1", "none", "cart"), ("t1", "none", "lib"), ("t1", "names", "cart"), ("t4", "none", "cart")]
    vectors = [("r", p, [r.random(), r.random()]) for p in NODES[::2]]
    refs = [("r", NODES[0], NODES[5], 1, 1.0)]
    df = spark.createDataFrame
    return O.Corpus(df(nodes, "repo string, path string, cost long"), df(edges, "repo string, src string, dst string"), df(tasks, "task string, repo string, seed string"), df(bags, "repo string, path string, term string, tf long"), df(paths, "repo string, path string, term string, tf long"), df(queries, "task string, arm string, term string"), df(vectors, "repo string, path string, v array<double>"), df([("t1", "none", [1.0, 0.5]), ("t1", "names", [0.0, 1.0])], "task string, arm string, q array<double>"), df(refs, "repo string, src string, dst string, weight long, names double"), df([("r", NODES[0], NODES[5])], "repo string, src string, dst string")), dict(vectors=vectors)


def test_every_ordering_keeps_the_contract(corpus):
    c, _ = corpus
    got = {}
    for name in O.ORDERINGS:
        for r in c.ordering(name).collect():
            got.setdefault((name, r.task), {})[r.pos] = r.path
    assert {t for _, t in got} == {"t1", "t2"} and len(O.ORDERINGS) == 53
    for (name, task), own in got.items():
        seed = NODES[0] if task == "t1" else NODES[4]
        assert sorted(own) == list(range(1, len(own) + 1)) and set(own.values()) == set(NODES) - {seed}, name
    # Without an issue a fusion is its structural list; orderings of the issue have no rows.
    assert got["rrf_pprpl_issue_path", "t2"] == got["ppr_und_pl", "t2"] and got["rrf_hops_path_rd", "t2"] == got["hops_lines", "t2"]
    assert ("bm25_issue", "t2") not in got and ("dense_issue", "t2") not in got and ("bm25_issue_rdp", "t1") not in got
    assert got["sys_repograph_k2", "t1"][1] == NODES[5]
    same = [got["same_dir", "t2"][i] for i in (1,)]
    assert same == ["app/m5.py"] and got["same_dir", "t1"].values()


def test_fusion_of_stated_lists(corpus):
    c, _ = corpus
    lists = {n: {r.path: r.pos for r in c.ordering(n).where("task = 't1'").collect()} for n in ("ppr_und_pl", "bm25_issue", "path_issue", "rrf_pprpl_issue_path", "rrf_pprpl_issue_path_k10")}
    for name, k in (("rrf_pprpl_issue_path", 60), ("rrf_pprpl_issue_path_k10", 10)):
        score = {p: round(sum(1 / (k + lists[n][p]) for n in ("ppr_und_pl", "bm25_issue", "path_issue")), 9) for p in lists["ppr_und_pl"]}
        want = sorted(score, key=lambda p: (-score[p], walks.tie("t1", p)))
        assert sorted(lists[name], key=lists[name].get) == want


def test_dense_and_localiser(corpus):
    c, made = corpus
    q, v = np.array([1.0, 0.5]), {p: np.array(x) for _, p, x in made["vectors"]}
    score = {p: round(float(q @ v[p]), 9) if p in v else -2.0 for p in NODES[1:]}
    want = sorted(score, key=lambda p: (-score[p], walks.tie("t1", p)))
    assert [r.path for r in c.ordering("dense_issue").where("task = 't1'").orderBy("pos").collect()] == want
    best = {r.task: r.seed for r in O.localised(c).collect()}
    assert best.keys() == {"t1", "t4"} and best["t1"] in NODES
    key = c.tasks.sparkSession.createDataFrame([("t1", "s", NODES[3]), ("t1", "s", NODES[1]), ("t1", "s", NODES[0]), ("t1", "s", "gone")], "task string, source string, path string")
    assert [r.path for r in O.oracle(c, key).orderBy("pos").collect()] == [NODES[1], NODES[3]]
    assert {(r.node, r.root) for r in c.components().where(F.col("repo") == "q").collect()} == {("only.py", "only.py")}

"""Walks, ranks and communities on the file graphs of many repositories, one repository in one task.

A repository's graph is as large as its tree of files, so it fits a task, and orders that are
sequential by nature (depth-first, greedy) are made where the graph is; levels, components and
what follows from them are joins, in `levels`. Equal choices are settled by a hash of task and path, never by a random stream.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Damping, the stop of a rank iteration per node, and its most rounds.
ALPHA, TOLERANCE, ROUNDS = 0.85, 1e-6, 100


def tie(task: str, path: str) -> str:
    """The hash that settles equal choices."""
    return hashlib.sha256(f"{task}|{path}".encode()).hexdigest()


def levels(adjacent: list[list[int]], start: int) -> dict[int, int]:
    """Hops from start to all that can be reached."""
    found, queue = {start: 0}, deque([start])
    while queue:
        v = queue.popleft()
        for w in adjacent[v]:
            if w not in found:
                found[w] = found[v] + 1
                queue.append(w)
    return found


def rank(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray | None = None, restart: int | None = None) -> np.ndarray:
    """PageRank of n nodes, personal if `restart` names a node; nodes without successors send their mass to the restart.

    Begins evenly and ends when a round changes less than n * TOLERANCE in sum, or after ROUNDS.
    """
    p = np.full(n, 1 / n) if restart is None else np.eye(1, n, restart)[0]
    w = np.ones(len(src)) if weight is None else np.asarray(weight, float)
    out = np.bincount(src, weights=w, minlength=n)
    share, lost = w / np.where(out[src] > 0, out[src], 1), out == 0
    return settled(n, lambda x: np.bincount(dst, weights=x[src] * share, minlength=n), lost, p)


def settled(n: int, sent: Callable[[np.ndarray], np.ndarray], lost: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The iteration of rank(): sent(x) is what n nodes send to each other, the mass of the lost ones goes where p says."""
    x = np.full(n, 1 / n)
    for _ in range(ROUNDS):
        new = ALPHA * (sent(x) + x[lost].sum() * p) + (1 - ALPHA) * p
        done = np.abs(new - x).sum() < n * TOLERANCE
        x = new
        if done:
            break
    return x


class Graph:
    """One repository: paths in order, import edges without loops and references (src, dst, names, weight).

    With classes(path, class) references are between classes: they hold for all of their files, but for none with itself.
    """

    def __init__(self, paths: Iterable[str], edges: Iterable[tuple[str, str]], refs: Iterable[tuple[str, str, float, float]] = (), classes: Iterable[tuple[str, str]] | None = None) -> None:
        self.paths = sorted(set(paths))
        self.at = {p: i for i, p in enumerate(self.paths)}
        known = lambda rows, at, loops=False: sorted({(at[r[0]], at[r[1]], *r[2:]) for r in rows if r[0] in at and r[1] in at and (loops or r[0] != r[1])})
        self.edges = known(edges, self.at)
        if classes is None:
            self.class_of, self.refs = np.arange(len(self.paths)), known(refs, self.at)
        else:
            of = dict(classes)
            at = {c: i for i, c in enumerate(sorted(set(of.values())))}
            # A file without a class has one of its own, which no reference names.
            self.class_of = np.array([at[of[p]] if p in of else len(at) + i for i, p in enumerate(self.paths)], np.int64)
            self.refs = known(refs, at, True)

    def adjacent(self, pairs: Iterable[tuple[int, ...]], both: bool = False) -> list[list[int]]:
        out: list[set[int]] = [set() for _ in self.paths]
        for a, b, *_ in pairs:
            out[a].add(b)
            if both:
                out[b].add(a)
        return [sorted(x) for x in out]

    @cached_property
    def out(self) -> list[list[int]]:
        return self.adjacent(self.edges)

    @cached_property
    def into(self) -> list[list[int]]:
        return self.adjacent([(b, a) for a, b in self.edges])

    @cached_property
    def und(self) -> list[list[int]]:
        return self.adjacent(self.edges, both=True)

    def arrays(self, pairs: Iterable[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        a = np.array(list(pairs), np.int64).reshape(-1, 2)
        return a[:, 0], a[:, 1]

    def walk(self, adjacent: list[list[int]], seed: int | None) -> np.ndarray:
        """rank() along an adjacency; all 0 (all 1 without a seed) in a graph without edges."""
        src, dst = self.arrays((a, b) for a, row in enumerate(adjacent) for b in row)
        return rank(len(self.paths), src, dst, restart=seed) if len(src) else np.full(len(self.paths), 1.0 if seed is None else 0.0)

    @cached_property
    def pagerank(self) -> np.ndarray:
        return self.walk(self.out, None)

    @cached_property
    def authority(self) -> np.ndarray:
        """HITS authorities, which sum to 1; the in-degree if they do not settle or there are no edges."""
        n = len(self.paths)
        src, dst = self.arrays(self.edges)
        hub = np.full(n, 1 / max(n, 1))
        for _ in range(1000 if len(src) else 0):
            auth = np.bincount(dst, weights=hub[src], minlength=n)
            auth /= auth.sum()
            new = np.bincount(src, weights=auth[dst], minlength=n)
            new /= new.sum()
            done, hub = np.abs(new - hub).sum() < 1e-8, new
            if done:
                return auth
        return np.bincount(dst, minlength=n).astype(float)

    @cached_property
    def louvain(self) -> np.ndarray:
        """Communities of greedy modularity: nodes move while the modularity grows, then communities become nodes."""
        n = len(self.paths)
        own, links = np.arange(n), {v: {w: 1.0 for w in row} for v, row in enumerate(self.und)}
        loops = dict.fromkeys(range(n), 0.0)
        m2 = float(sum(len(r) for r in self.und))
        while m2:
            label, degree = {v: v for v in links}, {v: sum(links[v].values()) + loops[v] for v in links}
            total, moved, any_move = dict(degree), True, False
            while moved:
                moved = False
                for v in sorted(links):
                    near: dict[int, float] = {}
                    for w, x in links[v].items():
                        near[label[w]] = near.get(label[w], 0.0) + x
                    total[label[v]] -= degree[v]
                    gain = lambda c: near.get(c, 0.0) - total[c] * degree[v] / m2  # noqa: B023, E731
                    best = max(sorted({*near, label[v]}), key=lambda c: (round(gain(c), 12), c == label[v]))  # noqa: B023
                    moved |= best != label[v]
                    label[v] = best
                    total[best] += degree[v]
                any_move |= moved
            if not any_move:
                break
            own = np.array([label[c] for c in own])
            merged: dict[int, dict[int, float]] = {c: {} for c in set(label.values())}
            inner = dict.fromkeys(merged, 0.0)
            for v, row in links.items():
                inner[label[v]] += loops[v]
                for w, x in row.items():
                    if label[v] == label[w]:
                        inner[label[v]] += x
                    else:
                        merged[label[v]][label[w]] = merged[label[v]].get(label[w], 0.0) + x
            links, loops = merged, inner
        return own

    @cached_property
    def propagated(self) -> np.ndarray:
        """Communities by label propagation: each node in turn takes the commonest label around it, the smallest of equals, until none would change."""
        label = list(range(len(self.paths)))
        for _ in range(len(self.paths)):
            changed = False
            for v in sorted(range(len(label)), key=lambda i: tie("labels", self.paths[i])):
                near: dict[int, int] = {}
                for w in self.und[v]:
                    near[label[w]] = near.get(label[w], 0) + 1
                most = max(near.values(), default=0)
                if near and near.get(label[v], 0) < most:
                    label[v], changed = min(c for c, k in near.items() if k == most), True
            if not changed:
                break
        return np.array(label)

    # Orders of single tasks: lists of nodes without the seed.

    def shuffled(self, nodes: Iterable[int], task: str) -> list[int]:
        return sorted(nodes, key=lambda v: tie(task, self.paths[v]))

    def by_score(self, score: np.ndarray, seed: int, task: str, keep: bool = False) -> list[int]:
        return sorted((v for v in range(len(score)) if v != seed and (score[v] > 0 or not keep)), key=lambda v: (-round(float(score[v]), 9), tie(task, self.paths[v])))

    def depth_first(self, seed: int, task: str) -> list[int]:
        """Preorder; a node counts as seen when it is put aside, not when it is visited."""
        out, seen, stack = [], {seed}, [seed]
        while stack:
            v = stack.pop()
            out.append(v)
            for w in reversed(self.shuffled(self.und[v], task)):
                if w not in seen:
                    seen.add(w)
                    stack.append(w)
        return out[1:]

    def deepening(self, seed: int, task: str) -> list[int]:
        """Depth-first searches of growing depth; a node is listed when first visited."""
        listed: dict[int, None] = {}
        for limit in range(1, max(levels(self.und, seed).values()) + 1):
            stack, seen = [(seed, 0)], {seed}
            while stack:
                v, d = stack.pop()
                listed.setdefault(v)
                if d < limit:
                    for w in reversed(self.shuffled(self.und[v], task)):
                        if w not in seen:
                            seen.add(w)
                            stack.append((w, d + 1))
        return [v for v in listed if v != seed]

    def expansion(self, seed: int, task: str) -> list[int]:
        """Greedy growth of a set: next comes the node most tied to the set, as a share of its own ties and of the set.

        The size of the set is the same for all candidates, so it decides nothing; a count that has grown stands in the heap anew.
        """
        inside, out, count, heap = {seed}, [], {}, []

        def meet(v: int) -> None:
            for w in self.und[v]:
                if w not in inside:
                    count[w] = count.get(w, 0) + 1
                    heapq.heappush(heap, (-round(count[w] / len(self.und[w]) * count[w], 12), tie(task, self.paths[w]), w))

        meet(seed)
        while heap:
            v = heapq.heappop(heap)[2]
            if v not in inside:
                inside.add(v)
                out.append(v)
                meet(v)
        return out

    def reference_ranks(self, seed: int) -> np.ndarray:
        """Personal rank over references, an edge weighing its names' mean weight times the root of their number; what files send is summed up by class."""
        n = len(self.paths)
        if not self.refs:
            return np.zeros(n)
        src, dst = self.arrays((a, b) for a, b, *_ in self.refs)
        weight = np.array([names * np.sqrt(k) / max(k, 1) for _, _, k, names in self.refs])
        of, m = self.class_of, int(max(self.class_of.max(), src.max(), dst.max())) + 1
        size, loop = np.bincount(of, minlength=m), src == dst
        own = np.bincount(src[loop], weights=weight[loop], minlength=m)
        out = np.bincount(src, weights=weight * (size[dst] - loop), minlength=m)[of]
        share, lost, p = 1 / np.where(out > 0, out, 1), out == 0, np.eye(1, n, seed)[0]

        def sent(x: np.ndarray) -> np.ndarray:
            each = x * share
            return np.bincount(dst, weights=np.bincount(of, weights=each, minlength=m)[src] * weight, minlength=m)[of] - own[of] * each

        return settled(n, sent, lost, p) if out.any() else np.zeros(n)


#: Orders of one task by name: (graph, seed, task) -> nodes.
ORDERS: dict[str, Callable[[Graph, int, str], list[int]]] = {
    "dfs_und": Graph.depth_first,
    "ids_und": Graph.deepening,
    "pagerank": lambda g, s, t: g.by_score(g.pagerank, s, t),
    "ppr_und": lambda g, s, t: g.by_score(g.walk(g.und, s), s, t, True),
    "ppr_fwd": lambda g, s, t: g.by_score(g.walk(g.out, s), s, t, True),
    "hits_auth": lambda g, s, t: g.by_score(g.authority, s, t),
    "robillard": Graph.expansion,
    "louvain": lambda g, s, t: g.shuffled([v for v, c in enumerate(g.louvain) if c == g.louvain[s] and v != s], t),
    "labelprop": lambda g, s, t: g.shuffled([v for v, c in enumerate(g.propagated) if c == g.propagated[s] and v != s], t),
    "aider_repomap": lambda g, s, t: g.by_score(g.reference_ranks(s), s, t, True),
}

#: Scores of all nodes for one task by name: (graph, seed) -> values.
SCORES: dict[str, Callable[[Graph, int], np.ndarray]] = {
    "ppr_und": lambda g, s: g.walk(g.und, s),
    "ppr_out": lambda g, s: g.walk(g.out, s),
    "ppr_in": lambda g, s: g.walk(g.into, s),
    "pagerank": lambda g, s: g.pagerank,
    "hits_auth": lambda g, s: g.authority,
}


def _gathered(nodes: DataFrame, edges: DataFrame, tasks: DataFrame | None, refs: DataFrame | None, classes: DataFrame | None = None) -> DataFrame:
    """All rows of a repository side by side: (repo, kind, a, b, n, w)."""
    row = lambda df, kind, a, b=None, n=None, w=None: df.select("repo", F.lit(kind).alias("kind"), F.col(a).cast("string").alias("a"), (F.col(b) if b else F.lit(None)).cast("string").alias("b"), (F.col(n) if n else F.lit(1)).cast("double").alias("n"), (F.col(w) if w else F.lit(1)).cast("double").alias("w"))
    parts = [row(nodes, "node", "path"), row(edges, "edge", "src", "dst")]
    if tasks is not None:
        parts.append(row(tasks, "task", "task", "seed"))
    if refs is not None:
        parts.append(row(refs, "ref", "src", "dst", "weight", "names"))
        if classes is not None:
            parts.append(row(classes, "class", "path", "class"))
    return reduce(DataFrame.unionByName, parts)


def _graph_of(batches: Iterator[pd.DataFrame], classed: bool = False) -> tuple[Graph, list[tuple[str, str]]]:
    found: dict[str, list[tuple]] = {k: [] for k in ("node", "edge", "ref", "task", "class")}
    for pdf in batches:
        for kind, cols in (("node", ["a"]), ("edge", ["a", "b"]), ("ref", ["a", "b", "n", "w"]), ("task", ["a", "b"]), ("class", ["a", "b"])):
            found[kind] += pdf.loc[pdf.kind == kind, cols].itertuples(index=False, name=None)
    return Graph((a for (a,) in found["node"]), found["edge"], found["ref"], found["class"] if classed else None), found["task"]


def orders(names: list[str], nodes: DataFrame, edges: DataFrame, tasks: DataFrame, refs: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:
    """(task, method, path, pos) of the named ORDERS, from 1, without the seed.

    nodes(repo, path), edges(repo, src, dst), tasks(task, repo, seed); refs(repo, src, dst,
    weight, names) with the number of shared names and the sum of their weights, between the classes of classes(repo, path,
    class) where these are given. Tasks whose seed is no node have no rows; edges to unknown nodes and loops are ignored.
    References are sent to tasks for orders by them only; a task hands out one order at a time.
    """
    referring = bool({"aider_repomap"} & set(names))
    classed = referring and classes is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, own = _graph_of(batches, classed)
        for task, seed in own:
            if seed in g.at:
                for name in names:
                    if found := ORDERS[name](g, g.at[seed], task):
                        yield pd.DataFrame({"task": task, "method": name, "path": [g.paths[v] for v in found], "pos": np.arange(1, len(found) + 1, dtype=np.int32)})

    return _gathered(nodes, edges, tasks, refs if referring else None, classes).groupBy("repo").applyInPandas(run, "task string, method string, path string, pos int")


def scores(names: list[str], nodes: DataFrame, edges: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task, method, path, score) of the named SCORES for all nodes but the seed; inputs as in orders()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, own = _graph_of(batches)
        for task, seed in own:
            if seed in g.at and len(g.paths) > 1:
                for name in names:
                    yield pd.DataFrame({"task": task, "method": name, "path": g.paths, "score": SCORES[name](g, g.at[seed])}).drop(index=g.at[seed])

    return _gathered(nodes, edges, tasks, None).groupBy("repo").applyInPandas(run, "task string, method string, path string, score double")

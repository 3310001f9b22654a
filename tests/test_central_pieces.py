"""Closeness and betweenness by pieces of a graph: nothing is written for each pair of nodes or each level, and pieces and parts of sources add up."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import levels as L


def test_closeness_without_levels(spark, monkeypatch):
    """No table of (block, node) with levels is made, however long ways are; names and places as nodes give the same."""
    monkeypatch.setattr(L, "packed", lambda *a: pytest.fail("levels are written"))
    n = 200
    nodes = spark.range(n).select(F.lit("r").alias("repo"), F.format_string("n%03d", "id").alias("node"))
    edges = spark.range(n - 1).select(F.lit("r").alias("repo"), F.format_string("n%03d", "id").alias("src"), F.format_string("n%03d", F.col("id") + 1).alias("dst"))
    number = lambda c: F.substring(c, 2, 3).cast("long")
    wanted = {i: (n - 1) / (i * (i + 1) // 2 + (n - 1 - i) * (n - i) // 2) for i in range(n)}
    assert {int(r.node[1:]): r.score for r in L.closeness(nodes, edges).collect()} == pytest.approx(wanted)
    placed = L.closeness(nodes.select("repo", number("node").alias("node")), edges.select("repo", number("src").alias("src"), number("dst").alias("dst")), places=True)
    assert {r.node: r.score for r in placed.collect()} == pytest.approx(wanted)


def test_pieces_hold_all_edges_once(monkeypatch):
    monkeypatch.setattr(L, "PIECE", 8)
    r = random.Random(3)
    n = 90
    a, b = (np.array(x) for x in zip(*{(i, r.randrange(i // 7 * 7, i // 7 * 7 + 7)) for i in range(84) for _ in range(2)}))
    found, seen = [], []
    for nodes, src, dst in L._pieces(n, a, b):
        seen += list(nodes)
        found += list(zip(nodes[src], nodes[dst]))
    assert sorted(found) == sorted(zip(a, b)) and len(seen) == len(set(seen))


@pytest.mark.parametrize("cells", [1, 1 << 21])
def test_counts_of_parts_add_up(monkeypatch, cells):
    """All sources at once, and dealt over parts; small fronts and large ones."""
    monkeypatch.setattr(L, "CELLS", cells)
    r = random.Random(4)
    n = 300
    pairs = {(i, r.randrange(n)) for i in range(n) for _ in range(2)} | {(i, i + 1) for i in range(n - 1)}
    a, b = (np.array(x) for x in zip(*((x, y) for x, y in pairs if x != y)))
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    near = [set(b[a == v]) for v in range(n)]
    found, hops = np.zeros(n, int), np.zeros(n, int)
    for s in range(n):
        seen, front, d = {s}, {s}, 0
        while front:
            d += 1
            front = set().union(*(near[v] for v in front)) - seen
            seen |= front
            found[list(front)] += 1
            hops[list(front)] += d
    parts = [L._nearness(n, a, b, np.arange(n)[p::16]) for p in range(16)]
    assert (sum(x for x, _ in parts) == found).all() and (sum(y for _, y in parts) == hops).all()
    assert all((x == y).all() for x, y in zip(L._nearness(n, a, b, np.arange(n)), (found, hops)))

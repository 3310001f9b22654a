"""Levels, components and orders on the graphs of many repositories by joins, keyed by (repo, node).

A search carries 64 sources at once: each is a bit, and a row (repo, block, node) holds the bits
of the sources that have reached the node, level by level. One round joins the rows with fresh
bits to the edges and folds what arrives by bit_or. A round's rows replace those of the round
before, so a search reads one table, however deep it goes.

Graphs are edges(repo, src, dst) without loops, each edge once; sources are (repo, source, node).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.staging import stage, stage_if

#: Sources of a block: the bits of a long.
WIDTH = 64
#: Rows over which the sources of a repository are dealt for closeness and betweenness, and nodes and edges that a worker holds for the sources it works on at once.
SLICES, CELLS = 16, 1 << 21
#: Nodes up to which small components are worked on side by side.
PIECE = 1024
#: Rows up to which what a round sends is copied to all tasks. Larger ones and all other tables meet by shuffles, so that what passes the driver is bounded by the rounds, not by the tables.
FEW = 20_000
_KEY = ("repo", "block", "node")


def _met(front: DataFrame, rows: int, e: DataFrame, on: list[str]) -> DataFrame:
    return (F.broadcast(front) if rows <= FEW else front.hint("merge")).join(e, on)


def _apart(d: DataFrame) -> DataFrame:
    """d for a join that does not copy it to all tasks by way of the driver."""
    return d.hint("merge")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("repo", "src", "dst").union(edges.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def against(edges: DataFrame) -> DataFrame:
    return edges.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))


def numbered(sources: DataFrame, width: int = WIDTH) -> DataFrame:
    """sources with `block` and `bit`: their places in a repository, by name, `width` to a block.

    Sources of a repository are counted in ranges, so one with all sources is no single task.
    """
    ranged = stage(sources.select("repo", "source", "node").distinct().repartitionByRange("repo", "source").withColumn("_part", F.spark_partition_id()), "sources")
    sizes = ranged.groupBy("repo", "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("repo").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("repo", "_part").orderBy("source")) - 1 + F.coalesce("_before", F.lit(0))
    d = ranged.join(before.drop("_n"), ["repo", "_part"]).withColumn("_at", place)
    return d.select("repo", "source", "node", F.floor(F.col("_at") / width).cast("long").alias("block"), (F.col("_at") % width).cast("int").alias("bit"))


#: One round of a search: from the rows (repo, block, node, fresh) to the rows that these bits arrive at, some of them repeated.
Step = Callable[[DataFrame], DataFrame]


def along(edges: DataFrame) -> Step:
    """Along each edge."""
    e = stage(edges.select("repo", F.col("src").alias("node"), "dst"), "graph")
    return lambda front: front.join(e, ["repo", "node"]).select("repo", "block", F.col("dst").alias("node"), "fresh")


def through(classes: DataFrame, pairs: DataFrame) -> Step:
    """From each node to all nodes of the classes that its own goes to: pairs(repo, src, dst) of classes(repo, node, class), which are never multiplied out."""
    of, pairs = stage(classes.select("repo", "node", "class").distinct(), "classes"), stage(pairs.select("repo", F.col("src").alias("class"), "dst").distinct(), "graph")

    def step(front: DataFrame) -> DataFrame:
        sent = front.join(of, ["repo", "node"]).groupBy("repo", "block", "class").agg(F.bit_or("fresh").alias("fresh"))
        met = sent.join(pairs, ["repo", "class"]).groupBy("repo", "block", F.col("dst").alias("class")).agg(F.bit_or("fresh").alias("fresh"))
        return met.join(of, ["repo", "class"]).select(*_KEY, "fresh")

    return step


def packed(edges: DataFrame | list[Step], sources: DataFrame, depth: int | None = None) -> DataFrame:
    """(repo, block, node, seen, levels): the sources of a block that reach a node; levels[d] has those that do in d hops and no fewer.

    sources as numbered() makes them; edges may be steps, all of which make up a hop. Ends when no bit is fresh, or after `depth` hops.
    """
    steps = edges if isinstance(edges, list) else [along(edges)]
    start = F.bit_or(F.expr("shiftleft(1L, bit)"))
    state = stage(sources.groupBy(*_KEY).agg(start.alias("seen")).select(*_KEY, "seen", F.col("seen").alias("fresh"), F.array("seen").alias("levels")), "levels")
    none = F.lit(None).cast("long")
    for d in count() if depth is None else range(depth):
        front = state.where("fresh <> 0").select(*_KEY, "fresh")
        arrived = reduce(DataFrame.unionByName, [step(front) for step in steps]).groupBy(*_KEY).agg(F.bit_or("fresh").alias("arrived"))
        held = state.select(*_KEY, none.alias("arrived"), "seen", "levels")
        both = arrived.select(*_KEY, "arrived", none.alias("seen"), F.lit(None).cast("array<long>").alias("levels")).unionByName(held)
        rows = both.groupBy(*_KEY).agg(F.coalesce(F.max("arrived"), F.lit(0).cast("long")).alias("arrived"), F.coalesce(F.max("seen"), F.lit(0).cast("long")).alias("seen"), F.max("levels").alias("levels"))
        fresh = F.col("arrived").bitwiseAND(F.bitwise_not("seen"))
        rows = rows.withColumn("fresh", fresh)
        # A node that is met for the first time has no earlier levels: they are filled up with zeros.
        filled = F.coalesce("levels", F.array_repeat(F.lit(0).cast("long"), d + 1))
        rows = rows.select(*_KEY, F.col("seen").bitwiseOR(F.col("fresh")).alias("seen"), "fresh", F.concat(filled, F.array("fresh")).alias("levels"))
        state, more = stage_if(rows, "levels", F.col("fresh") != 0)
        if not more:
            break
    return state.select(*_KEY, "seen", "levels")


def closed(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo, block, node, seen): the sources of a block that reach a node, as packed() gives without the hops."""
    e = edges.select("repo", F.col("src").alias("node"), "dst")
    state = stage(sources.groupBy(*_KEY).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("seen")).select(*_KEY, "seen", F.col("seen").alias("fresh")), "levels")
    none = F.lit(0).cast("long")
    while rows := state.where("fresh <> 0").count():
        met = _met(state.where("fresh <> 0").select(*_KEY, "fresh"), rows, e, ["repo", "node"])
        arrived = met.select("repo", "block", F.col("dst").alias("node"), F.col("fresh").alias("arrived"), none.alias("seen"))
        both = arrived.unionByName(state.select(*_KEY, none.alias("arrived"), "seen")).groupBy(*_KEY).agg(F.bit_or("arrived").alias("arrived"), F.bit_or("seen").alias("seen"))
        state = stage(both.select(*_KEY, F.col("seen").bitwiseOR(F.col("arrived")).alias("seen"), F.col("arrived").bitwiseAND(F.bitwise_not("seen")).alias("fresh")), "levels")
    return state.select(*_KEY, "seen")


def around(edges: DataFrame) -> DataFrame:
    """(repo, node, below, above): what the pivot of each repository reaches, and what reaches it; itself is both.

    The pivot is the node with most edges in times edges out. In a graph whose components have grown together
    most sources reach it, and then all that lies below.
    """
    out = lambda k, n: F.struct(F.col(k).alias("node"), F.lit(n).alias("out"))
    ends = edges.select("repo", F.explode(F.array(out("src", 1), out("dst", 0))).alias("x")).groupBy("repo", F.col("x.node").alias("node"))
    ways = ends.agg((F.sum("x.out") * F.sum(1 - F.col("x.out"))).alias("ways"))
    pivots = stage(ways.groupBy("repo").agg(F.max_by("node", F.struct("ways", "node")).alias("node")), "pivots")
    side = lambda back: F.struct("repo", F.lit(back).alias("back")).alias("repo")
    graph = edges.select(side(False), "src", "dst").unionByName(edges.select(side(True), F.col("dst").alias("src"), F.col("src").alias("dst")))
    starts = reduce(DataFrame.unionByName, [pivots.select(side(back), "node", F.lit(0).cast("long").alias("block"), F.lit(0).alias("bit")) for back in (False, True)])
    return closed(graph, starts).groupBy("repo.repo", "node").agg(F.max(~F.col("repo.back")).alias("below"), F.max("repo.back").alias("above"))


def marked(edges: DataFrame, hub: DataFrame) -> DataFrame:
    """edges with src_below, src_above, dst_below and dst_above: where its ends lie around() the pivot."""
    d = edges
    for k in ("src", "dst"):
        d = d.join(_apart(hub.select("repo", F.col("node").alias(k), F.col("below").alias(f"{k}_below"), F.col("above").alias(f"{k}_above"))), ["repo", k], "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return d.select("repo", "src", "dst", *(flag(f"{k}_{x}") for k in ("src", "dst") for x in ("below", "above")))


def closures(marks: DataFrame, hub: DataFrame, sources: DataFrame, *ways: str) -> DataFrame:
    """(repo, node, sets): for each node an array of (block, seen), the sources that reach it along the edges ('out'), against them ('in') or in one of both ways.

    sources as numbered() makes them, marks and hub from marked() and around(). A source that reaches the pivot has all
    that lies below; its search leaves that out and finds the rest. One that does not never meets what lies above.
    """
    at = sources.join(_apart(hub), ["repo", "node"], "left").select("repo", "node", "block", "bit", *(F.coalesce(k, F.lit(False)).alias(k) for k in ("below", "above")))
    at = stage(at, "sources")
    side = lambda back, via: F.struct("repo", F.lit(back).alias("back"), via.alias("via")).alias("repo")
    graphs, starts = [], []
    for way in ways:
        back, ends = way == "in", ("dst", "src") if way == "in" else ("src", "dst")
        below, above = ("src_above", "dst_below") if back else ("dst_below", "src_above")
        kinds = F.array_compact(F.array(F.when(~F.col(below), F.lit(True)), F.when(~F.col(above), F.lit(False))))
        graphs.append(marks.select("repo", F.col(ends[0]).alias("src"), F.col(ends[1]).alias("dst"), F.explode(kinds).alias("via")).select(side(back, F.col("via")), "src", "dst"))
        starts.append(at.select(side(back, F.col("below" if back else "above")), "node", "block", "bit"))
    graph = stage(reduce(DataFrame.unionByName, graphs), "graph")
    found = closed(graph, reduce(DataFrame.unionByName, starts)).groupBy("repo.repo", "node", "block").agg(F.bit_or("seen").alias("seen"))
    own = found.groupBy("repo", "node").agg(F.map_from_entries(F.collect_list(F.struct("block", "seen"))).alias("own"))
    none = F.lit(0).cast("long")
    bits = lambda way, flag: F.bit_or(F.when(F.col(flag), F.expr("shiftleft(1L, bit)")).otherwise(none)) if way in ways else F.max(none)
    blocks = at.groupBy("repo", "block").agg(bits("out", "above").alias("down"), bits("in", "below").alias("up"))
    blocks = stage(blocks.groupBy("repo").agg(F.collect_list(F.struct("block", "down", "up")).alias("blocks")), "blocks")
    seen = lambda x: F.when(F.col("below"), x.down).otherwise(none).bitwiseOR(F.when(F.col("above"), x.up).otherwise(none)).bitwiseOR(F.coalesce(F.element_at("own", x.block), none))
    sets = F.filter(F.transform("blocks", lambda x: F.struct(x.block.alias("block"), seen(x).alias("seen"))), lambda x: x.seen != 0)
    return hub.join(_apart(own), ["repo", "node"], "full").join(blocks, "repo").select("repo", "node", sets.alias("sets")).where(F.size("sets") > 0)


def unpacked(state: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, repo, node, dist) of packed levels, each source at 0 hops from its own node."""
    each = state.select(*_KEY, F.posexplode("levels").alias("dist", "bits")).where("bits <> 0")
    bits = F.filter(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda b: F.call_function("getbit", F.col("bits"), b) == 1)
    each = each.select(*_KEY, "dist", F.explode(bits).alias("bit"))
    return each.join(sources.select("repo", "block", "bit", "source"), ["repo", "block", "bit"]).select("source", "repo", "node", F.col("dist").cast("int").alias("dist"))


def reached(edges: DataFrame | list[Step], sources: DataFrame, depth: int | None = None) -> DataFrame:
    """(source, repo, node, dist) of all nodes that each of sources(repo, source, node) reaches."""
    own = stage(numbered(sources), "sources")
    return unpacked(packed(edges, own, depth), own)


def together(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, source, node) of nodes(repo, node), named so that numbered() puts nodes of one weak component side by side.

    A block of sources then reaches its own component and no other, however many there are.
    """
    part = _spread(stage(both_ways(edges), "graph"), nodes.select("repo", "node", F.col("node").alias("value")).distinct(), F.min)
    return part.select("repo", F.concat_ws("\x01", "value", "node").alias("source"), "node")


def _spread(e: DataFrame, values: DataFrame, better) -> DataFrame:
    """values(repo, node, value) after each node has taken the best value that reaches it along e(repo, src, dst), to the fixpoint."""
    now = stage(values.select("repo", "node", "value", F.lit(True).alias("moved")), "values")
    while some := now.where("moved").count():
        sent = _met(now.where("moved").select("repo", F.col("node").alias("src"), "value"), some, e, ["repo", "src"]).select("repo", F.col("dst").alias("node"), "value", F.lit(False).alias("own"))
        rows = sent.unionByName(now.select("repo", "node", "value", F.lit(True).alias("own"))).groupBy("repo", "node").agg(better("value").alias("value"), F.max(F.when(F.col("own"), F.col("value"))).alias("was"))
        now = stage(rows.where("was IS NOT NULL").select("repo", "node", "value", (F.col("value") != F.col("was")).alias("moved")), "values")
    return now.select("repo", "node", "value")


def strong_components(nodes: DataFrame, edges: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(repo, node, root): strongly connected components of nodes(repo, node), each named by its smallest member.

    What lies both below and above the pivot of a repository is one component, and no other spans two of the sides
    around it, so edges that do are dropped (`marks`: as marked() gives, if they are there already). Of the rest, edges
    from nodes without edges in or to nodes without edges out are trimmed, round by round. Then every node that is
    left takes the smallest node that reaches it as its colour; a colour whose own node lies in it is a root, and what
    reaches the root inside its colour is its component. Trimming and colours repeat on what is left; nodes that
    lose all edges are components of their own.
    """
    every = stage(nodes.select("repo", "node").distinct(), "live")
    if marks is None:
        e = stage(edges.where("src <> dst").select("repo", "src", "dst").distinct(), "graph")
        marks = stage(marked(e, stage(around(e), "hub")), "marks")
    core = reduce(DataFrame.unionByName, [marks.where(f"{k}_below AND {k}_above").select("repo", F.col(k).alias("node")) for k in ("src", "dst")]).distinct()
    core = stage(core, "found")
    done = [core.join(stage(core.groupBy("repo").agg(F.min("node").alias("root")), "roots"), "repo").select("repo", "node", "root")]
    e = stage(marks.where("src_below = dst_below AND src_above = dst_above AND NOT (src_below AND src_above)").select("repo", "src", "dst"), "graph")
    left = e.count()
    while left:
        while True:
            met, goes = e.select("repo", F.col("dst").alias("src")).distinct(), e.select("repo", F.col("src").alias("dst")).distinct()
            e = stage(e.join(_apart(met), ["repo", "src"], "left_semi").join(_apart(goes), ["repo", "dst"], "left_semi").select("repo", "src", "dst"), "graph")
            was, left = left, e.count()
            if was == left or not left:
                break
        if not left:
            break
        colour = _spread(e, e.select("repo", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("value", F.col("node")), F.min)
        ends = colour.withColumnRenamed("value", "c")
        inner = stage(e.join(_apart(ends.withColumnRenamed("node", "src")), ["repo", "src"]).join(_apart(ends.select("repo", F.col("node").alias("dst"), F.col("c").alias("c2"))), ["repo", "dst"]).where("c = c2").select("repo", "src", "dst"), "graph")
        hit = _spread(against(inner), colour.select("repo", "node", (F.col("node") == F.col("value")).cast("int").alias("value")), F.max).where("value = 1").select("repo", "node")
        found = stage(colour.join(_apart(hit), ["repo", "node"], "left_semi").select("repo", "node", F.col("value").alias("root")), "found")
        done.append(found)
        gone = [_apart(found.select("repo", F.col("node").alias(k))) for k in ("src", "dst")]
        e = stage(inner.join(gone[0], ["repo", "src"], "left_anti").join(gone[1], ["repo", "dst"], "left_anti").select("repo", "src", "dst"), "graph")
        left = e.count()
    return every.join(_apart(reduce(DataFrame.unionByName, done)), ["repo", "node"], "left").select("repo", "node", F.coalesce("root", "node").alias("root"))


def heights(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, node, root, height): how many components lie below a node's on the longest way down, by peeling edges to components without successors.

    Whatever a node reaches outside its own component has a smaller height, in every set that is
    closed under the edges. A component is as high as the rounds in which it still has an edge.
    """
    of = components.select("repo", "node", "root")
    up = edges.join(_apart(of.select("repo", F.col("node").alias("src"), F.col("root").alias("a"))), ["repo", "src"]).join(_apart(of.select("repo", F.col("node").alias("dst"), F.col("root").alias("b"))), ["repo", "dst"]).where("a <> b").select("repo", "a", "b").distinct()
    up, rounds = stage(up, "graph"), []
    left = up.count()
    while left:
        rounds.append(up.select("repo", F.col("a").alias("root"), F.lit(len(rounds) + 1).alias("height")))
        up = stage(up.join(_apart(up.select("repo", F.col("a").alias("b")).distinct()), ["repo", "b"], "left_semi").select("repo", "a", "b"), "graph")
        was, left = left, up.count()
        if left == was:
            raise ValueError("components have a loop")
    if not rounds:
        return of.withColumn("height", F.lit(0))
    at = reduce(DataFrame.unionByName, rounds).groupBy("repo", "root").agg(F.max("height").alias("height"))
    return of.join(_apart(at), ["repo", "root"], "left").select("repo", "node", "root", F.coalesce("height", F.lit(0)).alias("height"))


def _through(n: int, a: np.ndarray, b: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """What n nodes gain from some sources along edges a to b: ways are counted forward by levels, shares summed backward."""
    order = np.argsort(a, kind="stable")
    b, degree = b[order], np.bincount(a, minlength=n)
    first, total = np.cumsum(degree) - degree, np.zeros(n)
    many = max(1, CELLS // (n + len(b)))
    for chunk in (sources[i : i + many] for i in range(0, len(sources), many)):
        front = np.arange(len(chunk)) * n + chunk
        seen, ways, gain, mark = np.zeros(len(chunk) * n, bool), np.zeros(len(chunk) * n), np.zeros(len(chunk) * n), np.zeros(len(chunk) * n, np.int64)
        seen[front], ways[front], levels = True, 1.0, []
        while len(front):
            k = degree[front % n]
            src = np.repeat(front, k)
            at = np.arange(len(src)) - np.repeat(np.cumsum(k) - k, k) + first[src % n]
            dst = src - src % n + b[at]
            new = ~seen[dst]
            src, dst = src[new], dst[new]
            np.add.at(ways, dst, ways[src])
            seen[dst] = True
            mark[dst] = np.arange(len(dst))
            front = dst[mark[dst] == np.arange(len(dst))]
            levels.append((src, dst))
        for src, dst in reversed(levels):
            np.add.at(gain, src, ways[src] / ways[dst] * (1 + gain[dst]))
        gain[np.arange(len(chunk)) * n + chunk] = 0
        total += gain.reshape(-1, n).sum(axis=0)
    return total


def _nearness(n: int, a: np.ndarray, b: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of some sources reach each of n nodes along edges a to b, and their hops in sum; a source is a bit."""
    order = np.argsort(a, kind="stable")
    out, degree = b[order], np.bincount(a, minlength=n)
    first = np.cumsum(degree) - degree
    order = np.argsort(b, kind="stable")
    came, (heads, starts) = a[order], np.unique(b[order], return_index=True)
    found, hops = np.zeros(n, np.int64), np.zeros(n, np.int64)
    many = WIDTH * max(1, min(WIDTH, CELLS // (n + len(b))))
    for chunk in (sources[i : i + many] for i in range(0, len(sources), many)):
        at = np.arange(len(chunk))
        seen = np.zeros((n, -(-len(chunk) // WIDTH)), np.uint64)
        seen[chunk, at // WIDTH] = np.uint64(1) << (at % WIDTH).astype(np.uint64)
        fresh, front, hop = seen.copy(), chunk, 0
        while len(front):
            hop += 1
            k = degree[front]
            if k.sum() * 8 < len(b):
                # A small front sends along its own edges, a large one is asked for along all.
                src = np.repeat(front, k)
                dst = out[np.arange(len(src)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[front], k)]
                by = np.argsort(dst, kind="stable")
                src, (to, where) = src[by], np.unique(dst[by], return_index=True)
            else:
                src, to, where = came, heads, starts
            if not len(to):
                break
            new = np.bitwise_or.reduceat(fresh[src], where, axis=0) & ~seen[to]
            some = new.any(axis=1)
            fresh[front] = 0
            front, new = to[some], new[some]
            fresh[front] = new
            seen[front] |= new
            k = np.bitwise_count(new).sum(axis=1, dtype=np.int64)
            found[front] += k
            hops[front] += k * hop
    return found, hops


def _pieces(n: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, a, b): weak components of n nodes with the edges as places among `nodes`; small ones come several at once, those without edges are left out."""
    root = np.arange(n)
    while True:
        new, least = root.copy(), np.minimum(root[a], root[b])
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    order = np.argsort(root, kind="stable")
    begins = np.flatnonzero(np.diff(root[order], prepend=-1))
    bounds = np.append(begins[np.flatnonzero(np.diff(begins // PIECE, prepend=-1))], n)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    a, b = place[a], place[b]
    by = np.argsort(a, kind="stable")
    a, b = a[by], b[by]
    cuts = np.searchsorted(a, bounds)
    for lo, hi, s, t in zip(bounds, bounds[1:], cuts, cuts[1:]):
        if s < t:
            yield order[lo:hi], a[s:t] - lo, b[s:t] - lo


def _places(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo, node, at): numbers of all nodes and ends of edges, from 0 in each repository; and the edges (repo, a, b) of numbers."""
    every = nodes.select("repo", "node").unionByName(edges.select("repo", F.explode(F.array("src", "dst")).alias("node")))
    at = numbered(every.withColumn("source", F.col("node")))
    at = stage(at.select("repo", "node", (F.col("block") * WIDTH + F.col("bit")).cast("int").alias("at")), "places")
    ends = edges.join(at.select("repo", F.col("node").alias("src"), F.col("at").alias("a")), ["repo", "src"]).join(at.select("repo", F.col("node").alias("dst"), F.col("at").alias("b")), ["repo", "dst"])
    return at, ends.select("repo", "a", "b")


def _dealt(at: DataFrame, ends: DataFrame, own: DataFrame, count_: Callable[..., list[np.ndarray]], kinds: dict[str, str]) -> DataFrame:
    """(repo, at) with the sums of what count_(n, a, b, sources) gives for n nodes, for all sources own(repo, at) of a graph.

    A repository's graph goes to SLICES rows as two lists of numbers. A worker takes it apart into weak components; a
    large one's sources are dealt over the rows, a small one belongs to one of them, so copies of a graph cost copies of its work.
    """
    graph = ends.groupBy("repo").agg(F.collect_list(F.struct("a", "b")).alias("e")).select("repo", F.col("e.a").alias("a"), F.col("e.b").alias("b"))
    graph = graph.join(at.groupBy("repo").agg(F.count("*").cast("int").alias("n")), "repo")
    graph = graph.join(own.groupBy("repo").agg(F.collect_list("at").alias("own")), "repo")
    rows = graph.select("repo", "n", "a", "b", "own", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("part")).repartition(8 * SLICES, "repo", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, part = (batch.column(c)[i].as_py() for c in ("n", "part"))
                a, b, s = (batch.column(c)[i].values.to_numpy().astype(np.int64) for c in ("a", "b", "own"))
                mine = np.zeros(n, bool)
                mine[s] = True
                for k, (nodes, src, dst) in enumerate(_pieces(n, a, b)):
                    sources = np.flatnonzero(mine[nodes])
                    if len(nodes) > 2 * PIECE:
                        sources = sources[part::SLICES]
                    elif k % SLICES != part:
                        continue
                    found = count_(len(nodes), src, dst, sources)
                    some = np.flatnonzero(found[0])
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("repo")[i], len(some)), pa.array(nodes[some], pa.int32()), *(pa.array(x[some]) for x in found)], ["repo", "at", *kinds])

    repo = rows.schema["repo"].dataType.simpleString()
    gains = stage(rows.mapInArrow(run, f"repo {repo}, at int, " + ", ".join(f"{k} {v}" for k, v in kinds.items())), "gain", batch="8m")
    return gains.groupBy("repo", "at").agg(*(F.sum(k).alias(k) for k in kinds))


def _placed(nodes: DataFrame, edges: DataFrame, places: bool) -> tuple[DataFrame, DataFrame]:
    if not places:
        return _places(nodes, edges)
    return nodes.select("repo", "node", F.col("node").cast("int").alias("at")), edges.select("repo", F.col("src").cast("int").alias("a"), F.col("dst").cast("int").alias("b"))


def closeness(nodes: DataFrame, edges: DataFrame, places: bool = False) -> DataFrame:
    """(repo, node, score) of nodes(repo, node) by hops either way: reached others over their hops, times the share that is reached.

    Distances are the same from both ends, so a node counts the sources that reach it. With `places` nodes are numbers
    from 0 in each repository, all edges between them.
    """
    at, ends = _placed(nodes, edges, places)
    both = lambda n, a, b, s: list(_nearness(n, np.concatenate((a, b)), np.concatenate((b, a)), s))
    own = at if places else at.join(nodes.select("repo", "node").distinct(), ["repo", "node"], "left_semi")
    sums = _dealt(at, ends, own, both, {"found": "long", "hops": "long"}).join(at, ["repo", "at"]).select("repo", "node", "hops", F.col("found").cast("double").alias("found"))
    size = nodes.groupBy("repo").agg(F.count("*").alias("n"))
    score = F.col("found") / F.col("hops") * F.col("found") / (F.col("n") - 1)
    return nodes.select("repo", "node").join(sums, ["repo", "node"], "left").join(size, "repo").select("repo", "node", F.when(F.col("hops") > 0, score).otherwise(0.0).alias("score"))


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, places: bool = False) -> DataFrame:
    """(repo, node, score): shares of shortest directed ways through a node, over pairs of others.

    Sources are each of sources(repo, source), all nodes where none are given; a sample is scaled up. `places` as for closeness().
    Time grows with sources times edges of their components, shuffled bytes with edges and nodes.
    """
    own = (nodes.select("repo", F.col("node").alias("source")) if sources is None else sources.select("repo", "source")).distinct()
    at, ends = _placed(nodes.select("repo", "node").unionByName(own.select("repo", F.col("source").alias("node"))) if not places else nodes, edges, places)
    gains = _dealt(at, ends, own.join(at.withColumnRenamed("node", "source"), ["repo", "source"]), lambda *x: [_through(*x)], {"gain": "double"})
    sums = gains.join(at, ["repo", "at"]).select("repo", "node", "gain")
    size = nodes.groupBy("repo").agg(F.count("*").alias("n")).join(own.groupBy("repo").agg(F.count("*").alias("k")), "repo")
    scale = F.col("n") / F.col("k") / ((F.col("n") - 1) * (F.col("n") - 2))
    return nodes.select("repo", "node").join(sums, ["repo", "node"], "left").join(size, "repo", "left").select("repo", "node", F.coalesce(F.when(F.col("n") > 2, F.col("gain") * scale), F.lit(0.0)).alias("score"))


def _hops(n: int, a: np.ndarray, b: np.ndarray) -> Callable[[int], np.ndarray]:
    """Hops from a node along edges a to b, by node; -1 where there is no way."""
    order = np.argsort(a, kind="stable")
    b, degree = b[order], np.bincount(a, minlength=n)
    first = np.cumsum(degree) - degree

    def search(start: int) -> np.ndarray:
        far, front, hop = np.full(n, -1, np.int32), np.array([start]), 0
        far[start] = 0
        while len(front):
            hop += 1
            k = degree[front]
            dst = b[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[front], k)]
            front = np.unique(dst[far[dst] < 0])
            far[front] = hop
        return far

    return search


def _in_tasks(rows: DataFrame, each: Callable[[dict], Iterator[list]], kinds: dict[str, str], name: str) -> DataFrame:
    """(repo, ...) of what each(row) yields, columns by columns, for rows(repo, ...) whose lists come as arrays of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = lambda x: x.values.to_numpy().astype(np.int64) if isinstance(x, pa.ListScalar) else x.as_py()
                for cols in each({k: value(batch.column(k)[i]) for k in batch.schema.names if k != "repo"}):
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("repo")[i], len(cols[0])), *cols], ["repo", *kinds])

    repo = rows.schema["repo"].dataType.simpleString()
    return stage(rows.mapInArrow(run, f"repo {repo}, " + ", ".join(f"{k} {v}" for k, v in kinds.items())), name, batch="8m")


def _lists(edges: DataFrame) -> DataFrame:
    graph = edges.groupBy("repo").agg(F.collect_list(F.struct(F.col("src").cast("int").alias("a"), F.col("dst").cast("int").alias("b"))).alias("e"))
    return graph.select("repo", F.col("e.a").alias("a"), F.col("e.b").alias("b"))


def searched(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo, block, bit, node, dist) of the numbers that each source reaches, itself at 0, along edges of numbers.

    sources as numbered() makes them. 64 sources of a repository and its edges, as two lists, are searched by a worker at a time, so the
    number of rounds that Spark makes does not grow with the length of ways.
    """
    own = sources.groupBy("repo", "block").agg(F.collect_list(F.struct(F.col("bit").cast("int").alias("bit"), F.col("node").cast("int").alias("at"))).alias("s"))
    rows = own.join(_lists(edges), "repo", "left").select("repo", F.col("block").cast("long").alias("block"), F.coalesce("a", F.array().cast("array<int>")).alias("a"), F.coalesce("b", F.array().cast("array<int>")).alias("b"), F.col("s.bit").alias("bit"), F.col("s.at").alias("at"))

    def each(row: dict) -> Iterator[list]:
        a, b, at = row["a"], row["b"], row["at"]
        search = _hops(int(max(x.max(initial=0) for x in (a, b, at))) + 1, a, b)
        for bit, start in zip(row["bit"], at):
            far = search(start)
            some = np.flatnonzero(far >= 0)
            yield [pa.repeat(pa.scalar(row["block"], pa.int64()), len(some)), pa.repeat(pa.scalar(int(bit), pa.int32()), len(some)), pa.array(some), pa.array(far[some])]

    return _in_tasks(rows.repartition(8 * SLICES, "repo", "block"), each, {"block": "long", "bit": "int", "node": "long", "dist": "int"}, "reached")


def _peel(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, height) of n nodes as strong_components() and heights() give them, by one depth-first search with a stack."""
    order = np.argsort(a, kind="stable")
    out, ends = b[order].tolist(), np.cumsum(np.bincount(a, minlength=n)).tolist()
    at, low, root, height = [0, *ends[:-1]], [0] * n, [-1] * n, [0] * n
    when, open_, clock = [0] * n, [], 0
    for start in range(n):
        if when[start]:
            continue
        way = [start]
        while way:
            v = way[-1]
            if not when[v]:
                clock += 1
                when[v] = low[v] = clock
                open_.append(v)
            if at[v] < ends[v]:
                w = out[at[v]]
                at[v] += 1
                if not when[w]:
                    way.append(w)
                elif root[w] < 0:
                    low[v] = min(low[v], when[w])
                else:
                    height[v] = max(height[v], height[w] + 1)
                continue
            way.pop()
            if low[v] == when[v]:
                k = len(open_) - 1
                while open_[k] != v:
                    k -= 1
                part = open_[k:]
                del open_[k:]
                least, high = min(part), max(height[w] for w in part)
                for w in part:
                    root[w], height[w] = least, high
            if way:
                u = way[-1]
                if root[v] < 0:
                    low[u] = min(low[u], low[v])
                else:
                    height[u] = max(height[u], height[v] + 1)
    return np.array(root, np.int64), np.array(height, np.int32)


def peeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, node, root, height) of numbers from 0 in each repository, as heights() of strong_components(); a repository is one worker's."""
    size = nodes.groupBy("repo").agg(F.count("*").cast("int").alias("n"))
    rows = size.join(_lists(edges), "repo", "left").select("repo", "n", *(F.coalesce(k, F.array().cast("array<int>")).alias(k) for k in ("a", "b")))

    def each(row: dict) -> Iterator[list]:
        root, height = _peel(row["n"], row["a"], row["b"])
        yield [pa.array(np.arange(row["n"])), pa.array(root), pa.array(height)]

    return _in_tasks(rows.repartition(8 * SLICES, "repo"), each, {"node": "long", "root": "long", "height": "int"}, "heights")


def dependencies_first(reach: DataFrame, peeled: DataFrame, tie: Callable[[Column, Column], Column]) -> DataFrame:
    """(source, node, pos): what each source reaches, each after all that it depends on; members of a component lie together.

    reach(source, repo, node, dist) as reached() gives along the edges, peeled as heights() does;
    `tie` of a source and a node settles equals: components of one height go by that of their roots.
    """
    d = reach.where("dist > 0").join(peeled, ["repo", "node"])
    by = "height", tie(F.col("source"), F.col("root")), "root", tie(F.col("source"), F.col("node"))
    return d.select("source", "node", F.row_number().over(Window.partitionBy("source").orderBy(*by)).alias("pos"))

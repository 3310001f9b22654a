"""Nearest neighbours by a forest of random-projection trees and exact reranking.

A tree has one random direction for each of its levels and, in every node, the median of a
bounded sample there as cut; every vector is indexed. A query's leaves in all trees come out of
one priority queue, ordered by the squared distances to the cuts on whose far side they lie,
until it has its share of leaves. Leaves lie in blocks of neighbours; a block of leaves meets a
bounded number of the queries that want leaves of it in one task, and scores them exactly in
double precision. Equal vectors are one entry of the index that carries its smallest ids, as
only those can be among the nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import stage

#: Trees; vectors in a leaf on average, at every size.
TREES, LEAF = 4, 32
#: A query takes leaves of EFFORT * n ** POWER vectors out of n, from all trees together. Measured on vectors
#: without clusters, the hardest case: recall is 0.9 or more from 500 to 200,000 vectors of 64 dimensions.
EFFORT, POWER = 3.8, 0.82
#: Leaves of a block, and queries that meet a block at a time.
BLOCK, ASKED = 32, 4096
#: Vectors that the first leaves hold: they give a bound on what the rest may report.
FIRST = 4096
#: Vectors that trees are grown on at most, smallest hashes of the id first.
SAMPLE = 20_000


class Forest:
    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 11) -> None:
        self.depth, self.trees = depth, []
        r = np.random.default_rng(seed)
        for _ in range(trees):
            # Directions of a tree are at right angles as far as there are enough dimensions.
            q = [np.linalg.qr(r.normal(size=(sample.shape[1], sample.shape[1])))[0].T for _ in range(-(-depth // sample.shape[1]))]
            along = np.concatenate(q)[:depth] if depth else np.zeros((0, sample.shape[1]))
            place, node, cuts = sample @ along.T, np.zeros(len(sample), np.int64), []
            for d in range(depth):
                # A node without sampled vectors is cut where its level is cut on the whole.
                cut = np.full(1 << d, np.median(place[:, d]) if len(sample) else 0.0)
                order = np.argsort(node, kind="stable")
                edges = np.searchsorted(node[order], np.arange((1 << d) + 1))
                for k in np.flatnonzero(np.diff(edges)):
                    cut[k] = np.median(place[order[edges[k] : edges[k + 1]], d])
                cuts.append(cut)
                node = 2 * node + (place[:, d] > cut[node])
            self.trees.append((along, cuts))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each vector in each tree."""
        out = np.zeros((len(x), len(self.trees)), np.int64)
        for t, (along, cuts) in enumerate(self.trees):
            place = x @ along.T
            for d, cut in enumerate(cuts):
                out[:, t] = 2 * out[:, t] + (place[:, d] > cut[out[:, t]])
        return out

    def probe(self, x: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each row of x the trees and leaves that the queue gives out first, n in all, the nearest first.

        The distance of a leaf never falls on the way down, so the queue over open branches of all
        trees gives out leaves in the order of their distances: all are worked out at once, level by
        level, and the n smallest taken. Ties go to the first tree, then the first leaf.
        """
        far = []
        for along, cuts in self.trees:
            place, dist = x @ along.T, np.zeros((len(x), 1))
            for d, cut in enumerate(cuts):
                gap = place[:, d, None] - cut[None]
                down = np.empty((len(x), 2 << d))
                down[:, 0::2], down[:, 1::2] = dist + np.where(gap > 0, gap * gap, 0), dist + np.where(gap > 0, 0, gap * gap)
                dist = down
            far.append(dist)
        whole = np.concatenate(far, axis=1)
        for row in whole:
            got = np.argsort(row, kind="stable")[:n]
            yield got >> self.depth, got & ((1 << self.depth) - 1)


def leaves_of(n: int, depth: int, effort: float = EFFORT) -> int:
    """How many leaves a query takes out of n vectors in trees of a depth."""
    return max(1, min(TREES << depth, int(np.ceil(effort * n ** (POWER - 1) * 2**depth))))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): vectors as doubles. Null ids, null or empty vectors, zero vectors and those with null or non-finite parts are out."""
    v = F.col(vec_col).cast("array<double>")
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    return d.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _meet(members: pa.Table, asked: pa.Table, dim: int, k: int) -> pa.Table:
    """(q, c, score): of the wanted leaves of one block, each query's k + 1 best, as far as they reach its bound."""
    q, c, got = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    if members.num_rows and asked.num_rows:
        m, ids, leaf = _matrix(members.column("v"), dim), members.column("rep").to_numpy(), members.column("leaf").to_numpy()
        order = np.argsort(leaf, kind="stable")
        m, ids, leaf = m[order], ids[order], leaf[order]
        wanted = asked.column("leaves").combine_chunks()
        x, reps, bound = _matrix(asked.column("v"), dim), asked.column("rep").to_numpy(), asked.column("bound").to_numpy()
        owner, want = np.repeat(np.arange(len(x)), np.diff(wanted.offsets.to_numpy())), wanted.flatten().to_numpy()
        for s in range(0, len(x), 256):
            score = np.full((min(256, len(x) - s), len(m)), -np.inf)
            own = (owner >= s) & (owner < s + 256)
            for f in np.unique(want[own]):
                a, b = np.searchsorted(leaf, [f, f + 1])
                rows = owner[own][want[own] == f]
                if a < b:
                    score[rows - s, a:b] = x[rows] @ m[a:b].T
            least = bound[s : s + 256]
            if score.shape[1] > k + 1:
                least = np.maximum(least, np.partition(score, -(k + 1), axis=1)[:, -(k + 1)])
            i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
            q.append(reps[s + i])
            c.append(ids[j])
            got.append(score[i, j])
    return pa.table({"q": np.concatenate(q), "c": np.concatenate(c), "score": np.concatenate(got)})


def nearest(vectors: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", effort: float = EFFORT, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest by inner product.

    `is_query` is an SQL predicate over vec_id. Candidates are all usable rows (see usable())
    but those with the query's own id; vectors of another length than the commonest have
    inner products with none and take no part. Ties go to the smaller vec_id. Rows that
    repeat an id with an equal vector count once; with unequal vectors each is a candidate.
    Ids are integers. No usable rows give an empty result; other columns are not read.

    A query is scored against effort * n ** POWER vectors of n. That is much: without clusters,
    as in these tables, neighbours lie on all sides. With clusters a smaller effort will do.
    """
    spark = vectors.sparkSession
    d = usable(vectors, id_col, vec_col)
    sizes = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim = sizes.n
    d = d.where(F.size("v") == dim).distinct()
    # Only the k + 1 smallest ids of equal vectors can be among the nearest of any query; Spark drops the rest before the shuffle.
    low = d.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(f"r <= {k + 1}")
    classes = low.groupBy("v").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = stage(classes, "classes")
    n = classes.count()
    queries = d.where(is_query).select("vec_id", "v").join(classes.select("v", "rep"), "v").select(F.col("vec_id").alias("query_id"), "rep")
    queries = stage(queries, "queries")

    sample = np.array([r.v for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").collect()])
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    forest = Forest(sample, depth)
    pops = leaves_of(n, depth, effort)
    early = max(1, min(pops, FIRST // leaf))
    per_block = max(0, int(np.log2(BLOCK)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = forest.leaves(_matrix(b.column("v"), dim))
                for t in range(TREES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t), pa.int32()), pa.array(at[:, t] >> per_block), pa.array(at[:, t]), b.column("rep"), b.column("v")], ["tree", "block", "leaf", "rep", "v"])

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "block", "rep", "early", "leaves"]
        for b in batches:
            for s in range(0, b.num_rows, 64):
                own = b.slice(s, 64)
                for rep, (trees, at) in zip(own.column("rep").to_pylist(), forest.probe(_matrix(own.column("v"), dim), pops), strict=True):
                    late = np.arange(len(at)) >= early
                    key = ((trees << depth | at) >> per_block) * 2 + late if depth >= per_block else trees * 2 + late
                    order = np.argsort(key, kind="stable")
                    edge = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
                    first = order[edge]
                    lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(order)), pa.int32()), pa.array(at[order]))
                    yield pa.RecordBatch.from_arrays([pa.array(trees[first], pa.int32()), pa.array(at[first] >> per_block), pa.array(np.full(len(edge), rep)), pa.array(~late[first]), lists], names)

    index = stage(classes.select("rep", "v").mapInArrow(place, "tree int, block long, leaf long, rep long, v array<double>"), "index")
    entry = stage(queries.select("rep").distinct().join(classes.select("rep", "v"), "rep"), "asked")
    groups = max(1, -(-entry.count() // ASKED))
    probes = stage(entry.mapInArrow(seek, "tree int, block long, rep long, early boolean, leaves array<bigint>"), "probes")
    key = ["tree", "block", "part"]
    members = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))) if groups > 1 else index.withColumn("part", F.lit(0))

    def meet(asked: DataFrame) -> DataFrame:
        asked = asked.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(groups)).cast("int")).join(entry, "rep").select(*key, "leaves", "rep", "v", "bound")
        both = members.groupBy(*key).cogroup(asked.groupBy(*key))
        found = both.applyInArrow(lambda m, a: _meet(m, a, dim, k), "q long, c long, score double")
        return found.groupBy("q", "c").agg(F.max("score").alias("score"))

    # The first leaves give each query k + 1 candidates; the others report only what is as near.
    first = stage(meet(probes.where("early").withColumn("bound", F.lit(float("-inf")))), "early")
    kth = first.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).where(f"r = {k + 1}")
    kth = kth.select(F.col("q").alias("rep"), (F.col("score") - 1e-9 * (1 + F.abs("score"))).alias("bound"))
    late = meet(probes.where("NOT early").join(kth, "rep", "left").fillna(float("-inf"), ["bound"]))
    found = first.union(late).groupBy("q", "c").agg(F.max("score").alias("score"))
    # k + 1 classes hold the k nearest, whether the query's own row is among them or not.
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).where(f"r <= {k + 1}")
    rows = best.join(classes.select(F.col("rep").alias("c"), "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(f"r <= {k + 1}")
    near = stage(top.select("q", "score", "vec_id"), "near")
    out = queries.withColumnRenamed("rep", "q").join(near, "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.select("query_id", rank.alias("rank"), "vec_id", "score").where(f"rank <= {k}")

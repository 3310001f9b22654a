"""Random-walk ranks of many tasks on the graphs of many repositories, by joins keyed by (repo, node).

A row (repo, block, node) holds the scores of the node for the tasks of a block, so a round
moves all of them along an edge at once: one join and one sum of WIDTH numbers. Every BLOCK
rounds the scores are written out, and each task whose last round changed little is settled: it
is taken out with its scores, and blocks without other tasks take no part in the next rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.levels import numbered
from orrery.staging import stage, stage_if

#: Damping, and the change of a round for each node in sum at which a task is settled.
ALPHA, TOLERANCE = 0.85, 1e-6
#: Tasks of a block; rounds between two looks at the change, and the most rounds.
WIDTH, BLOCK, ROUNDS = 32, 3, 99
_KEY = ("repo", "block", "node")


def _each(of) -> Column:
    return F.array(*(of(j) for j in range(WIDTH)))


def ranked(nodes: DataFrame, edges: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task, repo, node, score) for all nodes of a task's repository.

    nodes(repo, node), edges(repo, src, dst, weight) between them, each pair once, tasks(task,
    repo, seed): a walk restarts at the seed, or anywhere where it is null; tasks with a seed
    that is no node have no rows. Nodes without successors send their mass where walks restart.
    All begin evenly; a task ends after a multiple of BLOCK rounds of which the last changed less
    than TOLERANCE for each node in sum, or after ROUNDS.
    """
    nodes = stage(nodes.select("repo", "node").distinct(), "nodes")
    known = tasks.select("repo", F.col("task").alias("source"), F.col("seed").alias("node"))
    known = known.where("node IS NULL").unionByName(known.join(nodes, ["repo", "node"], "left_semi").select("repo", "source", "node"))
    own = stage(numbered(known, WIDTH), "tasks")
    size = nodes.groupBy("repo").agg(F.count("*").cast("double").alias("n"))
    out = edges.groupBy("repo", "src").agg(F.sum("weight").alias("all"))
    flow = edges.join(out, ["repo", "src"]).select("repo", F.col("src").alias("node"), "dst", (F.col("weight") / F.col("all")).alias("share"), F.lit(0.0).alias("stay"))
    # Each node also goes to itself, to be compared, and those without successors to nowhere, to be sent back.
    stay = nodes.select("repo", "node", F.col("node").alias("dst"), F.lit(0.0).alias("share"), F.lit(1.0).alias("stay"))
    ends = nodes.join(out.select("repo", F.col("src").alias("node")), ["repo", "node"], "left_anti").select("repo", "node", F.lit(None).cast(nodes.schema["node"].dataType).alias("dst"), F.lit(1.0).alias("share"), F.lit(0.0).alias("stay"))
    e = stage(flow.unionByName(stay).unionByName(ends), "flow")

    has = lambda j: F.max(F.when(F.col("bit") == j, 1.0).otherwise(0.0))
    blocks = stage(own.groupBy("repo", "block").agg(_each(has).alias("live")), "blocks")
    at_seed = own.where("node IS NOT NULL").groupBy(*_KEY).agg(_each(has).alias("p"))
    anywhere = own.where("node IS NULL").groupBy("repo", "block").agg(_each(has).alias("h")).join(size, "repo").join(nodes, "repo").select(*_KEY, F.transform("h", lambda v: v / F.col("n")).alias("p"))
    start = stage(at_seed.unionByName(anywhere).groupBy(*_KEY).agg(_each(lambda j: F.sum(F.col("p")[j])).alias("p")), "start")
    x = blocks.join(size, "repo").join(nodes, "repo").select(*_KEY, F.transform("live", lambda v: v / F.col("n")).alias("x"))

    def step(x: DataFrame, compare: bool) -> DataFrame:
        sums = [_each(lambda j: F.sum(F.col("x")[j] * F.col("share")) * ALPHA).alias("y")]
        if compare:
            sums.append(_each(lambda j: F.sum(F.col("x")[j] * F.col("stay"))).alias("old"))
        y = x.join(e, ["repo", "node"]).groupBy("repo", "block", F.col("dst").alias("node")).agg(*sums)
        lost = y.where("node IS NULL").select("repo", "block", F.col("y").alias("lost"))
        back = start.join(lost, ["repo", "block"], "left").select(*_KEY, _each(lambda j: F.col("p")[j] * (1 - ALPHA + F.coalesce(F.col("lost")[j], F.lit(0.0)))).alias("back"))
        both = y.where("node IS NOT NULL").join(back, [*_KEY], "left")
        return both.select(*_KEY, *(["old"] if compare else []), _each(lambda j: F.col("y")[j] + F.coalesce(F.col("back")[j], F.lit(0.0))).alias("x"))

    taken = []
    for r in range(BLOCK, ROUNDS + 1, BLOCK):
        for k in range(BLOCK):
            x = stage(step(x, k == BLOCK - 1), "ranks")
        change = x.groupBy("repo", "block").agg(_each(lambda j: F.sum(F.abs(F.col("x")[j] - F.col("old")[j]))).alias("change")).join(size, "repo")
        rests = lambda j: (F.col("live")[j] > 0) & ((F.col("change")[j] < F.col("n") * TOLERANCE) | F.lit(r == ROUNDS))  # noqa: B023, E731
        flags = blocks.join(change, ["repo", "block"]).select("repo", "block", _each(lambda j: rests(j).cast("int")).alias("settled"), _each(lambda j: F.when(rests(j), 0.0).otherwise(F.col("live")[j])).alias("live"))
        flags, more = stage_if(flags, "flags", F.exists("live", lambda v: v > 0))
        taken.append(x.join(flags.where("array_contains(settled, 1)").drop("live"), ["repo", "block"]).select(*_KEY, "x", "settled"))
        blocks = flags.where("exists(live, v -> v > 0)").select("repo", "block", "live")
        if not more:
            break
        x = x.join(blocks, ["repo", "block"]).select(*_KEY, _each(lambda j: F.col("x")[j] * F.col("live")[j]).alias("x"))
        start = start.join(blocks.select("repo", "block"), ["repo", "block"], "left_semi")
    ends = reduce(DataFrame.unionByName, taken)
    each = ends.select(*_KEY, F.posexplode(F.arrays_zip("x", "settled")).alias("bit", "v")).where("v.settled = 1")
    return each.join(own.select("repo", "block", "bit", F.col("source").alias("task")), ["repo", "block", "bit"]).select("task", "repo", "node", F.col("v.x").alias("score"))

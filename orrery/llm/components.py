"""Connected components by repeated contraction, one staged table for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as edges(u, v) of long ids.

    Returns (node, component): the smallest id reachable, for each id that some edge
    names. Loops and repeated edges are harmless; edges with a null end are ignored; no
    edges give an empty table. In every round each vertex moves to its smallest
    neighbour and edges are contracted, so at least half of the vertices that still
    have edges vanish; nothing but a row count reaches the driver.
    """
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    live = stage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    both = live.select("u", "v").union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
    owner = None
    while not live.isEmpty():
        step = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("to"))
        # Staged, so that the join below reads plain tables: Spark then splits the rows of a vertex that many point to.
        step = stage(step, "step")
        # Two hops of the pointers at once.
        hop = step.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        step = stage(step.join(hop, "to", "left").select("node", F.coalesce("to2", "to").alias("to")), "step")
        if owner is None:
            owner = step.select("node", F.col("to").alias("component"))
        else:
            far = step.select(F.col("node").alias("component"), "to")
            owner = stage(owner.join(far, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "owner")
        a = step.select(F.col("node").alias("u"), F.col("to").alias("cu"))
        b = step.select(F.col("node").alias("v"), F.col("to").alias("cv"))
        e = live.join(a, "u").join(b, "v").where("cu <> cv")
        live = stage(e.select(F.greatest("cu", "cv").alias("u"), F.least("cu", "cv").alias("v")).distinct(), "edges")
        both = live.select("u", "v").union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if owner is None:
        return both.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return owner

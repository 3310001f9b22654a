"""Graph operators on edges(src, dst): levels, hops, rank iterations, reference and history graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import levels
from orrery.staging import stage

#: Rounds of the iteration of hubs between two staged tables; whether it has settled is looked at there.
HITS_BLOCK = 8


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(task, node, dist) of all that each seed(task, node) reaches in one large graph, the seed at 0; with `depth` the search ends after so many hops."""
    whole = F.lit("all").alias("repo")
    found = levels.reached(edges.select(whole, "src", "dst"), seeds.select(whole, F.col("task").alias("source"), "node"), depth)
    return found.select(F.col("source").alias("task"), "node", "dist")


def hits_authority(nodes: DataFrame, edges: DataFrame, rounds: int = 1000, tol: float = 1e-8) -> DataFrame:
    """(node, score): authority by power iteration; hubs and authorities sum to 1.

    Ends after a multiple of HITS_BLOCK rounds of which the last changed the hubs by less than `tol` in sum; if they
    still change by more after `rounds`, the in-degree is the score. Sums are scaled once a block.
    """
    n = nodes.count()
    e = stage(edges.select("src", "dst"), "graph")
    hub = nodes.select("node", F.lit(1.0 / max(n, 1)).alias("h"))
    to, back = e.withColumnRenamed("src", "node"), e.withColumnRenamed("dst", "node")
    for _ in range(0, rounds, HITS_BLOCK):
        for _ in range(HITS_BLOCK):
            old = hub
            auth = old.join(to, "node").groupBy(F.col("dst").alias("node")).agg(F.sum("h").alias("a"))
            hub = auth.join(back, "node").groupBy(F.col("src").alias("node")).agg(F.sum("a").alias("h"))
        kinds = ((old, "h", "old"), (auth, "a", "auth"), (hub, "h", "hub"))
        rows = stage(reduce(DataFrame.unionByName, [d.select("node", F.col(c).alias("v"), F.lit(k).alias("kind")) for d, c, k in kinds]), "graph")
        total = {r.kind: r.t for r in rows.groupBy("kind").agg(F.sum("v").alias("t")).collect()}
        if "hub" not in total:
            auth = rows.select("node", F.col("v").alias("a"))
            break
        of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("v") / total[k])), F.lit(0.0))  # noqa: B023, E731
        change = rows.groupBy("node").agg(F.abs(of("hub") - of("old")).alias("c")).agg(F.sum("c")).first()[0]
        auth = rows.where("kind = 'auth'").select("node", (F.col("v") / total["auth"]).alias("a"))
        hub = rows.where("kind = 'hub'").select("node", (F.col("v") / total["hub"]).alias("h"))
        if change < tol:
            break
    else:
        auth = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").cast("double").alias("a"))
    return nodes.join(auth, "node", "left").select("node", F.coalesce("a", F.lit(0.0)).alias("score"))


def cochange(commits: DataFrame, low: int = 2, high: int = 50) -> DataFrame:
    """(seed, path, score): sum of 1 / (n - 1) over commits(commit, path) of low..high paths that hold both."""
    c = commits.distinct()
    n = c.groupBy("commit").agg(F.count("*").alias("n")).where(f"n BETWEEN {low} AND {high}")
    c = c.join(n, "commit")
    other = c.select("commit", F.col("path").alias("seed"))
    return c.join(other, "commit").where("path <> seed").groupBy("seed", "path").agg(F.sum(1.0 / (F.col("n") - 1)).alias("score"))


def reference_graph(defs: DataFrame, refs: DataFrame, most: int = 5) -> DataFrame:
    """(src, dst, weight): names used in src and defined in dst; names with over `most` definers are ignored."""
    d = defs.distinct()
    few = d.groupBy("name").agg(F.count("*").alias("n")).where(f"n <= {most}").select("name")
    d = d.join(few, "name", "left_semi").withColumnRenamed("file", "dst")
    return refs.distinct().withColumnRenamed("file", "src").join(d, "name").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def positions(rows: DataFrame, by: list[Column], name: str = "pos") -> DataFrame:
    """rows with their places, from 1, in one order of all of them, and `n`, their number.

    Rows are sorted in ranges, so no task holds all of them; each range then begins where the
    ranges before it end.
    """
    # Staged, as ranges are drawn anew whenever they are computed; files of a range keep its rows together.
    cut = stage(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_size")).collect()
    before, total = [], 0
    for r in sorted(sizes, key=lambda r: r["_range"]):
        before.append((r["_range"], total))
        total += r["_size"]
    at = F.broadcast(rows.sparkSession.createDataFrame(before, "_range int, _before long"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return cut.join(at, "_range").withColumn(name, F.col("_before") + own).withColumn("n", F.lit(total).cast("long")).drop("_range", "_before")


def ordered(rows: DataFrame, by: list[Column], keys: tuple[str, ...] = ("task",)) -> DataFrame:
    """rows with pos from 1 in each task."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))

"""Blocks of sources keep to one weak component each, so copies of a graph cost copies of its rows."""

from pyspark.sql import functions as F

from orrery.operators import levels as L


def test_copies_of_a_graph(spark):
    # Names of the copies alternate: by name alone each block would hold sources of all copies.
    nodes = spark.range(256).select(F.lit("r").alias("repo"), F.format_string("n%03d", "id").alias("node"))
    edges = spark.range(252).select(F.lit("r").alias("repo"), F.format_string("n%03d", "id").alias("src"), F.format_string("n%03d", F.col("id") + 4).alias("dst"))
    own = L.numbered(L.together(nodes, edges))
    assert L.packed(L.both_ways(edges), own, 1).count() == 256
    assert own.groupBy("block").agg(F.countDistinct(F.substring("node", 2, 3).cast("int") % 4).alias("c")).agg(F.max("c")).first()[0] == 1

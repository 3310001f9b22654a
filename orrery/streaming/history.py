"""Extension: co-change scores kept up to date as commits arrive, as a Structured Streaming aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cochange_stream(commits: DataFrame, window: str = "30 days", late: str = "1 day", low: int = 2, high: int = 50) -> DataFrame:
    """(begin, seed, path, score) per window of time from a stream of commits(sha, ts timestamp, paths array<string>).

    Each commit is one row, so its pairs are made without state: 1 / (n - 1) for each ordered
    pair of its n distinct paths, if there are low..high of them. Only the sums are state, and
    the watermark drops them once a window can change no more. Null paths are left out.
    """
    own = commits.withWatermark("ts", late).withColumn("paths", F.array_distinct(F.array_compact("paths")))
    n = F.size("paths")
    own = own.where(n.between(low, high)).select("ts", "paths", (1.0 / (n - 1)).alias("w"), F.explode("paths").alias("seed"))
    pairs = own.select("ts", "w", "seed", F.explode("paths").alias("path")).where("seed <> path")
    sums = pairs.groupBy(F.window("ts", window).alias("at"), "seed", "path").agg(F.sum("w").alias("score"))
    return sums.select(F.col("at.start").alias("begin"), "seed", "path", "score")

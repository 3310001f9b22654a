"""Budgeted coverage of answer keys along orderings(task, method, path, pos, cost, in_key, key_size)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Budgets in lines and in files.
BUDGETS = (250, 500, 1000, 2000, 4000, 8000, 16000, 32000)
FILE_BUDGETS = (1, 2, 4, 8, 16, 32, 64, 128)


def budgets(spark: SparkSession, values: tuple[int, ...] = BUDGETS) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(b,) for b in values], "budget int"))


def running(order: DataFrame) -> DataFrame:
    """order with cum (cost so far) and hits (key members so far)."""
    w = Window.partitionBy("task", "method").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return order.withColumn("cum", F.sum("cost").over(w)).withColumn("hits", F.sum("in_key").over(w))


def coverage(order: DataFrame) -> DataFrame:
    """(task, method, budget, coverage): the share of the key read before the first file that overflows."""
    r = running(order)
    aggs = [F.sum(F.when(F.col("cum") <= b, F.col("in_key")).otherwise(0)).alias(f"b{b}") for b in BUDGETS]
    wide = r.groupBy("task", "method").agg(F.max("key_size").alias("key_size"), *aggs)
    return wide.select("task", "method", F.explode(F.array(*(F.struct(F.lit(b).alias("budget"), (F.col(f"b{b}") / F.col("key_size")).alias("coverage")) for b in BUDGETS))).alias("x")).select("task", "method", "x.*")


def coverage_files(order: DataFrame) -> DataFrame:
    aggs = [F.sum(F.when(F.col("pos") <= b, F.col("in_key")).otherwise(0)).alias(f"b{b}") for b in FILE_BUDGETS]
    wide = order.groupBy("task", "method").agg(F.max("key_size").alias("key_size"), *aggs)
    return wide.select("task", "method", F.explode(F.array(*(F.struct(F.lit(b).alias("budget"), (F.col(f"b{b}") / F.col("key_size")).alias("coverage")) for b in FILE_BUDGETS))).alias("x")).select("task", "method", "x.*")


def coverage_skip(order: DataFrame) -> DataFrame:
    """Greedy reading that skips a file which would overflow and goes on."""
    seq = order.groupBy("task", "method").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("cost").cast("long").alias("cost"), F.col("in_key").cast("long").alias("in_key")))).alias("seq"), F.max("key_size").alias("key_size"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("hits"))
    d = seq.crossJoin(budgets(order.sparkSession))

    def step(acc, x):
        fits = acc["used"] + x["cost"] <= F.col("budget")
        return F.struct(F.when(fits, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"), F.when(fits, acc["hits"] + x["in_key"]).otherwise(acc["hits"]).alias("hits"))

    return d.select("task", "method", "budget", (F.aggregate("seq", zero, step)["hits"] / F.col("key_size")).alias("coverage"))


def lines_to_reach(order: DataFrame) -> DataFrame:
    """(task, method, lines_half, lines_all): the first cost at which half, or all, of the key is found; null if never."""
    r = running(order)
    at = lambda need: F.min(F.when(F.col("hits") >= need, F.col("cum")))
    return r.groupBy("task", "method").agg(at(F.ceil(F.col("key_size") * 0.5)).alias("lines_half"), at(F.col("key_size")).alias("lines_all"))


def auc(curve: DataFrame) -> DataFrame:
    return curve.groupBy("task", "method").agg(F.avg("coverage").alias("auc"))

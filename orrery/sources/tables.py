"""Readers and writers, and the roles that tables play for the reading-order operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, paths: list[str] | str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(paths, header=True)


def read_jsonl(spark: SparkSession, paths: list[str] | str, schema: StructType | str) -> DataFrame:
    """JSON lines, plain or gzipped."""
    return spark.read.schema(schema).json(paths)


def read_json_object(spark: SparkSession, path: str, value: str) -> DataFrame:
    """One object keyed by id, as rows (id, value)."""
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return one.select(F.explode("m").alias("id", "value"))


def first_nonblank(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The first value per key, in the given order, that is not null or blank."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.where(F.trim(F.coalesce(value, F.lit(""))) != "").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def write_new(df: DataFrame, path: str) -> None:
    """Parquet that is left alone if it is there already, so a run can be taken up again."""
    df.write.mode("ignore").parquet(path)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: (doc, repo, path, text, cost)."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".py"))
    return d.select(F.col("doc_id").alias("doc"), F.col("source").alias("repo"), path.alias("path"), "text", F.greatest(T.line_count(F.col("text")), F.lit(1)).alias("cost"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms (task, term) of each benchmark item, each once."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task"), F.explode(F.array_distinct(T.bag_tokens(F.col("text")))).alias("term"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow each other in an order: (src, dst), no loops, each once."""
    line = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    e = line.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return e.where("dst IS NOT NULL AND src <> dst").distinct()


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("cost"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per brand: its smallest part is the seed."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("task")).agg(F.min("p_partkey").alias("node"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as score rows: (task, pr, repo, method, auc)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("task"), F.col("user_id").alias("pr"), (F.col("user_id") % 7).alias("repo"), F.col("event_type").alias("method"), F.col("value").alias("auc"))

"""The corpus pipeline: quality, near-duplicates, secrets, packing, each over all that its predecessor kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import near_dedup, packing, quality, secrets_scan
from orrery.llm.common import stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws."""
    return quality.resample(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("selected").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group (five words, similarity of 0.8 or more)."""
    gone = near_dedup.near_duplicates(docs).where("NOT kept").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars of a changed text is counted anew."""
    d = secrets_scan.redact(docs.select(*COLUMNS, F.col("text").alias("_before"))).withColumn("n_chars", F.when(F.col("text") != F.col("_before"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return d.select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of tokens over all documents: one row for each piece."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return packing.pack(docs.select("doc_id", F.size(words).alias("n_tokens"), "source", F.md5(F.lower(F.array_join(words, " "))).alias("cluster")))


STAGES = [("quality", quality_stage), ("near_dedup", dedup_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: Minhashing, Gumbel draws and best-fit search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    kept = reduce(lambda d, s: stage(s[1](spark, d, sf_dir), s[0]), first, docs)
    return last(spark, kept, sf_dir)

"""Tables in the folder that driver and executors share: lineage ends there, and lost executors cost nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession

#: Shuffle files are dropped as soon as the write that made them has ended, not when the driver's memory is next cleaned.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, one of our own, which only a session on one machine may use."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return where or "/tmp/checkpoints/orrery"


def stage(df: DataFrame, name: str = "table", compression: str = "snappy", batch: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back. The files go when the driver ends. `batch` bounds the bytes of an Arrow batch."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orrery-{name}-{uuid.uuid4().hex}"
    wanted = {_CLEANUP: "true"} | ({_BATCH: batch} if batch else {})
    was = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path, compression=compression)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def stage_if(df: DataFrame, name: str = "table", of: Column | None = None) -> tuple[DataFrame, bool]:
    """stage(df), and whether it has a row, or one for which `of` holds."""
    made = stage(df, name)
    return made, not (made if of is None else made.where(of)).isEmpty()

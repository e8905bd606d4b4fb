"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; where that is unset and Spark runs in one process, under a folder of our own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("kgivm.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kgivm-")
        spark.conf.set("kgivm.scratch", base)
    return f"{base.rstrip('/')}/kgivm-{uuid.uuid4().hex}"


def saved(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written as Parquet and read again: its lineage ends at files that survive a lost executor."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.options(**options).parquet(path)
    drop_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a saved frame that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner see finished shuffles, so that their files go before the next step writes."""
    spark.sparkContext._jvm.System.gc()

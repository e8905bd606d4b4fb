"""Cutting lineage at files that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_path(spark: SparkSession) -> str:
    """A new name under spark.checkpoint.dir, or under a folder of our own where that is unset in local mode."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("kgivm.staging", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kgivm-")
        spark.conf.set("kgivm.staging", base)
    return f"{base.rstrip('/')}/kgivm-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet under ``staging_path`` and read again. Unlike a checkpoint it computes the frame once."""
    path = staging_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

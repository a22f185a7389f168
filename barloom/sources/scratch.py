"""Where queries that write put their files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where that is unset: a temporary folder if driver and executors are one process
    (master local, as in tests), else a folder below the warehouse, which they share.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    where = where or spark.conf.get("spark.barloom.scratch.dir", None)
    if not where:
        if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            where = "file://" + tempfile.mkdtemp(prefix="spark-barloom-")
        else:
            where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/barloom-scratch"
        spark.conf.set("spark.barloom.scratch.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below scratch_dir."""
    return f"{scratch_dir(spark)}/barloom/{tag}-{uuid.uuid4().hex}"


def settled(df: DataFrame, tag: str) -> DataFrame:
    """df written once and read again, for plans that use it several times."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

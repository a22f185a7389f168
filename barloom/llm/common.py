"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of the mixing and fingerprint operators: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of an Arrow batch of whole texts, where the session leaves Spark's default.
BATCH_BYTES = "8m"

#: Tables up to this many bytes (rows times a stated row width) may be broadcast.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
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


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/barloom/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with so many underscores before it that df has no column of the name."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def word_count(text: str | Column) -> Column:
    """Number of words (runs without ASCII white space); null text counts 0."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast where rows * row_bytes is below the fixed bound, else joined by shuffle.

    Beyond the bound Spark's own choice, which goes by the compressed size of staged
    tables, is overruled too; adaptive execution splits skewed partitions.
    """
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df.hint("merge")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB in place of 64: rows are whole texts, and a worker holds a batch several times over."""
    of = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(of) is None:
        spark.conf.set(of, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

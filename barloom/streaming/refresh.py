"""Incremental refresh of a bar table from newly arrived files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from barloom.operators.clean import normalize_market
from barloom.operators.features import add_features
from barloom.operators.index import build_index
from barloom.sources.schemas import BARS


def last_versions(df: DataFrame, key: tuple[str, ...] = ("symbol", "date"), version: str = "version") -> DataFrame:
    """Of each key the row with the largest version."""
    at = F.row_number().over(W.partitionBy(*key).orderBy(F.col(version).desc()))
    return df.withColumn("_at", at).filter("_at = 1").drop("_at")


def write_parts(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions of a table that df has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def refresh_index(spark: SparkSession, in_path: str, contracts: str, index: str, features: str, checkpoint: str, schema, horizon: int = 5) -> StreamingQuery:  # noqa: ANN001
    """refresh_bars of contract bars (product, contract, date, measures), with the index and its features after it.

    Of a batch only the products that it touches are read again, and their
    partitions of the index (by product) and of the features (by dataset) rewritten.
    """

    def rebuild(rows: DataFrame) -> None:
        write_parts(build_index(rows), index, "product")
        built = spark.read.parquet(index).join(rows.select("product").distinct(), "product", "left_semi")
        market = built.withColumn("dataset", F.concat("product", F.lit("_weighted"))).drop("product").withColumn("_ordinal", F.lit(0))
        write_parts(add_features(normalize_market(market, None, "_ordinal"), horizon=horizon)[0], features, "dataset")

    return refresh_bars(spark, in_path, contracts, checkpoint, schema, ("product", "contract", "date"), rebuild)


def refresh_bars(spark: SparkSession, in_path: str, out_path: str, checkpoint: str, schema=None, key: tuple[str, ...] = ("symbol", "date"), after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:  # noqa: ANN001
    """Takes in all Parquet bar files not seen before, then stops; the later file's row of a key (symbol, date) wins.

    Only the partitions of symbols (the key's first column) that the new files hold
    are rewritten. Late bars are corrections, so there is no watermark. A batch that
    is run again writes the same rows: versions are file times, and the table keeps
    them. after gets the whole rows of the symbols that a batch has touched, once
    they are in the table; what it writes must bear being written again.
    """
    schema, by = schema or BARS, key[0]
    rows = spark.readStream.schema(schema).parquet(in_path)
    rows = rows.withColumn("version", F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file")))

    def merge(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        touched = batch.select(by).distinct()
        every = batch
        jvm = session.sparkContext._jvm.org.apache.hadoop.fs.Path(out_path)
        if jvm.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
            known = session.read.schema(batch.schema).parquet(out_path)
            every = batch.unionByName(known.join(touched, by, "left_semi"))
        # A table is not read while it is overwritten: the merged rows are written beside it first.
        aside = f"{checkpoint.rstrip('/')}/merged"
        last_versions(every, key).write.mode("overwrite").parquet(aside)
        merged = session.read.schema(batch.schema).parquet(aside)
        write_parts(merged.repartition(by).sortWithinPartitions(by, "date"), out_path, by)
        if after:
            after(merged.drop("version"))

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

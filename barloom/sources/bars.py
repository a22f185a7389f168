"""Bar files and tables: readers, full and partial refresh, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.guards import some_rows
from barloom.operators.clean import dated, normalize_market
from barloom.sources.schemas import BAR_FILE, BARS, CONTRACT_FILE, MEASURES, validate_columns


def _csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def _file_stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)


def read_bars(spark: SparkSession, path: str | list[str], registry: DataFrame | None = None, schema: T.StructType = BAR_FILE, key_from_path: Column | None = None, on_bad: str = "drop", rejects: Observation | None = None) -> DataFrame:
    """One CSV file per symbol as the long bar table; the symbol is the file's name up to the first dot.

    Rows without a date are left out; dates and numbers that do not parse go as clean.dated says.

    registry (symbol, commodity_slug), a small dimension, names the slugs; without
    it they are NULL. Rows of symbols that it lacks stay, with a NULL slug.
    """
    key = key_from_path if key_from_path is not None else _file_stem()
    rows = dated(_csv(spark, path, schema).withColumn("symbol", key), MEASURES, on_bad, rejects)
    if registry is None:
        rows = rows.withColumn("commodity_slug", F.lit(None).cast("string"))
    else:
        rows = rows.join(registry.select("symbol", "commodity_slug"), "symbol", "left")
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in BARS.fields])


def read_contracts(spark: SparkSession, path: str | list[str], rejects: Observation | None = None, lazy: bool = False) -> DataFrame:
    """Contract files (laid out <product>/<contract>.csv) as product, contract, date, measures and path.

    Numbers are coerced; rows without a date or a close are dropped (rejects counts
    the bad ones). No row at all is an error: at once, or (lazy) when the result is read.
    """
    rows = _csv(spark, path, CONTRACT_FILE)
    rows = rows.withColumn("product", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    rows = rows.withColumn("path", F.col("_metadata.file_path"))
    rows = dated(rows, MEASURES, "drop", rejects).dropna(subset=["close"]).select("product", "contract", "date", *MEASURES, "path")
    missing = f"no contract rows under {path}"
    if lazy:
        return some_rows(rows, rows.select("close"), missing)
    if rows.isEmpty():
        raise ValueError(missing)
    return rows


def read_market(spark: SparkSession, path: str, dataset: str | None = None, on_bad: str = "raise", rejects: Observation | None = None) -> DataFrame:
    """Main or weighted series from CSV (*.csv) or Parquet, normalised; the file's own row order decides repeats.

    CSV is read as text and coerced, in one scan. dataset=None: path is a folder
    with a part dataset=<name> for each series, all read at once.
    """
    csv = spark.read.option("header", True).option("inferSchema", False)
    raw = csv.csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    if dataset is None:
        raw = raw.withColumn("dataset", F.col("dataset").cast("string"))
    ordinal = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return normalize_market(raw.withColumn("_ordinal", ordinal), dataset, "_ordinal", on_bad=on_bad, rejects=rejects)


def save_bars(df: DataFrame, table: str, by: str = "symbol", partial: bool = False) -> None:
    """Full refresh of a bar table, one partition per symbol; partial replaces only the partitions that df holds."""
    writer = df.write.mode("overwrite").partitionBy(by)
    writer.option("partitionOverwriteMode", "dynamic" if partial else "static").parquet(table)


def bar_metadata(df: DataFrame, key: tuple[str, ...] = ("symbol", "commodity_slug"), time: str = "date") -> DataFrame:
    return df.groupBy(*key).agg(F.min(time).alias("start_date"), F.max(time).alias("end_date"), F.count("*").alias("row_count"))


def contract_manifest(df: DataFrame, path: str = "path") -> DataFrame:
    """Per contract: rows, first and last date, whole volume and (if df has one) the file, by start and name."""
    aggs = [F.count("*").alias("rows"), F.min("date").alias("start_date"), F.max("date").alias("end_date")]
    aggs.append(F.coalesce(F.sum("volume"), F.lit(0)).cast("long").alias("volume_sum"))
    if path in df.columns:
        aggs.append(F.min(path).alias("path"))
    return df.groupBy("contract").agg(*aggs).orderBy("start_date", "contract")


def write_result(df: DataFrame, path: str, by: tuple[str, ...] = ("dataset", "horizon"), form: str = "parquet") -> None:
    """A result table; what reports put in file names (dataset, horizon) become partition columns."""
    writer = df.write.mode("overwrite").partitionBy(*[c for c in by if c in df.columns])
    writer.option("header", True).format(form).save(path)


def write_document(df: DataFrame, path: str) -> None:
    """The single text column of df (a JSON document per row) as UTF-8 text files."""
    validate_columns(df, ["value"], exact=True).write.mode("overwrite").text(path)

"""Sinks for result tables, profile tables and model round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROFILE_SCHEMA = T.StructType(
    [T.StructField("investor_id", T.LongType()), T.StructField("age", T.IntegerType()), T.StructField("income", T.DoubleType())]
    + [T.StructField(c, T.IntegerType()) for c in ("horizon", "experience", "risk_score")]
)


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a result table, as Parquet or as CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_profiles(df: DataFrame, path: str) -> None:
    write_result(df.select(*PROFILE_SCHEMA.names), path, "csv")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE_SCHEMA).option("header", "true").csv(path)


def sectors(stocks: DataFrame) -> DataFrame:
    """``stocks(ticker, sector, position)`` -> per sector its tickers in position order."""
    listed = F.array_sort(F.collect_list(F.struct("position", "ticker")))
    return stocks.groupBy("sector").agg(listed.alias("rows")).select("sector", F.col("rows.ticker").alias("tickers"))


def lookup(asked: DataFrame, stocks: DataFrame, column: str = "ticker") -> DataFrame:
    """``asked`` with the stock of the same symbol whatever its case; ``found`` is false for unknown ones."""
    known = stocks.withColumn("__key", F.upper("ticker")).withColumnRenamed("ticker", "symbol")
    return asked.withColumn("__key", F.upper(column)).join(known, "__key", "left").drop("__key").withColumn("found", F.col("symbol").isNotNull())

"""Price snapshots: schema, scan, layout, normalisation, checks."""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adj_close")]
    + [T.StructField("volume", T.LongType())]
)
REQUIRED = ("ticker", "date", "open", "high", "low", "close", "volume")


def scan(spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None, tickers: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """All tickers of a snapshot in one scan; ``start`` is included, ``end`` is not. Filters reach the files."""
    reader = spark.read.schema(SCHEMA)
    df = reader.option("header", "true").csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("date") < F.lit(end))
    return df.where(F.col("ticker").isin(tickers)) if tickers else df


_KEYS = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("start", T.DateType()), T.StructField("end", T.DateType())])
MANIFEST = T.StructType([*_KEYS, T.StructField("n_rows", T.LongType()), T.StructField("version", T.StringType()), T.StructField("seq", T.LongType())])


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The commits of a store: folders that were written to their end, in any order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    made = [f.getPath().toString() for f in fs.listStatus(at) if f.isDirectory()]
    return [m for m in made if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{m}/_SUCCESS"))]


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The live periods of a store: one row (ticker, start, end, n_rows, version, seq) each, that of the latest commit that wrote it."""
    made = _folders(spark, path)
    rows = spark.read.schema(MANIFEST).parquet(*made) if made else spark.createDataFrame([], MANIFEST)
    last = F.max_by(F.struct("n_rows", "version", "seq"), F.struct("seq", "version"))
    return rows.groupBy("ticker", "start", "end").agg(last.alias("m")).select("ticker", "start", "end", "m.*")


def write(df: DataFrame, path: str, start: dt.date, end: dt.date, refresh: bool = False) -> int:
    """Store the rows of ``df`` from ``start`` up to, not including, ``end``: one snapshot a ticker, keyed by ticker and period.

    A snapshot of exactly that ticker and period that is already there stays, or is replaced with ``refresh``; other periods of the ticker, and other tickers,
    are not touched. A ticker without rows in the period is not stored. Returns the number of rows stored.

    Rows go to a folder of their own, and become visible when their entries are added to the manifest, in one more folder that is complete or not there. Nothing is ever overwritten, so of
    two writers neither loses rows; of two that store one snapshot, the later commit is read. A failed write leaves files that no one reads.
    """
    if not start < end:
        raise ValueError("start must lie before end")
    spark = df.sparkSession
    rows = df.select(*SCHEMA.names).where((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end)))
    if not refresh:
        there = stored(spark, path).where((F.col("start") == F.lit(start)) & (F.col("end") == F.lit(end))).select("ticker")
        rows = rows.join(there, "ticker", "left_anti")
    version = uuid.uuid4().hex
    made = f"{path}/data/version={version}"
    rows.write.partitionBy("ticker").parquet(made)
    try:
        got = spark.read.schema(SCHEMA).parquet(made)
    except AnalysisException:  # no row, no folder
        return 0
    entries = got.groupBy("ticker").agg(F.count("*").alias("n_rows")).select("ticker", F.lit(start).alias("start"), F.lit(end).alias("end"), "n_rows", F.lit(version).alias("version"), F.lit(time.time_ns()).alias("seq"))
    n = entries.agg(F.sum("n_rows")).first()[0]
    if n:
        entries.coalesce(1).write.parquet(f"{path}/manifest/{version}")
    return n or 0


def read(spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None, tickers: list[str] | None = None, exact: bool = False) -> DataFrame:
    """Rows of a store from ``start`` up to, not including, ``end``. Where stored periods overlap, a day is that of the latest commit that covers it; a day that it lacks is not filled from an older one.

    ``exact``: the snapshots of just this period. The manifest says which versions hold rows that are asked for, and only their folders are read, pruned by ticker.
    """
    live = stored(spark, path)
    if tickers:
        live = live.where(F.col("ticker").isin(tickers))
    if exact:
        live = live.where((F.col("start") == F.lit(start)) & (F.col("end") == F.lit(end)))
    else:
        live = live.where((F.col("end") > F.lit(start)) if start is not None else F.lit(True)).where((F.col("start") < F.lit(end)) if end is not None else F.lit(True))
    versions = sorted(r[0] for r in live.select("version").distinct().collect())  # a row a commit
    if not versions:
        return spark.createDataFrame([], SCHEMA)
    files = T.StructType([*SCHEMA, T.StructField("version", T.StringType())])
    rows = spark.read.schema(files).option("basePath", f"{path}/data").parquet(*[f"{path}/data/version={v}" for v in versions])
    for wanted in ((F.col("date") >= F.lit(start)) if start is not None else None, (F.col("date") < F.lit(end)) if end is not None else None, F.col("ticker").isin(tickers) if tickers else None):
        rows = rows if wanted is None else rows.where(wanted)
    rows = rows.join(live.select("ticker", "version", "start", "end", "seq"), ["ticker", "version"])
    other = live.select(F.col("ticker").alias("__t"), F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("seq").alias("__q"), F.col("version").alias("__v"))
    later = (F.col("ticker") == F.col("__t")) & F.col("date").between(F.col("__s"), F.date_sub("__e", 1)) & (F.struct("__q", "__v") > F.struct("seq", "version"))
    return rows.join(other, later, "left_anti").select(*SCHEMA.names)


def compact(spark: SparkSession, path: str) -> int:
    """Delete versions that no live snapshot reads; returns how many. Not to be run beside writers or readers of the same store."""
    live = {r[0] for r in stored(spark, path).select("version").distinct().collect()}
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().removeprefix("version=") not in live] if fs.exists(at) else []
    for folder in gone:
        fs.delete(folder, True)
    return len(gone)


def normalised(df: DataFrame) -> DataFrame:
    """Columns lower-cased, ``adj_close`` added where absent, ``close_price`` = adjusted close or else close, NaN as null."""
    df = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    if "adj_close" not in df.columns:
        df = df.withColumn("adj_close", F.col("close"))
    clean = [F.when(~F.isnan(c), F.col(c)) for c in ("adj_close", "close")]
    return df.withColumn("close_price", F.coalesce(*clean))


def require(df: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """``df`` projected to ``columns``; raises with all that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def drop_null_prices(df: DataFrame, columns: tuple[str, ...] = ("close", "volume")) -> DataFrame:
    """Rows with a value in all of ``columns``."""
    return df.na.drop(subset=list(columns))


def null_report(df: DataFrame, columns: tuple[str, ...] = ("close", "volume")) -> DataFrame:
    """Per ticker: rows before, after and dropped by :func:`drop_null_prices`."""
    kept = F.lit(True)
    for c in columns:
        kept = kept & F.col(c).isNotNull()
    return df.groupBy("ticker").agg(F.count("*").alias("rows_before"), F.count_if(kept).alias("rows_after")).withColumn("dropped", F.col("rows_before") - F.col("rows_after"))


def bars_from_lines(spark: SparkSession, sf_dir: str, factor: float = 0.001) -> DataFrame:
    """A price panel derived from order lines: one series a brand, a bar a ship date.

    The mean quantity of a day moves the close: 100 * exp(running sum of (mean - 25.5) * factor), the
    steps in whole millionths, so that a series that returns to a price returns to it exactly.
    """
    from pyspark.sql import Window

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_quantity", F.col("l_shipdate").cast("date").alias("date"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    day = lines.join(part, "l_partkey").groupBy("ticker", "date").agg(F.avg("l_quantity").alias("q"), F.sum("l_quantity").cast("bigint").alias("volume"))
    run = Window.partitionBy("ticker").orderBy("date")
    step = F.round((F.col("q") - 25.5) * (factor * 1e6)).cast("bigint")
    return day.select("ticker", "date", (100 * F.exp(F.sum(step).over(run) / 1e6)).alias("close"), "volume")

"""Daily bars from a stream of trades, for the price snapshot to append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(trades: DataFrame, late: str = "1 day") -> DataFrame:
    """``trades(ticker, ts, price, size)``, bounded or streaming -> bars (ticker, date, open, high, low, close, volume).

    On a stream a day's bar is final once the watermark, ``late`` behind the newest trade, has passed
    its end; only open days are kept as state. Trades without a ticker, time or price are left out;
    of several first or last trades at one time the lowest, or the highest, price counts.
    """
    good = trades.where("ticker is not null and ts is not null and price is not null")
    day = good.withWatermark("ts", late).groupBy("ticker", F.window("ts", "1 day").alias("day"))
    at = F.struct("ts", "price")
    bars = day.agg(F.min(at).alias("a"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(at).alias("b"), F.sum(F.coalesce("size", F.lit(0))).cast("bigint").alias("volume"))
    return bars.select("ticker", F.to_date("day.start").alias("date"), F.col("a.price").alias("open"), "high", "low", F.col("b.price").alias("close"), "volume")

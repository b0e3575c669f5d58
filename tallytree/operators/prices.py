"""Daily price series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F


def prices_since(prices: DataFrame, start: dt.date | str) -> DataFrame:
    """Prices from a day on; the range reaches the Parquet scan."""
    return prices.filter(F.col("date") >= F.lit(str(start)).cast("date"))


def candles(prices: DataFrame) -> DataFrame:
    """What a candlestick needs: day as text, then opening, closing, low, high."""
    return prices.select(
        "ticker", F.col("date").cast("string").alias("date"), "opening", "closing", "low", "high"
    )


def daily_bars(ticks: DataFrame, ticker: str, ts: str, price: str, seq: str) -> DataFrame:
    """Daily opening, high, low and closing price from single trades, in one partial aggregate."""
    return ticks.groupBy(F.col(ticker).alias("ticker"), F.to_date(ts).alias("date")).agg(
        F.min_by(price, seq).alias("opening"), F.max(price).alias("high"),
        F.min(price).alias("low"), F.max_by(price, seq).alias("closing"),
    )

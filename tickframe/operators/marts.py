"""Staging projection and gold facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions.columns import log_ratio, surrogate_key, ts_text
from tickframe.operators.series import BARS, Series, neighbours


def stg_klines(df: DataFrame) -> DataFrame:
    """Silver bars under their reporting names, with a row key."""
    return df.select(
        surrogate_key("symbol", "interval", ts_text("open_ts")).alias("kline_id"),
        "symbol", "interval", F.col("open_ts").alias("open_at"),
        "open", "high", "low", "close", "volume", F.col("close_ts").alias("close_at"),
        "quote_volume", "num_trades", "taker_buy_base_volume", "taker_buy_quote_volume",
    )


def ohlcv(staged: DataFrame, by: str = "day", interval: str = "1m") -> DataFrame:
    """Open, high, low, close and totals per symbol and day or hour.

    Every aggregate combines before the shuffle, so task size follows the number of periods and
    not the number of bars of a symbol.
    """
    if by == "day":
        period, key, text = "trade_date", "daily_kline_id", F.col("trade_date")
        bucket = F.to_date("open_at")
    elif by == "hour":
        period, key, text = "hour_at", "hourly_kline_id", ts_text("hour_at")
        bucket = F.date_trunc("hour", "open_at")
    else:
        raise ValueError(f"by must be 'day' or 'hour', not {by!r}")
    facts = (
        staged.filter(F.col("interval") == interval)
        .groupBy("symbol", bucket.alias(period))
        .agg(
            F.min_by("open", "open_at").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "open_at").alias("close"),
            F.sum("volume").alias("volume"),
            F.sum("quote_volume").alias("quote_volume"),
            F.sum("num_trades").alias("num_trades"),
        )
    )
    return facts.select(surrogate_key("symbol", text).alias(key), "*")


def log_returns(staged: DataFrame, series: Series | None = None) -> DataFrame:
    """ln(close / previous close) per symbol and interval; null on the first bar."""
    timed = staged.select("symbol", "interval", "open_at", "close",
                          F.unix_millis("open_at").alias("open_time"))
    near = neighbours(timed, "close", series or BARS, previous="_previous")
    return near.select(
        surrogate_key("symbol", "interval", ts_text("open_at")).alias("kline_return_id"),
        "symbol", "interval", "open_at", "close",
        log_ratio(F.col("close"), F.col("_previous")).alias("log_return"),
    )

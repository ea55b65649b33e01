"""VWAP, order flow and volatility of trades per tumbling window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.functions.columns import ms_to_ts
from tickframe.operators.silver import dedup_latest


def type_trades(df: DataFrame) -> DataFrame:
    """Text prices and quantities to double, event time to a timestamp."""
    return df.select(
        "symbol", "trade_id",
        F.col("price").try_cast("double").alias("price"),
        F.col("quantity").try_cast("double").alias("quantity"),
        ms_to_ts("trade_time").alias("trade_ts"),
        "is_buyer_maker",
    )


def trade_measures() -> list[Column]:
    p, q = F.col("price"), F.col("quantity")
    taker_buys = ~F.col("is_buyer_maker")
    return [
        F.try_divide(F.sum(p * q), F.sum(q)).alias("vwap"),
        F.sum(F.when(taker_buys, q).otherwise(-q)).alias("order_flow_imbalance"),
        F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("price_volatility"),
        F.count(F.lit(1)).alias("trade_count"),
    ]


def windowed_measures(typed: DataFrame, window: str) -> DataFrame:
    """The four measures per symbol and window; works on batch and stream frames."""
    return (
        typed.groupBy("symbol", F.window("trade_ts", window).alias("w"))
        .agg(*trade_measures())
        .select(
            "symbol", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            "vwap", "order_flow_imbalance", "price_volatility", "trade_count",
        )
    )


def microstructure(trades: DataFrame, window: str = "1 minute",
                   watermark: str = "10 seconds") -> DataFrame:
    """Typed trades to window rows; a trade id counts once per symbol.

    On a stream late trades are dropped behind the watermark and repeated ids are found within
    it; on a batch the earliest copy of an id is kept.
    """
    if trades.isStreaming:
        once = (trades.withWatermark("trade_ts", watermark)
                .dropDuplicatesWithinWatermark(["symbol", "trade_id"]))
    else:
        age = -F.unix_micros("trade_ts")
        once = dedup_latest(trades, ["symbol", "trade_id"], [age])
    return windowed_measures(once, window)

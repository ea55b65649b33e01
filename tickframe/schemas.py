"""Row layouts of the tables and messages (fixed names and types)."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(18, 8)

BRONZE_KLINE = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("interval", T.StringType()),
    T.StructField("open_time", T.LongType()),
    T.StructField("open", T.StringType()),
    T.StructField("high", T.StringType()),
    T.StructField("low", T.StringType()),
    T.StructField("close", T.StringType()),
    T.StructField("volume", T.StringType()),
    T.StructField("close_time", T.LongType()),
    T.StructField("quote_volume", T.StringType()),
    T.StructField("num_trades", T.LongType()),
    T.StructField("taker_buy_base_volume", T.StringType()),
    T.StructField("taker_buy_quote_volume", T.StringType()),
])

KLINE_COLUMNS = BRONZE_KLINE.names

DECIMAL_COLUMNS = [
    "open", "high", "low", "close", "volume",
    "quote_volume", "taker_buy_base_volume", "taker_buy_quote_volume",
]

SILVER_KLINE = T.StructType(
    [T.StructField(f.name, PRICE if f.name in DECIMAL_COLUMNS else f.dataType) for f in BRONZE_KLINE]
    + [
        T.StructField("open_ts", T.TimestampType()),
        T.StructField("close_ts", T.TimestampType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
    ]
)

TRADE = T.StructType([
    T.StructField("event_type", T.StringType()),
    T.StructField("event_time", T.LongType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("trade_id", T.LongType()),
    T.StructField("price", T.StringType()),
    T.StructField("quantity", T.StringType()),
    T.StructField("buyer_order_id", T.LongType()),
    T.StructField("seller_order_id", T.LongType()),
    T.StructField("trade_time", T.LongType()),
    T.StructField("is_buyer_maker", T.BooleanType()),
])

KLINE_BODY = T.StructType([
    T.StructField("open_time", T.LongType()),
    T.StructField("close_time", T.LongType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("interval", T.StringType()),
    T.StructField("open", T.StringType()),
    T.StructField("close", T.StringType()),
    T.StructField("high", T.StringType()),
    T.StructField("low", T.StringType()),
    T.StructField("volume", T.StringType()),
    T.StructField("number_of_trades", T.LongType()),
    T.StructField("is_closed", T.BooleanType()),
    T.StructField("quote_volume", T.StringType()),
])

KLINE_EVENT = T.StructType([
    T.StructField("event_type", T.StringType()),
    T.StructField("event_time", T.LongType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("kline", KLINE_BODY),
])

# Single-letter message keys and the names they stand for.
TRADE_KEYS = {
    "e": "event_type", "E": "event_time", "s": "symbol", "t": "trade_id", "p": "price",
    "q": "quantity", "b": "buyer_order_id", "a": "seller_order_id", "T": "trade_time",
    "m": "is_buyer_maker",
}
KLINE_KEYS = {
    "t": "open_time", "T": "close_time", "s": "symbol", "i": "interval", "o": "open",
    "c": "close", "h": "high", "l": "low", "v": "volume", "n": "number_of_trades",
    "x": "is_closed", "q": "quote_volume",
}

# Fields a message may leave out.
TRADE_OPTIONAL = {"buyer_order_id", "seller_order_id"}

# Milliseconds per bar of every interval name ("1M" is the longest month).
INTERVAL_MS = {
    "1s": 1_000, "1m": 60_000, "3m": 180_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000,
    "1h": 3_600_000, "2h": 7_200_000, "4h": 14_400_000, "6h": 21_600_000, "8h": 28_800_000,
    "12h": 43_200_000, "1d": 86_400_000, "3d": 259_200_000, "1w": 604_800_000,
    "1M": 2_678_400_000,
}

FEATURE_COLUMNS = [
    "close_float", "volume", "sma_20", "sma_50", "vol_20", "rsi_14",
    "macd", "macd_signal", "bb_upper", "bb_lower", "returns_1",
]

FEATURE_ROW = T.StructType(
    [T.StructField("open_time", T.LongType()), T.StructField("symbol", T.StringType()),
     T.StructField("interval", T.StringType())]
    + [T.StructField(c, PRICE if c == "volume" else T.DoubleType()) for c in FEATURE_COLUMNS]
    + [T.StructField("target_direction", T.LongType())]
)

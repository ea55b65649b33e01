"""Readers of streams and lake tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickframe.operators.silver import BAR_KEYS, conform, dedup_latest
from tickframe.schemas import (
    BRONZE_KLINE, FEATURE_COLUMNS, FEATURE_ROW, KLINE_BODY, KLINE_COLUMNS, KLINE_EVENT, SILVER_KLINE,
)


def read_stream(
    spark: SparkSession, fmt: str, options: dict[str, str], schema: StructType | None = None
) -> DataFrame:
    """A stream of any format; from a message broker only ``value`` (as text) is kept.

    For the broker pass its servers and ``subscribePattern``; new messages only is the default.
    """
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        raw = reader.options(**{"startingOffsets": "latest", **options}).load()
        return raw.select(F.col("value").cast("string").alias("value"))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load()


def read_or_empty(spark: SparkSession, path: str, layout: StructType) -> DataFrame:
    """A Parquet table, without rows if the path is missing: only for a table that a first load creates.

    Other readers raise, so that a mistyped path never looks like a table without rows. The fixed layout also keeps folder keys such as a symbol "123" text.
    """
    try:
        return spark.read.schema(layout).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], layout)


def read_bronze_klines(spark: SparkSession, path: str) -> DataFrame:
    """Bronze bars with the fixed schema; folder keys other than symbol and interval are left out."""
    return spark.read.schema(BRONZE_KLINE).parquet(path).select(*KLINE_COLUMNS)


def read_mixed_klines(spark: SparkSession, path: str) -> DataFrame:
    """Bronze bars of one prefix that holds history files (flat) and landed live events (nested), in one scan.

    The layout is that of both: a file lacks the columns of the other kind, so a row with a ``kline`` is an event. Its values
    are taken from there, and it counts if its bar is closed; live events know no taker volumes.
    """
    layout = StructType([*BRONZE_KLINE.fields, *[f for f in KLINE_EVENT.fields if f.name not in BRONZE_KLINE.names]])
    rows = spark.read.schema(layout).parquet(path)
    live = F.col("kline").isNotNull()
    names = {**{f.name: f.name for f in KLINE_BODY}, "num_trades": "number_of_trades"}
    both = [
        F.when(live, F.col(f"kline.{names[c]}") if c in names else F.lit(None)).otherwise(F.col(c)).alias(c)
        for c in KLINE_COLUMNS if c not in ("symbol", "interval")
    ]
    return rows.filter(~live | F.col("kline.is_closed")).select("symbol", "interval", *both)


def read_silver_klines(
    spark: SparkSession, path: str, columns: Iterable[str] = tuple(KLINE_COLUMNS)
) -> DataFrame:
    """Silver bars, by default without partition helpers."""
    return spark.read.schema(SILVER_KLINE).parquet(path).select(*columns)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Model features, every feature column as double."""
    rows = spark.read.schema(FEATURE_ROW).parquet(path).select(*FEATURE_ROW.names)
    return rows.withColumns({c: F.col(c).cast("double") for c in FEATURE_COLUMNS})


def read_as(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table cast to a target layout."""
    return conform(spark.read.parquet(path), schema)


def scan_latest(df: DataFrame, keys: Iterable[str] = BAR_KEYS,
                version: str = "_loaded_at") -> DataFrame:
    """The newest version of every key of a versioned table."""
    return dedup_latest(df, keys, [version])

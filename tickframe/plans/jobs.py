"""The batch jobs, from lake path to lake path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.operators.events import live_bronze
from tickframe.operators.indicators import build_features
from tickframe.operators.marts import log_returns, ohlcv, stg_klines
from tickframe.operators.silver import finish_silver, tag_typed, union_bronze, with_times
from tickframe.plans.metrics import export_views
from tickframe.schemas import KLINE_COLUMNS, KLINE_EVENT, SILVER_KLINE
from tickframe.session import fresh_path
from tickframe.sources.files import remove
from tickframe.sources.lake import (
    read_bronze_klines, read_mixed_klines, read_or_empty, read_silver_klines, scan_latest,
)
from tickframe.sources.sinks import materialize, upsert_table, write_features, write_rejects, write_silver


def run_silver(spark: SparkSession, bronze: str, silver: str, rejects: str, live: str | None = None,
               mixed: bool = False) -> dict[str, int]:
    """Clean bronze into silver and rejects and return the row counts.

    ``live`` names landed bar events (nested, as the bronze stream writes them); their closed bars join the
    flat history bars of ``bronze`` before validation and dedup. With ``mixed``, ``bronze`` itself holds files of both kinds.

    Bronze is scanned and typed once, into a staged table of valid and rejected rows. All counts are row counts of written files,
    taken from their footers: metrics observed during a write count a task again when it is retried.
    """
    raw = read_mixed_klines(spark, bronze) if mixed else read_bronze_klines(spark, bronze)
    if live:
        raw = union_bronze(live_bronze(spark.read.schema(KLINE_EVENT).parquet(live)), raw)
    path = fresh_path(spark, "typed")
    typed = tag_typed(raw).withColumn("valid", F.col("reject_reason").isNull())
    typed.write.partitionBy("valid").parquet(path)
    stored = spark.read.schema(typed.schema).parquet(path)
    valid, rejected = stored.filter("valid").select(*KLINE_COLUMNS), stored.filter("NOT valid").drop("valid")
    counts = {"raw": stored.count(), "rejected": rejected.count()}
    write_silver(finish_silver(valid), silver)
    write_rejects(with_times(rejected), rejects, counts["rejected"])
    counts["kept"] = kept_rows(spark, valid, silver) if counts["raw"] > counts["rejected"] else 0
    counts["duplicates"] = counts["raw"] - counts["rejected"] - counts["kept"]
    remove(spark, path)
    return counts


def kept_rows(spark: SparkSession, valid: DataFrame, silver: str) -> int:
    """Rows of the silver folders that ``valid`` bars belong to, which a write has replaced. Only footers are read."""
    at = F.timestamp_millis("open_time")
    folders = valid.select("symbol", "interval", F.year(at).alias("year"), F.month(at).alias("month")).distinct()
    stored = spark.read.schema(SILVER_KLINE).parquet(silver)
    return stored.join(folders, ["symbol", "interval", "year", "month"], "left_semi").count()


def load_raw(spark: SparkSession, silver: str, table: str) -> None:
    """Load silver bars into the versioned serving table; loading again changes nothing.

    A silver path that is not there yet loads nothing.
    """
    bars = read_or_empty(spark, silver, SILVER_KLINE).select(*[
        "symbol", "interval", "open_time", "open", "high", "low", "close", "volume", "close_time",
        "quote_volume", "num_trades", "taker_buy_base_volume", "taker_buy_quote_volume",
        "open_ts", "close_ts", "year", "month",
    ])
    if bars.isEmpty():
        return
    upsert_table(spark, bars.withColumn("_loaded_at", F.current_timestamp()), table,
                 ["symbol", "year", "month"])


def gold_facts(raw: DataFrame) -> dict[str, DataFrame]:
    """The three fact tables of a (possibly versioned) silver table."""
    latest = scan_latest(raw) if "_loaded_at" in raw.columns else raw
    staged = stg_klines(latest)
    return {
        "fct_daily_klines": ohlcv(staged, "day"),
        "fct_hourly_klines": ohlcv(staged, "hour"),
        "fct_kline_returns": log_returns(staged),
    }


def build_gold(raw: DataFrame) -> dict[str, DataFrame]:
    """Write the fact tables to the gold schema and return them as stored."""
    out = {}
    order = {
        "fct_daily_klines": ["symbol", "trade_date"],
        "fct_hourly_klines": ["symbol", "hour_at"],
        "fct_kline_returns": ["symbol", "interval", "open_at"],
    }
    for name, facts in gold_facts(raw).items():
        materialize(facts, name, "table", "gold", order[name])
        out[name] = raw.sparkSession.table(f"gold.{name}")
    return out


def run_features(spark: SparkSession, silver: str, gold: str) -> None:
    write_features(build_features(read_silver_klines(spark, silver)), gold)


def run_export(facts: dict[str, DataFrame], folder: str) -> list[str]:
    return export_views(facts, folder)

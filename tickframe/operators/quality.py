"""Data-quality rules, counted instead of raised."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.schemas import KLINE_COLUMNS


@dataclass(frozen=True)
class Rules:
    """Columns that must not be null, keys that must be unique, SQL conditions that must hold."""

    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    holds: dict[str, str] = field(default_factory=dict)
    null_passes: bool = True


def check(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows (rule, column, failures); zero failures means the rule is met. A key fails once however often it repeats.

    All rules are counted in one pass and one shuffle. A row gives one entry for the null and condition rules, whose
    counts are combined before the shuffle, and one for each of its unique keys. After the grouping an entry of a key that
    has come more than once is a failure.
    """
    names = [("not_null", c) for c in rules.not_null] + [("holds", label) for label in rules.holds]
    broken = [F.col(c).isNull() for c in rules.not_null] + [
        ~F.coalesce(F.expr(condition), F.lit(rules.null_passes)) for condition in rules.holds.values()]
    flags = [f"_b{i}" for i in range(len(names))]
    nothing = F.lit(None).cast("string")
    entries = [F.struct(F.lit(-1).alias("_slot"), nothing.alias("_key"), *[c.cast("int").alias(f) for c, f in zip(broken, flags)])]
    for i, c in enumerate(rules.unique):
        entry = F.struct(F.lit(i).alias("_slot"), F.col(c).cast("string").alias("_key"), *[F.lit(0).alias(f) for f in flags])
        entries.append(F.when(F.col(c).isNotNull(), entry))
    grouped = df.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull()))).groupBy("_slot", "_key").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f).alias(f) for f in flags])
    counts = [F.coalesce(F.sum(F.when(F.col("_slot") == -1, F.col(f))), F.lit(0)) for f in flags]
    counts += [F.count_if((F.col("_slot") == i) & (F.col("_n") > 1)) for i in range(len(rules.unique))]
    names += [("unique", c) for c in rules.unique]
    one = grouped.agg(*[n.alias(f"_c{i}") for i, n in enumerate(counts)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column"), F.col(f"_c{i}").alias("failures"))
        for i, (rule, c) in enumerate(names)])))


_OHLC = {"high >= low": "high >= low", "volume >= 0": "volume >= 0", "num_trades >= 0": "num_trades >= 0"}
_TOTALS = ("symbol", "open", "high", "low", "close", "volume")

SOURCE_RULES = Rules(tuple(KLINE_COLUMNS))
DAILY_RULES = Rules(("daily_kline_id", "trade_date", *_TOTALS), ("daily_kline_id",), _OHLC)
HOURLY_RULES = Rules(("hourly_kline_id", "hour_at", *_TOTALS), ("hourly_kline_id",), _OHLC)
RETURNS_RULES = Rules(("kline_return_id", "symbol", "interval", "open_at", "close"), ("kline_return_id",))
STAGING_RULES = Rules(("kline_id", "symbol", "interval", "open_at", "open", "high", "low", "close",
                       "volume", "close_at"), ("kline_id",))

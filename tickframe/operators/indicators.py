"""Row-frame indicators, written as native windows over series blocks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.functions.columns import log_step
from tickframe.operators.series import (
    BARS, BLOCK_ROWS, Series, blocks, fill_gaps, framed, neighbours, own_rows, plain,
)
from tickframe.operators.recurrences import momentum
from tickframe.schemas import FEATURE_ROW


def _last(series: Series, n: int):
    return series.block_window().rowsBetween(-(n - 1), 0)


def sma_expr(x: Column, n: int, series: Series = BARS) -> Column:
    return F.avg(x).over(_last(series, n))


def std_expr(x: Column, n: int, series: Series = BARS) -> Column:
    """Sample deviation of the last ``n`` rows; null where there is only one."""
    return F.stddev_samp(x).over(_last(series, n))


def bands(mean: Column, std: Column, count: Column, k: float, ddof: int) -> tuple[Column, Column]:
    """Mean plus and minus ``k`` deviations, from the sample deviation of ``count`` rows."""
    std = F.coalesce(std, F.lit(0.0))
    width = k * (std if ddof else std * F.sqrt((count - 1) / count))
    return mean + width, mean - width


def sma(df: DataFrame, n: int, value: str = "close", out: str | None = None,
        series: Series = BARS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean of the last ``n`` rows; fewer at the start of a series."""
    return framed(df, {out or f"sma_{n}": sma_expr(x_double(value), n, series)}, series,
                  before=n - 1, block_rows=block_rows)


def rolling_std(df: DataFrame, n: int = 20, value: str = "close", out: str | None = None,
                series: Series = BARS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    name = out or f"vol_{n}"
    wide = framed(df, {name: std_expr(x_double(value), n, series)}, series, before=n - 1, block_rows=block_rows)
    return wide.fillna({name: 0.0})


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, ddof: int = 0, value: str = "close",
              series: Series = BARS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``bb_upper`` and ``bb_lower``: mean plus and minus ``k`` deviations of the last ``n`` rows."""
    x = x_double(value)
    out = framed(df, {
        "_mean": sma_expr(x, n, series), "_std": std_expr(x, n, series),
        "_count": F.count(x).over(_last(series, n)),
    }, series, before=n - 1, block_rows=block_rows)
    upper, lower = bands(F.col("_mean"), F.col("_std"), F.col("_count"), k, ddof)
    return out.withColumns({"bb_upper": upper, "bb_lower": lower}).drop("_mean", "_std", "_count")


def returns_1(df: DataFrame, value: str = "close", out: str = "returns_1",
              series: Series = BARS) -> DataFrame:
    """Log return against the previous row; 0 on the first."""
    near = neighbours(df, value, series, previous="_previous")
    return near.withColumn(out, log_step(F.col(value), F.col("_previous"))).drop("_previous")


def direction_expr(value: Column, later: Column) -> Column:
    return F.coalesce((later > value).cast("long"), F.lit(0).cast("long"))


def target_direction(df: DataFrame, horizon: int = 1, value: str = "close",
                     out: str = "target_direction", series: Series = BARS,
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """1 where the value ``horizon`` rows later is higher, else 0, also where there is none."""
    if horizon == 1:
        near = neighbours(df, value, series, following="_following")
        return near.withColumn(out, direction_expr(F.col(value), F.col("_following"))).drop("_following")
    later = F.lead(value, horizon).over(series.block_window())
    return framed(df, {out: direction_expr(F.col(value), later)}, series,
                  after=horizon, block_rows=block_rows)


def bfill_ffill(df: DataFrame, columns: Iterable[str], series: Series = BARS) -> DataFrame:
    """Back-fill, then forward-fill. Back-filling uses later values: not for training inputs."""
    return fill_gaps(df, columns, series)


def fill_defaults(df: DataFrame) -> DataFrame:
    """Neutral values for indicator rows that are still null."""
    zero = {c: 0.0 for c in ("vol_20", "returns_1", "macd", "macd_signal") if c in df.columns}
    out = df.fillna({**zero, **({"rsi_14": 50.0} if "rsi_14" in df.columns else {})})
    for band in ("bb_upper", "bb_lower"):
        if band in out.columns:
            out = out.withColumn(band, F.coalesce(band, "close_float"))
    return out


def build_features(df: DataFrame, series: Series = BARS, ddof: int = 0,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All model features of silver bars in one plan.

    One shuffle numbers the rows and one builds the blocks; every window and both
    recurrence passes then use the block partitioning.
    """
    if block_rows <= 14:
        raise ValueError("a block must be longer than the RSI period")
    w = series.block_window()
    x = F.col("close_float")
    slim = df.select(*series.keys, "open_time", x_double("close").alias("close_float"), "volume")
    cut = blocks(slim, series, before=49, after=1, block_rows=block_rows)
    placed = F.col("_pos").isNotNull()
    windowed = cut.withColumns({n: F.when(placed, c) for n, c in {
        "sma_20": sma_expr(x, 20, series),
        "sma_50": sma_expr(x, 50, series),
        "vol_20": std_expr(x, 20, series),
        "_count": F.count(x).over(_last(series, 20)),
        "_prev": F.lag(x).over(w),
        "_next": F.lead(x).over(w),
    }.items()})
    upper, lower = bands(F.col("sma_20"), F.col("vol_20"), F.col("_count"), 2.0, ddof)
    own = own_rows(windowed, block_rows).withColumns({
        "bb_upper": upper,
        "bb_lower": lower,
        "returns_1": log_step(x, F.col("_prev")),
        "target_direction": direction_expr(x, F.col("_next")),
    }).drop("_count", "_next")
    scanned = momentum(own, "close_float", cut.columns, series)
    return fill_defaults(plain(scanned)).select(*FEATURE_ROW.names)


def x_double(name: str) -> Column:
    return F.col(name).cast("double")

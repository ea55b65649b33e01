"""REST history pages: planning them and turning their text into bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.functions.columns import day_start_ms, interval_ms, parsed_once
from tickframe.schemas import BRONZE_KLINE, DECIMAL_COLUMNS, INTERVAL_MS

# Fixed order of the values in one page row.
PAGE_POSITIONS = [
    "open_time", "open", "high", "low", "close", "volume", "close_time",
    "quote_volume", "num_trades", "taker_buy_base_volume", "taker_buy_quote_volume",
]


def _parsed(pages: DataFrame) -> DataFrame:
    """Pages with their ``cells``, parsed once; null for a payload that is no array of arrays."""
    parsed = F.struct(F.from_json("payload", "array<array<string>>").alias("cells"))
    return pages.select("symbol", "interval", "payload", parsed_once(parsed))


def page_rejects(pages: DataFrame) -> DataFrame:
    """Pages that cannot be read at all (no JSON, cut short, an error object), with their payload."""
    return _parsed(pages).filter(F.col("cells").isNull()).select(
        "symbol", "interval", "payload",
        F.when(F.col("payload").isNull(), F.lit("no payload")).otherwise(F.lit("unreadable payload")).alias("reject_reason"))


def page_rows(pages: DataFrame) -> DataFrame:
    """One row per bar of every page, with ``is_bar`` false for malformed ones.

    A page that cannot be read is one malformed row with a null ``page_pos``; see ``page_rejects``.
    """
    # Outer, so that an unreadable page keeps a row; an empty page is dropped after.
    rows = _parsed(pages).select(
        "symbol", "interval", F.col("cells").isNull().alias("unreadable"), F.posexplode_outer("cells").alias("page_pos", "cell"))
    rows = rows.filter(F.col("page_pos").isNotNull() | F.col("unreadable")).drop("unreadable")
    count = F.coalesce(F.size("cell"), F.lit(0))

    def at(i: int) -> Column:
        return F.get("cell", F.lit(i))

    values = {}
    for i, name in enumerate(PAGE_POSITIONS):
        kind = BRONZE_KLINE[name].dataType
        # Prices stay text, kept only where they read as a number.
        number = at(i).try_cast("double").isNotNull()
        values[name] = F.when(number, at(i)) if name in DECIMAL_COLUMNS else at(i).try_cast(kind)
    whole = count >= len(PAGE_POSITIONS)
    typed = rows.withColumns(values)
    for name in PAGE_POSITIONS:
        whole = whole & F.col(name).isNotNull()
    return typed.withColumn("is_bar", whole)


def parse_kline_pages(pages: DataFrame) -> DataFrame:
    """Bars of (symbol, interval, payload) rows in the bronze layout, malformed ones dropped."""
    return page_rows(pages).filter("is_bar").select(*BRONZE_KLINE.names)


def page_metrics(pages: DataFrame) -> DataFrame:
    """Bars and malformed rows per symbol and interval; an unreadable page counts as one malformed row."""
    return page_rows(pages).groupBy("symbol", "interval").agg(
        F.count_if("is_bar").alias("bars"), F.count_if(~F.col("is_bar")).alias("malformed"))


def backfill_plan(ranges: DataFrame, intervals: list[str], page_bars: int = 1000) -> DataFrame:
    """Pages of at most ``page_bars`` bars that cover [start, end] of every (symbol, interval).

    ``ranges`` has symbol, start_date and end_date; a null end is today. The end day is included.
    Unknown intervals and null starts are errors; a range that ends before it starts has no pages.
    """
    if unknown := sorted(set(intervals) - set(INTERVAL_MS)):
        raise ValueError(f"unknown intervals: {', '.join(unknown)}")
    last = F.coalesce(F.col("end_date").cast("date"), F.current_date())
    spans = (
        ranges.withColumn("interval", F.explode(F.array(*[F.lit(i) for i in intervals])))
        .withColumns({
            "start_ms": F.coalesce(day_start_ms("start_date"), F.raise_error(
                F.concat(F.lit("no start_date for "), F.coalesce("symbol", F.lit("a null symbol")))).cast("long")),
            "end_ms": day_start_ms(F.date_add(last, 1)),
            "step_ms": interval_ms() * page_bars,
        })
        .filter("start_ms < end_ms")
    )
    starts = F.sequence(F.col("start_ms"), F.col("end_ms") - 1, F.col("step_ms"))
    return spans.select(
        "symbol", "interval", "end_ms", "step_ms", F.posexplode(starts).alias("page", "page_start"),
    ).select(
        "symbol", "interval", F.col("page").cast("long").alias("page"), "page_start",
        F.least(F.col("page_start") + F.col("step_ms"), F.col("end_ms")).alias("page_end"),
    )

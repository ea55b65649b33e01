"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickframe.schemas import INTERVAL_MS, PRICE

# Fixed value: what a null key part is written as before hashing.
NULL_KEY_PART = "_dbt_utils_surrogate_key_null_"


def col_of(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def surrogate_key(*parts: str | Column) -> Column:
    """md5 over the parts as text, joined by '-'; format timestamps before passing them."""
    texts = [F.coalesce(col_of(p).cast("string"), F.lit(NULL_KEY_PART)) for p in parts]
    return F.md5(F.concat_ws("-", *texts))


def ts_text(ts: str | Column) -> Column:
    """Timestamp as text with all three millisecond digits kept."""
    return F.date_format(col_of(ts), "yyyy-MM-dd HH:mm:ss.SSS")


def ms_to_ts(ms: str | Column) -> Column:
    return F.timestamp_millis(col_of(ms))


def price(text: str | Column) -> Column:
    """Text to decimal(18,8); null where it is no number or too large."""
    return col_of(text).try_cast(PRICE)


def interval_ms(interval: str | Column = "interval") -> Column:
    """Length of a bar in milliseconds; null for an unknown interval name."""
    name = col_of(interval)
    expr = F.lit(None).cast("long")
    for text, ms in INTERVAL_MS.items():
        expr = F.when(name == text, F.lit(ms).cast("long")).otherwise(expr)
    return expr


def log_ratio(value: Column, base: Column) -> Column:
    """ln(value / base) in double, as IEEE arithmetic has it: -inf for a zero value, NaN for a
    negative ratio. Null when either is null or the base is zero."""
    ratio = F.try_divide(value.cast("double"), base.cast("double"))
    return (F.when(ratio > 0, F.ln(ratio))
            .when(ratio == 0, F.lit(float("-inf")))
            .when(ratio < 0, F.lit(float("nan"))))


def log_step(value: Column, base: Column) -> Column:
    """Log return as a feature: 0 where it is undefined or infinite (no base, or a price that is not positive)."""
    return F.when((base > 0) & (value > 0), log_ratio(value, base)).otherwise(0.0)


def argmax(scores: str | Column) -> Column:
    """0-based index of the first largest element."""
    arr = col_of(scores)
    return F.array_position(arr, F.array_max(arr)) - 1


def path_part(number: str | Column, width: int = 2) -> Column:
    """Zero-padded number for a partition folder name."""
    return F.lpad(col_of(number).cast("string"), width, "0")


def day_start_ms(day: str | Column) -> Column:
    """Epoch milliseconds of 00:00 UTC of a date."""
    return F.unix_millis(col_of(day).cast("date").cast("timestamp"))


def parsed_once(struct: Column) -> Column:
    """Expand a costly struct (parsed text) to columns so that it is computed once per row.

    As plain projections, filters on its fields would be pushed below and parse the text again
    for every field they name; nothing moves below a generator of its own outputs.
    """
    return F.inline_outer(F.array(struct))

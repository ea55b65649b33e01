"""Raw messages to typed trade and bar events, with the malformed ones set aside."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.functions.columns import parsed_once
from tickframe.operators.silver import cast_prices
from tickframe.schemas import (
    KLINE_BODY, KLINE_COLUMNS, KLINE_EVENT, KLINE_KEYS, TRADE, TRADE_KEYS, TRADE_OPTIONAL,
)


class Routed(NamedTuple):
    trades: DataFrame
    klines: DataFrame
    dlq: DataFrame


def unwrap_envelope(df: DataFrame, value: str = "value") -> DataFrame:
    """The ``data`` of a combined-stream message, or the message itself."""
    return df.withColumn(value, F.coalesce(F.get_json_object(value, "$.data"), F.col(value)))


def parse_json(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Message text expanded to the columns of ``schema``; fields that do not fit are null."""
    return df.select(parsed_once(F.from_json(F.col(value).cast("string"), schema)))


def _values(names) -> list[T.StructField]:
    """Fields that keep the kind of their JSON value."""
    return [T.StructField(n, T.VariantType()) for n in names]


def _wire_layout() -> tuple[T.StructType, T.StructType]:
    """All fields of both events in both spellings, and the same under unique names.

    Short names differ in case only (t and T), so the parsed struct is renamed by position before
    any field is used: s_<name> holds the short spelling, l_<name> the long one.
    """
    body = T.StructType(_values(KLINE_KEYS) + _values(KLINE_KEYS.values()))
    wire = _values(TRADE_KEYS) + _values(TRADE_KEYS.values())
    wire += [T.StructField("k", body), T.StructField("kline", body)]

    def both(keys) -> list[T.StructField]:
        return _values(f"s_{n}" for n in keys.values()) + _values(f"l_{n}" for n in keys.values())

    unique = both(TRADE_KEYS)
    for end in ("s", "l"):
        unique.append(T.StructField(f"{end}_kline", T.StructType(both(KLINE_KEYS))))
    return T.StructType(wire), T.StructType(unique)


def parse_wire(df: DataFrame, value: str = "value") -> DataFrame:
    """Add ``trade`` and ``bar`` structs read from message text with one JSON parse per row.

    "5" and 5 are both a valid number, but a text field must be text; what does not fit is null.
    """
    wire, unique = _wire_layout()
    head = KLINE_EVENT.names[:3]

    def pick(row: Column, layout: T.StructType, short: str | None = None, long: str | None = None) -> list[Column]:
        bodies = [row[b] for b in (short, long) if b] or [row]
        return [_strict(F.coalesce(*[b[f"{end}_{f.name}"] for b in bodies for end in ("s", "l")]), f.dataType).alias(f.name) for f in layout]

    def events(row: Column) -> Column:
        nothing = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in KLINE_BODY])
        body = F.when(row["s_kline"].isNotNull() | row["l_kline"].isNotNull(),
                      F.struct(*pick(row, KLINE_BODY, "s_kline", "l_kline"))).otherwise(nothing)
        return F.struct(F.struct(*pick(row, TRADE)).alias("trade"), body.alias("_kline"))

    # The fields are checked beside the parse: as a projection of their own, the checks and the conditions on them make one method
    # that is too long for the JVM to compile, and each condition checks its fields again. Both events have the same head.
    parsed = F.from_json(F.col(value).cast("string"), wire).cast(unique)
    checked = df.select("*", F.inline_outer(F.transform(F.array(parsed), events)))
    return checked.withColumn("bar", F.struct(*[F.col(f"trade.{n}") for n in head], F.col("_kline").alias("kline"))).drop("_kline")


def _strict(field: Column, kind: T.DataType) -> Column:
    """A parsed field as its type; null if it does not fit, or if a text field holds anything but text."""
    text = F.try_variant_get(field, "$", "string")
    if isinstance(kind, T.StringType):
        return F.when(F.schema_of_variant(field) == "STRING", text)
    return text.try_cast(kind)


def _complete(event: str, layout: T.StructType, optional: set[str] = frozenset()) -> Column:
    ok = F.lit(True)
    for f in layout:
        if f.name not in optional:
            ok = ok & F.col(f"{event}.{f.name}").isNotNull()
    return ok


def normalise_trades(df: DataFrame, value: str = "value") -> DataFrame:
    """Trade messages of either spelling as trade rows."""
    return parse_wire(df, value).select("trade.*")


def normalise_klines(df: DataFrame, value: str = "value") -> DataFrame:
    """Bar messages of either spelling as nested bar rows."""
    return parse_wire(df, value).select("bar.*")


def validate(df: DataFrame, schema: T.StructType, optional: set[str] = frozenset(),
             value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Messages with every required field of its type, and the raw others.

    A text field must be text in the message; a number field may be a number or its text.
    """
    raw, neutral = T.StructType(_values(schema.names)), T.StructType(_values(f"t_{n}" for n in schema.names))
    parsed = df.select("*", parsed_once(F.from_json(F.col(value).cast("string"), raw).cast(neutral)))
    event = F.struct(*[_strict(F.col(f"t_{f.name}"), f.dataType).alias(f.name) for f in schema])
    tagged = parsed.withColumn("event", event).drop(*neutral.names)
    good = _complete("event", schema, optional)
    return tagged.filter(good).select("event.*"), tagged.filter(~good).drop("event")


def tag_events(df: DataFrame, value: str = "value") -> DataFrame:
    """Parse each message once: ``kind``, ``trade``, ``bar`` and ``is_valid``.

    Messages that are no JSON object or of another type are dropped.
    """
    parsed = parse_wire(df, value).withColumn("kind", F.col("trade.event_type"))
    head = T.StructType(KLINE_EVENT.fields[:3])
    ok_bar = _complete("bar", head) & _complete("bar.kline", KLINE_BODY)
    ok = F.when(F.col("kind") == "trade", _complete("trade", TRADE, TRADE_OPTIONAL)).otherwise(ok_bar)
    return parsed.filter(F.col("kind").isin("trade", "kline")).withColumn("is_valid", ok)


def split_tagged(tagged: DataFrame, value: str = "value") -> Routed:
    valid = F.col("is_valid")
    dead = F.lit("unknown").alias("key")
    return Routed(
        tagged.filter(valid & (F.col("kind") == "trade")).select("trade.*"),
        tagged.filter(valid & (F.col("kind") == "kline")).select("bar.*"),
        tagged.filter(~valid).select("kind", dead, F.col(value).alias("value")),
    )


def route_events(df: DataFrame, value: str = "value") -> Routed:
    """Valid trades, valid bars, and a dead-letter frame of the malformed ones."""
    return split_tagged(tag_events(unwrap_envelope(df, value), value), value)


def stored_routes(df: DataFrame, path: str, value: str = "value") -> Routed:
    """``route_events`` below ``path``: messages are scanned and parsed once, for all three frames."""
    tagged = tag_events(unwrap_envelope(df, value), value)
    routes = split_tagged(tagged, value)
    good, kind = F.col("is_valid"), F.col("kind")
    dead = [F.when(~good, c).alias(n) for n, c in (("dead_kind", kind), ("dead_value", F.col(value)))]
    kept = tagged.select(
        F.when(~good, "dlq").otherwise(kind).alias("output"), F.when(good, F.col("trade")).alias("trade"),
        F.when(good, F.col("bar")).alias("bar"), *dead)
    kept.write.mode("overwrite").partitionBy("output").parquet(path)
    stored = df.sparkSession.read.schema(kept.schema).parquet(path)
    return Routed(
        stored.filter("output = 'trade'").select(*[F.col(f"trade.{c}") for c in routes.trades.columns]),
        stored.filter("output = 'kline'").select(*[F.col(f"bar.{c}") for c in routes.klines.columns]),
        stored.filter("output = 'dlq'").select(
            F.col("dead_kind").alias("kind"), F.lit("unknown").alias("key"), F.col("dead_value").alias("value")))


def flatten_klines(df: DataFrame) -> DataFrame:
    """Nested bar events as flat bars; ``number_of_trades`` becomes ``num_trades``."""
    k = F.col("kline")
    return df.select(
        F.col("symbol"), k["interval"].alias("interval"),
        k["open_time"].alias("open_time"), k["close_time"].alias("close_time"),
        *[k[c].alias(c) for c in ("open", "high", "low", "close", "volume", "quote_volume")],
        k["number_of_trades"].alias("num_trades"), k["is_closed"].alias("is_closed"),
    )


def closed_bars(df: DataFrame) -> DataFrame:
    """Typed flat bars that are final."""
    return cast_prices(flatten_klines(df)).filter("is_closed")


def live_bronze(df: DataFrame) -> DataFrame:
    """Closed nested events in the flat bronze layout (the taker columns are unknown)."""
    flat = flatten_klines(df).filter("is_closed")
    return flat.select(*[c for c in KLINE_COLUMNS if c in flat.columns])

"""Streaming jobs: bronze landing, event routing, closed bars, trade windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickframe.operators.events import (
    closed_bars, parse_json, split_tagged, tag_events, unwrap_envelope,
)
from tickframe.operators.microstructure import microstructure, type_trades
from tickframe.schemas import KLINE_EVENT, TRADE
from tickframe.sources.sinks import to_kafka_json
from tickframe.streaming.outputs import Output, tag_outputs

Sink = Callable[[DataFrame, int], None]

WINDOW_TEXT = ("window_start", "window_end")


def _trigger(every: str | None) -> dict:
    return {"processingTime": every} if every else {"availableNow": True}


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                 every: str | None = None) -> StreamingQuery:
    """Append a stream to a table; each row lands once. Without ``every`` it stops when done."""
    return (df.writeStream.format(fmt).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start(path))


def write_messages(df: DataFrame, options: dict[str, str], checkpoint: str,
                   every: str | None = None) -> StreamingQuery:
    """Send (key, value) rows to a message broker, at least once."""
    return (df.writeStream.format("kafka").options(**options).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start())


def write_bronze_stream(df: DataFrame, path: str, checkpoint: str, folders: tuple[str, ...] = ("symbol",),
                        every: str | None = "30 seconds") -> StreamingQuery:
    """Land rows under symbol(/interval)/year/month/day of the arrival time.

    ``folders`` names the leading folder columns; ``every`` is the flush time, and the source
    option (max offsets or files per trigger) the flush size. Rows without a symbol go to UNKNOWN.
    """
    now = F.current_timestamp()
    dated = df.withColumns({
        "symbol": F.coalesce("symbol", F.lit("UNKNOWN")),
        "year": F.date_format(now, "yyyy"), "month": F.date_format(now, "MM"),
        "day": F.date_format(now, "dd"),
    })
    return (dated.writeStream.format("parquet").outputMode("append")
            .option("compression", "snappy").option("checkpointLocation", checkpoint)
            .partitionBy(*folders, "year", "month", "day").trigger(**_trigger(every)).start(path))


def land_messages(df: DataFrame, kind: str) -> DataFrame:
    """Broker text to the rows ``write_bronze_stream`` lands; empty and unreadable ones are skipped."""
    schema = TRADE if kind == "trade" else KLINE_EVENT
    some_json = F.get_json_object("value", "$").startswith("{")
    rows = parse_json(df.filter(some_json), schema)
    if kind == "trade":
        return rows
    return rows.withColumn("interval", F.coalesce("kline.interval", F.lit("")))


def table_sink(path: str, fmt: str = "parquet") -> Sink:
    """Write each micro-batch to its own folder; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/batch={batch_id}")

    return write


def dual_sink(df: DataFrame, sinks: list[Sink], checkpoint: str,
              every: str | None = None) -> StreamingQuery:
    """One query feeding several sinks, so that its state exists once and is computed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return (df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**_trigger(every)).foreachBatch(write).start())


def route_stream(df: DataFrame, trades: Sink, klines: Sink, dlq: Sink, checkpoint: str,
                 every: str | None = None) -> StreamingQuery:
    """Route raw messages: each batch is parsed once and split three ways."""
    tagged = tag_events(unwrap_envelope(df))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for rows, sink in zip(split_tagged(batch), (trades, klines, dlq)):
                sink(rows, batch_id)
        finally:
            batch.unpersist()

    return (tagged.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**_trigger(every)).foreachBatch(write).start())


def closed_bars_stream(messages: DataFrame) -> DataFrame:
    """Bar messages (text) to typed closed bars."""
    return closed_bars(parse_json(messages, KLINE_EVENT))


def microstructure_stream(messages: DataFrame, window: str = "1 minute",
                          delay: str = "10 seconds") -> DataFrame:
    """Trade messages (text) to window rows."""
    check_span(window, "window", allow_zero=False)
    check_span(delay, "delay", allow_zero=True)
    return microstructure(type_trades(parse_json(messages, TRADE)), window, delay)


def check_span(text: str, name: str, allow_zero: bool) -> None:
    """Raise unless ``text`` is a duration like '10 seconds' in the allowed range."""
    amount, _, unit = text.strip().partition(" ")
    if not unit or not amount.lstrip("-").isdigit():
        raise ValueError(f"{name} must look like '10 seconds', not {text!r}")
    if int(amount) < 0 or (int(amount) == 0 and not allow_zero):
        raise ValueError(f"{name} must be {'at least' if allow_zero else 'above'} zero, not {text!r}")


def bar_messages(bars: DataFrame) -> DataFrame:
    """Closed bars as broker rows."""
    return to_kafka_json(bars)


def window_messages(rows: DataFrame) -> DataFrame:
    """Window rows as broker rows, bounds as text."""
    return to_kafka_json(rows, text=WINDOW_TEXT)


def window_outputs(rows: DataFrame) -> DataFrame:
    """Window rows tagged for two outputs: ``windows``, the rows, and ``messages``, the same as broker rows."""
    body = F.struct(*[F.col(c).cast("string").alias(c) if c in WINDOW_TEXT else F.col(c) for c in rows.columns])
    message = F.struct(F.col("symbol").alias("key"), F.to_json(body).alias("value"))
    symbol, at = F.col("symbol"), F.col("window_start")
    return tag_outputs(rows, {
        "windows": Output(F.struct(*rows.columns), F.lit(True), symbol, at),
        "messages": Output(message, F.lit(True), symbol, at),
    })

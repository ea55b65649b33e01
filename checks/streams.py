"""Queries of streams that come in batches: late and repeated rows, restarts, landing groups, several outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.oracles import TAGGED, TRADES
from checks.queries import _window_rows, doubles, query
from tickframe.plans.jobs import run_silver
from tickframe.session import fresh_path
from tickframe.sources import files, lake, sinks
from tickframe.sources.replay import Replay
from tickframe.streaming import flush as G
from tickframe.streaming import jobs as J
from tickframe.streaming.outputs import Outputs, write_outputs

DELAY_HOURS = 2
GROUP_ROWS = 700


def _messages(trades):
    """Trades as message text, with their batch."""
    return trades.select("batch", F.to_json(F.struct(*[c for c in trades.columns if c not in ("ts", "batch")])).alias("value"))


def _replayed(spark, sf):
    """Trades as messages, in the batches they arrive in."""
    return Replay(_messages(V.arrivals(spark, sf)), "batch")


def _windows(replay):
    return J.microstructure_stream(replay.stream().select("value"), "1 hour", f"{DELAY_HOURS} hours")


@query
def vwap_stream_late(spark, sf):
    """Trades in eight batches of one run; some come late, some twice."""
    replay = _replayed(spark, sf)
    replay.deliver()
    out = fresh_path(spark, "vwap")
    J.write_stream(_windows(replay), out, fresh_path(spark, "progress")).awaitTermination()
    return _window_rows(spark.read.parquet(out))


@query
def vwap_stream_restart(spark, sf):
    """The same trades, the job stopped and started again from its checkpoint after each batch."""
    replay = _replayed(spark, sf)
    out, progress = fresh_path(spark, "vwap"), fresh_path(spark, "progress")
    while replay.deliver(1):
        J.write_stream(_windows(replay), out, progress).awaitTermination()
    return _window_rows(spark.read.parquet(out))


def _again(spark, progress: str) -> None:
    """Forget that the last batch was finished, as after a crash before its commit."""
    last = max((n for n in files.names(spark, f"{progress}/commits") if n.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        files.remove(spark, f"{progress}/commits/{name}")


@query
def route_stream_outputs(spark, sf):
    """All kinds of messages in four batches to trades, bars and dead letters; compacted on the way, the last batch done twice."""
    raw = V.messages_of(V.trades(spark, sf)).withColumn("batch", F.expr("CAST(trade_time div 86400000 AS INT) div 8"))
    replay = Replay(raw.select("batch", "topic", "value"), "batch")
    replay.deliver()
    progress, root = fresh_path(spark, "progress"), fresh_path(spark, "routed")

    def run():
        tagged = G.tag_messages(replay.stream())
        outputs = Outputs.like(tagged, root, every=2)
        write_outputs(tagged, outputs, progress).awaitTermination()
        return outputs

    run()
    _again(spark, progress)
    return _routed(run())


def _routed(outputs, *more):
    trades, klines, dead = (outputs.read(n) for n in ("trades", "klines", "dlq"))
    nothing = F.lit(None).cast("string")
    return (
        trades.select(F.lit("trade").alias("route"), F.col("symbol").alias("key"), F.col("event_time"), F.col("price").alias("text"),
                      "quantity", *more)
        .unionByName(klines.select(F.lit("kline").alias("route"), F.col("symbol").alias("key"), F.col("kline.open_time").alias("event_time"),
                                   F.col("kline.open").alias("text"), F.col("kline.volume").alias("quantity"), *more))
        .unionByName(dead.select(F.concat(F.lit("dlq_"), "kind").alias("route"), "key", F.lit(None).cast("long").alias("event_time"),
                                 F.col("value").alias("text"), nothing.alias("quantity"), *more)))


@query
def vwap_stream_outputs(spark, sf):
    """Window rows as a table and as messages, both from one query over three batches; the last batch done twice."""
    trades = V.trades(spark, sf).withColumn("batch", F.expr("CAST(trade_time div 86400000 AS INT) div 12"))
    replay = Replay(_messages(trades), "batch")
    replay.deliver()
    progress, root = fresh_path(spark, "progress"), fresh_path(spark, "windows")

    def run():
        tagged = J.window_outputs(J.microstructure_stream(replay.stream(), "1 hour", "10 seconds"))
        outputs = Outputs.like(tagged, root, every=2)
        write_outputs(tagged, outputs, progress).awaitTermination()
        return outputs

    run()
    _again(spark, progress)
    outputs = run()
    table = outputs.read("windows")
    body = F.from_json("value", "window_start string, window_end string, vwap double, order_flow_imbalance double, "
                                "price_volatility double, trade_count long")
    sent = outputs.read("messages").select("key", body.alias("b")).select(
        F.col("key").alias("symbol"), F.col("b.window_start").cast("timestamp").alias("window_start"),
        F.col("b.window_end").cast("timestamp").alias("window_end"), "b.vwap", "b.order_flow_imbalance", "b.price_volatility", "b.trade_count")
    rows = table.select(F.lit("table").alias("output"), *sent.columns).unionByName(sent.withColumn("output", F.lit("messages")))
    return rows.withColumns({c: F.round(c, 9 if c == "vwap" else 6) for c in ("vwap", "order_flow_imbalance", "price_volatility")})


@query
def bronze_flush(spark, sf):
    """Messages landed in groups of at most GROUP_ROWS; the job is stopped with rows in its buffers, and at the end the timers empty them."""
    raw = V.messages_of(V.trades(spark, sf)).withColumn("batch", F.expr("CAST(trade_time div 86400000 AS INT) div 12"))
    replay = Replay(raw.select("batch", "topic", "value"), "batch")
    replay.deliver(2)
    progress, root = fresh_path(spark, "progress"), fresh_path(spark, "bronze")

    def start():
        tagged = G.land_groups(replay.stream(), GROUP_ROWS, seconds=4, lanes=2)
        outputs = Outputs.like(tagged, root, every=8)
        return outputs, write_outputs(tagged, outputs, progress, every="500 milliseconds")

    _, running = start()
    G.caught_up(running)
    running.stop()
    replay.deliver()
    outputs, running = start()
    G.drain(running, 4)
    running.stop()
    rows = _routed(outputs, "topic", "lane", "flush")
    sizes = rows.groupBy("topic", "lane", "flush").agg((F.count("*") > GROUP_ROWS).alias("oversized"))
    return rows.join(sizes, ["topic", "lane", "flush"]).drop("lane", "flush")


@query
def bronze_mixed_prefix(spark, sf):
    """History files and landed live bars below one prefix, read by one scan and cleaned to silver."""
    bronze, silver, bad = (fresh_path(spark, n) for n in ("mixed", "silver", "bad"))
    sinks.write_bronze_klines(V.bronze(spark, sf).filter(V.minute() % 2 == 0), bronze)
    sinks.write_live_klines(V.bar_events(spark, sf), bronze)
    run_silver(spark, bronze, silver, bad, mixed=True)
    return doubles(lake.read_silver_klines(spark, silver))


# --- SQL --------------------------------------------------------------------------------------

_ARRIVALS = TRADES + f""",
span AS (SELECT *, (trade_time // 86400000 - (SELECT min(trade_time // 86400000) FROM trades)) // {V.BATCH_DAYS}
           + CASE WHEN trade_id % 13 = 0 THEN 1 WHEN trade_id % 17 = 0 THEN 2 ELSE 0 END AS b FROM trades),
arr AS (
  SELECT symbol, trade_id, price, quantity, is_buyer_maker, trade_time AS t, b, 1 AS nth FROM span
  UNION ALL
  SELECT symbol, trade_id, price, quantity, is_buyer_maker,
         trade_time + 3600000 * CASE WHEN trade_id % 11 = 0 THEN 0 WHEN trade_id % 19 = 0 THEN 1 ELSE 100 END, b + 1, 2
  FROM span WHERE trade_id % 11 = 0 OR trade_id % 19 = 0 OR trade_id % 23 = 0)"""


def _late(back: int) -> str:
    """Windows of what a stream counts whose watermark in a batch comes from the batches up to ``back`` before it.

    A row not above the watermark is late. A repeat is known while the first one's time plus the delay is above it.
    A window is given out when the last watermark has reached its end.
    """
    delay = DELAY_HOURS * 3_600_000
    return "WITH " + _ARRIVALS + f""",
    mark AS (SELECT b, max(max(t)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND {back} PRECEDING) - {delay} AS low
             FROM arr GROUP BY b),
    timely AS (SELECT arr.*, low FROM arr JOIN mark USING (b) WHERE low IS NULL OR t > low),
    counted AS (
      SELECT r.* FROM timely r LEFT JOIN timely f ON f.symbol = r.symbol AND f.trade_id = r.trade_id AND f.nth = 1 AND r.nth = 2
      WHERE f.trade_id IS NULL OR NOT (r.low IS NULL OR f.t + {delay} > r.low))
    SELECT symbol, window_start, window_start + INTERVAL 1 HOUR AS window_end,
      round(sum(CAST(price AS DOUBLE) * quantity) / sum(quantity), 9) AS vwap,
      round(CAST(sum(CASE WHEN is_buyer_maker THEN -quantity ELSE quantity END) AS DOUBLE), 6) AS order_flow_imbalance,
      round(coalesce(stddev_samp(CAST(price AS DOUBLE)), 0), 6) AS price_volatility, count(*) AS trade_count
    FROM (SELECT *, date_trunc('hour', epoch_ms(t)) AS window_start FROM counted)
    WHERE window_start + INTERVAL 1 HOUR <= epoch_ms((SELECT max(t) - {delay} FROM arr))
    GROUP BY symbol, window_start"""


def oracles(known: dict[str, str]) -> dict[str, str]:
    """SQL of these queries; some share that of a batch query."""
    topic = "CASE WHEN kind < 3 THEN 'trades' ELSE 'klines' END AS topic, false AS oversized"
    landed = "WITH " + TAGGED + f"""
      SELECT 'trade' AS route, symbol AS key, trade_time AS event_time, CAST(price AS VARCHAR) AS text,
             CAST(quantity AS VARCHAR) AS quantity, {topic} FROM msgs WHERE kind < 3 AND NOT bad
      UNION ALL SELECT 'kline', symbol, opened, CAST(price AS VARCHAR), CAST(quantity AS VARCHAR), {topic}
        FROM msgs WHERE kind = 3 AND NOT bad
      UNION ALL SELECT CASE WHEN kind < 3 THEN 'dlq_trade' ELSE 'dlq_kline' END, 'unknown', NULL,
        CASE WHEN kind < 2 THEN short WHEN kind = 2 THEN long ELSE bar END, NULL, {topic} FROM dead"""
    return {
        # In one run a batch's watermark is that of the batch before it; after a restart an empty batch has brought it up to date.
        "vwap_stream_late": _late(2),
        "vwap_stream_restart": _late(1),
        "route_stream_outputs": known["route_events"],
        "vwap_stream_outputs": f"SELECT * FROM ({known['vwap_stream']}), (VALUES ('table'), ('messages')) o(output)",
        "bronze_flush": landed,
        "bronze_mixed_prefix": known["live_to_silver"],
    }

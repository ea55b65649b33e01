"""SQL for the registered queries, written independently against the raw tables."""

from __future__ import annotations

TRADES = """
trades AS (
  SELECT event_type AS symbol, event_id AS trade_id, CAST(value AS DECIMAL(18,2)) AS price,
         CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS quantity,
         epoch_us(ts) // 1000 AS trade_time, CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 AS is_buyer_maker,
         ts, epoch_us(ts) // 60000000 * 60000 AS opened
  FROM events)"""

BARS = TRADES + """,
bars AS (
  SELECT symbol, '1m' AS "interval", opened AS open_time,
         CAST(arg_min(price, ts) AS DECIMAL(18,8)) AS open, CAST(max(price) AS DECIMAL(18,8)) AS high,
         CAST(min(price) AS DECIMAL(18,8)) AS low, CAST(arg_max(price, ts) AS DECIMAL(18,8)) AS close,
         CAST(sum(quantity) AS DECIMAL(18,8)) AS volume, opened + 59999 AS close_time,
         CAST(sum(price * quantity) AS DECIMAL(18,8)) AS quote_volume, count(*) AS num_trades,
         CAST(sum(CASE WHEN is_buyer_maker THEN 0 ELSE quantity END) AS DECIMAL(18,8)) AS taker_buy_base_volume,
         CAST(sum(CASE WHEN is_buyer_maker THEN 0 ELSE price * quantity END) AS DECIMAL(18,8)) AS taker_buy_quote_volume,
         epoch_ms(opened) AS open_ts, epoch_ms(opened + 59999) AS close_ts, opened // 60000 AS m
  FROM trades GROUP BY symbol, opened)"""

TEXT_COLUMNS = ["open", "high", "low", "close", "volume", "quote_volume",
                "taker_buy_base_volume", "taker_buy_quote_volume"]


def _as(kind: str, names=TEXT_COLUMNS) -> str:
    return ", ".join(f"CAST({c} AS {kind}) AS {c}" for c in names)


# Bars some of which a rule makes invalid, with exact copies and corrected copies.
DAMAGED = BARS + """,
damaged AS (
  SELECT symbol, "interval", open_time, close_time, num_trades, m, high, low, quote_volume,
         taker_buy_base_volume, taker_buy_quote_volume, open_ts, close_ts,
         CASE WHEN m % 17 <> 0 THEN open END AS open,
         CASE WHEN m % 19 = 0 THEN -volume ELSE volume END AS volume,
         CASE WHEN m % 23 = 0 THEN NULL ELSE close END AS close
  FROM bars),
copied AS (
  SELECT * FROM damaged
  UNION ALL SELECT * FROM damaged WHERE m % 3 = 0
  UNION ALL SELECT * REPLACE (close_time + 1 AS close_time, CAST(high + 1 AS DECIMAL(18,8)) AS high,
                              close_ts + INTERVAL 1 MILLISECOND AS close_ts)
            FROM damaged WHERE m % 5 = 0)"""

STAGED = BARS + """,
staged AS (
  SELECT md5(symbol || '-' || "interval" || '-' || strftime(open_ts, '%Y-%m-%d %H:%M:%S.%g')) AS kline_id,
         symbol, "interval", open_ts AS open_at, open, high, low, close, volume, close_ts AS close_at,
         quote_volume, num_trades, taker_buy_base_volume, taker_buy_quote_volume
  FROM bars)"""


def _ohlcv(key: str, period: str, bucket: str, text: str) -> str:
    return f"""
  SELECT md5(symbol || '-' || {text}) AS {key}, * FROM (
    SELECT symbol, {bucket} AS {period}, CAST(arg_min(open, open_at) AS DOUBLE) AS open,
           CAST(max(high) AS DOUBLE) AS high, CAST(min(low) AS DOUBLE) AS low,
           CAST(arg_max(close, open_at) AS DOUBLE) AS close, CAST(sum(volume) AS DOUBLE) AS volume,
           CAST(sum(quote_volume) AS DOUBLE) AS quote_volume, CAST(sum(num_trades) AS BIGINT) AS num_trades
    FROM staged GROUP BY ALL)"""


DAILY = _ohlcv("daily_kline_id", "trade_date", "CAST(open_at AS DATE)", "CAST(trade_date AS VARCHAR)")
HOURLY = _ohlcv("hourly_kline_id", "hour_at", "date_trunc('hour', open_at)",
                "strftime(hour_at, '%Y-%m-%d %H:%M:%S.%g')")
RETURNS = """
  SELECT md5(symbol || '-' || "interval" || '-' || strftime(open_at, '%Y-%m-%d %H:%M:%S.%g')) AS kline_return_id,
         symbol, "interval", open_at, CAST(close AS DOUBLE) AS close,
         CASE WHEN lag(close) OVER w = 0 THEN NULL WHEN close = 0 AND lag(close) OVER w > 0 THEN '-inf'::DOUBLE
           ELSE ln(CAST(close AS DOUBLE) / CAST(lag(close) OVER w AS DOUBLE)) END AS log_return
  FROM staged WINDOW w AS (PARTITION BY symbol, "interval" ORDER BY open_at)"""

SERIES = BARS + """,
s AS MATERIALIZED (
  SELECT symbol, open_time, CAST(close AS DOUBLE) AS x, CAST(volume AS DOUBLE) AS v, m,
         row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol) AS n,
         lag(CAST(close AS DOUBLE)) OVER w AS px, lead(CAST(close AS DOUBLE)) OVER w AS nx
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time))"""


# A step from or to a zero price is undefined and counts as none.
STEP = "CASE WHEN x > 0 AND px > 0 THEN ln(x / px) ELSE 0 END"


def _scale(c: str, digits: int) -> str:
    """Mean, deviation and odd values of a feature, over its finite values."""
    finite = f"FILTER (WHERE isfinite({c}))"
    std = f"stddev_samp({c}) {finite}"
    return (f"round(avg({c}) {finite}, {digits}) AS {c}_mean, round(CASE WHEN {std} > 0 THEN {std} ELSE 1 END, {digits}) AS {c}_std, "
            f"count(*) FILTER (WHERE NOT isfinite({c})) AS {c}_odd")


def _line_texts() -> list[str]:
    """All columns of the line items as text."""
    amounts = [f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return [f"CAST({c} AS VARCHAR)" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")] + amounts + [
        "l_returnflag", "l_linestatus", "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')"]


def _frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY open_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


# The serial loops, one step per bar.
LOOP_EMA = SERIES + """,
r AS (
  SELECT symbol, open_time, rn, x AS e FROM s WHERE rn = 1
  UNION ALL
  SELECT s.symbol, s.open_time, s.rn, s.x * (2.0::DOUBLE / 11) + r.e * (1 - 2.0::DOUBLE / 11)
  FROM r JOIN s ON s.symbol = r.symbol AND s.rn = r.rn + 1)"""

LOOP_MACD = """
md AS (
  SELECT symbol, open_time, rn, x AS f, x AS g, 0.0::DOUBLE AS sg FROM s WHERE rn = 1
  UNION ALL
  SELECT symbol, open_time, rn, f, g, (f - g) * (2.0::DOUBLE / 10) + sg * (1 - 2.0::DOUBLE / 10) FROM (
    SELECT s.symbol, s.open_time, s.rn, s.x * (2.0::DOUBLE / 13) + md.f * (1 - 2.0::DOUBLE / 13) AS f,
           s.x * (2.0::DOUBLE / 27) + md.g * (1 - 2.0::DOUBLE / 27) AS g, md.sg
    FROM md JOIN s ON s.symbol = md.symbol AND s.rn = md.rn + 1))"""

LOOP_RSI = """
steps AS MATERIALIZED (
  SELECT symbol, open_time, rn, greatest(x - px, 0) AS up, greatest(px - x, 0) AS down FROM s),
seeds AS (
  SELECT symbol, sum(up) / 14 AS ag, sum(down) / 14 AS al, count(*) AS k
  FROM steps WHERE rn BETWEEN 2 AND 15 GROUP BY symbol),
rs AS (
  SELECT t.symbol, t.open_time, t.rn, ag, al FROM steps t JOIN seeds USING (symbol) WHERE rn = 15
  UNION ALL
  SELECT t.symbol, t.open_time, t.rn, t.up / 14 + rs.ag * (1 - 1.0::DOUBLE / 14),
         t.down / 14 + rs.al * (1 - 1.0::DOUBLE / 14)
  FROM rs JOIN steps t ON t.symbol = rs.symbol AND t.rn = rs.rn + 1),
rsi AS (
  SELECT symbol, open_time, CASE WHEN al = 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / al) END AS rsi_14 FROM rs
  UNION ALL SELECT symbol, open_time, 50.0 FROM s WHERE rn < 15)"""

FEATURES = "WITH RECURSIVE " + SERIES + "," + LOOP_MACD + "," + LOOP_RSI + f""",
feats AS (
  SELECT s.open_time, s.symbol, '1m' AS "interval", x AS close_float, v AS volume,
         avg(x) OVER {_frame(20)} AS sma_20, avg(x) OVER {_frame(50)} AS sma_50,
         coalesce(stddev_samp(x) OVER {_frame(20)}, 0) AS vol_20, rsi_14, f - g AS macd, sg AS macd_signal,
         avg(x) OVER {_frame(20)} + 2 * stddev_pop(x) OVER {_frame(20)} AS bb_upper,
         avg(x) OVER {_frame(20)} - 2 * stddev_pop(x) OVER {_frame(20)} AS bb_lower,
         {STEP} AS returns_1, CASE WHEN nx > x THEN 1 ELSE 0 END AS target_direction
  FROM s JOIN md USING (symbol, open_time) JOIN rsi USING (symbol, open_time))"""

FEATURE_NAMES = ["close_float", "volume", "sma_20", "sma_50", "vol_20", "rsi_14", "macd", "macd_signal",
                 "bb_upper", "bb_lower", "returns_1"]

FEATURES_OUT = (FEATURES + 'SELECT open_time, symbol, "interval", '
                + ", ".join(f"round({c}, 8) AS {c}" for c in FEATURE_NAMES)
                + ", CAST(target_direction AS BIGINT) AS target_direction FROM feats")

LINES = """
lines AS (
  SELECT l_returnflag || l_linestatus AS symbol, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
         l_extendedprice AS x FROM lineitem)"""
LINE_COLUMNS = "symbol, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"
LINE_ORDER = "PARTITION BY symbol ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"

TAGGED = TRADES + """,
msgs AS (
  SELECT *, trade_id % 5 AS kind, trade_id % 17 = 0 AS bad, lower(CAST(is_buyer_maker AS VARCHAR)) AS mk FROM trades),
dead AS (
  SELECT kind, '{"e":"trade","E":' || trade_time || ',"s":"' || symbol || '","t":' || trade_id
         || ',"q":"' || quantity || '","T":' || trade_time || ',"m":' || mk || '}' AS short,
         '{"event_type":"trade","event_time":' || trade_time || ',"symbol":"' || symbol || '","trade_id":' || trade_id
         || ',"quantity":"' || quantity || '","trade_time":' || trade_time || ',"is_buyer_maker":' || mk || '}' AS long,
         '{"e":"kline","E":' || trade_time || ',"s":"' || symbol || '","k":{"t":' || opened || ',"T":' || (opened + 59999)
         || ',"s":"' || symbol || '","i":"1m","c":"' || price || '","h":"' || price || '","l":"' || price
         || '","v":"' || quantity || '","n":1,"x":' || mk || ',"q":"1"}}' AS bar
  FROM msgs WHERE bad AND kind < 4)"""

NODES = """
made AS (
  SELECT 'source.priority.' || o_orderpriority AS id, 'raw.' || o_orderpriority AS name, 'dbt_source' AS type
  FROM orders
  UNION ALL
  SELECT 'model.order.' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'silver' ELSE 'gold' END
         || '.order_' || o_orderkey, 'table' FROM orders),
links AS (
  SELECT 'source.priority.' || o_orderpriority AS from_node, 'model.order.' || o_orderkey AS to_node FROM orders
  UNION ALL SELECT 'source.customer.' || o_custkey, 'model.order.' || o_orderkey FROM orders),
kinds AS (SELECT DISTINCT id, type FROM made UNION SELECT 'source.customer.' || c_custkey, 'topic' FROM customer),
resolved AS (
  SELECT DISTINCT from_node, to_node, 'dbt_model_dependency' AS relationship,
         coalesce(a.type, 'table') AS from_type, coalesce(b.type, 'table') AS to_type
  FROM links LEFT JOIN kinds a ON a.id = from_node LEFT JOIN kinds b ON b.id = to_node)"""


def _rules(rows: list[tuple[str, str, str]], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, '{column}' AS \"column\", CAST(count(*) AS BIGINT) AS failures FROM {source} "
        f"WHERE {broken}" for rule, column, broken in rows)


def _repeats(column: str, source: str) -> str:
    return (f" UNION ALL SELECT 'unique', '{column}', CAST(count(*) AS BIGINT) FROM "
            f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)")


SOURCE_NOT_NULL = ["symbol", "interval", "open_time", "open", "high", "low", "close", "volume", "close_time",
                   "quote_volume", "num_trades", "taker_buy_base_volume", "taker_buy_quote_volume"]
STAGING_NOT_NULL = ["kline_id", "symbol", "interval", "open_at", "open", "high", "low", "close", "volume", "close_at"]
HOURLY_NOT_NULL = ["hourly_kline_id", "hour_at", "symbol", "open", "high", "low", "close", "volume"]
RETURNS_NOT_NULL = ["kline_return_id", "symbol", "interval", "open_at", "close"]
DAILY_NOT_NULL = ["daily_kline_id", "trade_date", "symbol", "open", "high", "low", "close", "volume"]


def _pages() -> str:
    """Bars that survive the page rules: minutes off by 17 are cut short, by 29 hold no price."""
    return f"""
  SELECT symbol, "interval", open_time, {_as('VARCHAR', TEXT_COLUMNS[:5])}, close_time,
         CAST(quote_volume AS VARCHAR) AS quote_volume, num_trades, {_as('VARCHAR', TEXT_COLUMNS[6:])}
  FROM bars WHERE m % 17 <> 0 AND m % 29 <> 0"""


def all_oracles() -> dict[str, str]:
    w = "WITH "
    bronze = (f'SELECT symbol, "interval", open_time, close_time, num_trades, {_as("VARCHAR")} FROM bars')
    measures = """round(sum(volume), 6) AS total_volume, round(sum(quote_volume), 6) AS total_quote_volume,
      CAST(sum(num_trades) AS BIGINT) AS total_trades, round(avg(close), 6) AS avg_close,
      max(high) AS max_high, min(low) AS min_low"""
    returns = "round(avg(log_return), 8) AS avg_log_return, round(stddev_samp(log_return), 8) AS stddev_log_return"
    window_rows = """SELECT symbol, date_trunc('hour', ts) AS window_start,
      date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
      round(sum(CAST(price AS DOUBLE) * quantity) / sum(quantity), 9) AS vwap,
      round(CAST(sum(CASE WHEN is_buyer_maker THEN -quantity ELSE quantity END) AS DOUBLE), 6) AS order_flow_imbalance,
      round(coalesce(stddev_samp(CAST(price AS DOUBLE)), 0), 6) AS price_volatility, count(*) AS trade_count
      FROM trades GROUP BY ALL"""
    silver = f"""SELECT symbol, "interval", open_time, close_time, num_trades, {_as('DOUBLE')}"""
    survivors = """FROM (SELECT *, row_number() OVER (PARTITION BY symbol, "interval", open_time
      ORDER BY close_time DESC, high DESC) AS rn FROM copied
      WHERE open IS NOT NULL AND close IS NOT NULL AND volume >= 0) WHERE rn = 1"""
    upserted = """SELECT symbol, "interval", open_time,
      CAST(CASE WHEN m % 2 = 0 THEN close + 1 ELSE close END AS DOUBLE) AS close,
      CASE WHEN m % 2 = 0 THEN TIMESTAMP '2024-02-02' ELSE TIMESTAMP '2024-02-01' END AS _loaded_at FROM bars"""
    closed = """SELECT symbol, opened AS open_time, opened + 59999 AS close_time, '1m' AS "interval",
      CAST(price AS DOUBLE) AS open, CAST(price AS DOUBLE) AS high, CAST(price AS DOUBLE) AS low,
      CAST(price AS DOUBLE) AS close, CAST(quantity AS DOUBLE) AS volume, CAST(price AS DOUBLE) AS quote_volume,
      trade_id AS num_trades, true AS is_closed FROM trades WHERE is_buyer_maker"""
    found = {
        "route_events": w + TAGGED + """
          SELECT 'trade' AS route, symbol AS key, trade_time AS event_time, CAST(price AS VARCHAR) AS text,
                 CAST(quantity AS VARCHAR) AS quantity FROM msgs WHERE kind < 3 AND NOT bad
          UNION ALL SELECT 'kline', symbol, opened, CAST(price AS VARCHAR), CAST(quantity AS VARCHAR)
            FROM msgs WHERE kind = 3 AND NOT bad
          UNION ALL SELECT CASE WHEN kind < 3 THEN 'dlq_trade' ELSE 'dlq_kline' END, 'unknown', NULL,
            CASE WHEN kind < 2 THEN short WHEN kind = 2 THEN long ELSE bar END, NULL FROM dead""",
        "closed_bars_batch": w + BARS + f"""
          SELECT symbol, "interval", open_time, close_time, num_trades, true AS is_closed,
                 {_as('DOUBLE', TEXT_COLUMNS[:6])} FROM bars WHERE m % 4 <> 0""",
        # JSON writes a decimal zero of eight digits as 0E-8.
        "kafka_json": w + BARS + """
          SELECT symbol AS key, '{"symbol":"' || symbol || '","interval":"1m","open_time":' || open_time || ',"close_time":' || close_time""" + "".join(
            f""" || ',"{c}":' || CASE WHEN {c} = 0 THEN '0E-8' ELSE CAST({c} AS VARCHAR) END"""
            for c in ("open", "high", "low", "close", "volume", "quote_volume")) + """
            || ',"num_trades":' || num_trades || ',"is_closed":true}' AS value FROM bars WHERE m % 4 <> 0""",
        "page_rejects": w + BARS + """
          SELECT symbol, "interval", CASE page % 3 WHEN 0 THEN '{"code":-1121}' ELSE '[[1,"2"' END AS payload,
                 'unreadable payload' AS reject_reason
          FROM (SELECT DISTINCT symbol, "interval", open_time // 60000000 AS page FROM bars) WHERE page % 3 < 2""",
        "rejects_roundtrip": w + BARS + """
          SELECT * FROM (
            SELECT symbol, "interval", CASE WHEN m % 37 <> 0 THEN open_time END AS open_time, close_time,
              CASE WHEN m % 17 <> 0 THEN CAST(open AS VARCHAR) END AS open_text,
              CASE WHEN m % 31 = 0 THEN '30000000000000' ELSE CAST(high AS VARCHAR) END AS high_text,
              CASE WHEN m % 23 = 0 THEN 'abc' ELSE CAST(close AS VARCHAR) END AS close_text,
              CASE WHEN m % 19 = 0 THEN '-' ELSE '' END || CAST(volume AS VARCHAR) AS volume_text,
              CASE WHEN m % 37 = 0 THEN 'open_time missing' WHEN m % 31 = 0 THEN 'high unreadable'
                WHEN m % 23 = 0 THEN 'close unreadable' WHEN m % 17 = 0 THEN 'open missing'
                WHEN m % 19 = 0 THEN 'volume negative' END AS reject_reason FROM bars)
          WHERE reject_reason IS NOT NULL""",
        "parse_kline_pages": w + BARS + _pages(),
        "page_metrics": w + BARS + """
          SELECT symbol, "interval", CAST(count(*) FILTER (m % 17 <> 0 AND m % 29 <> 0) AS BIGINT) AS bars,
                 CAST(count(*) FILTER (m % 17 = 0 OR m % 29 = 0) AS BIGINT) AS malformed FROM bars GROUP BY ALL""",
        "backfill_plan": """
          WITH spans AS (
            SELECT event_type AS symbol, epoch_ms(CAST(CAST(min(ts) AS DATE) AS TIMESTAMP)) AS s,
                   epoch_ms(CAST(CAST(max(ts) AS DATE) + 1 AS TIMESTAMP)) AS e FROM events GROUP BY 1),
          steps(iv, step) AS (VALUES ('1m', 60000000), ('1h', 3600000000), ('1d', 86400000000)),
          numbered AS (SELECT *, unnest(range(0, (e - s + step - 1) // step)) AS page FROM spans, steps)
          SELECT symbol, iv AS "interval", page, s + page * step AS page_start,
                 least(s + (page + 1) * step, e) AS page_end FROM numbered""",
        "split_valid": w + BARS + """
          SELECT symbol, "interval", open_time, CASE WHEN m % 23 = 0 THEN 'close unreadable'
            WHEN m % 17 = 0 THEN 'open missing' WHEN m % 19 = 0 THEN 'volume negative' ELSE 'valid' END AS outcome
          FROM bars""",
        "dedup_latest": w + BARS + """
          SELECT symbol, "interval", open_time, CASE WHEN m % 5 = 0 THEN close_time + 1 ELSE close_time END AS close_time,
                 CAST(CASE WHEN m % 5 = 0 THEN high + 1 ELSE high END AS DOUBLE) AS high FROM bars""",
        "union_bronze": w + BARS + f"""
          SELECT symbol, "interval", open_time, close_time, num_trades, {_as('VARCHAR')} FROM bars
          UNION ALL
          SELECT symbol, "interval", open_time, close_time, num_trades, {_as('VARCHAR', TEXT_COLUMNS[:6])}, NULL, NULL
          FROM bars WHERE m % 4 <> 0""",
        "to_silver": w + DAMAGED + silver + """, open_ts, close_ts, CAST(year(open_ts) AS INTEGER) AS year,
          CAST(month(open_ts) AS INTEGER) AS month """ + survivors,
        "silver_metrics": w + DAMAGED + """
          SELECT raw, rejected, kept, raw - rejected - kept AS duplicates FROM (
            SELECT count(*) AS raw,
                   count(*) FILTER (open IS NULL OR close IS NULL OR volume < 0) AS rejected,
                   count(DISTINCT symbol || open_time) FILTER (open IS NOT NULL AND close IS NOT NULL AND volume >= 0)
                     AS kept FROM copied)""",
        "upsert_latest": w + BARS + upserted,
        "upsert_table": w + BARS + upserted,
        "scan_latest": w + BARS + upserted,
        "live_to_silver": w + BARS + f"""
          SELECT symbol, "interval", open_time, close_time, num_trades, {_as('DOUBLE', TEXT_COLUMNS[:6])},
                 CAST(CASE WHEN m % 2 = 0 THEN taker_buy_base_volume END AS DOUBLE) AS taker_buy_base_volume,
                 CAST(CASE WHEN m % 2 = 0 THEN taker_buy_quote_volume END AS DOUBLE) AS taker_buy_quote_volume FROM bars""",
        "rollup_daily": w + STAGED + f""", d AS ({DAILY})
          SELECT symbol, CAST(date_trunc('week', trade_date) AS DATE) AS trade_date, {measures} FROM d GROUP BY ALL""",
        "stg_klines": w + STAGED + f"""
          SELECT kline_id, symbol, "interval", open_at, close_at, num_trades, {_as('DOUBLE')} FROM staged""",
        "ohlcv_daily": w + STAGED + DAILY,
        "ohlcv_hourly": w + STAGED + HOURLY,
        "log_returns": w + STAGED + f"SELECT * REPLACE (round(log_return, 8) AS log_return) FROM ({RETURNS})",
        "vwap_batch": w + TRADES + window_rows,
        "vwap_stream": w + TRADES + f"""
          SELECT * FROM ({window_rows})
          WHERE window_end <= (SELECT max(epoch_ms(trade_time)) - INTERVAL 10 SECOND FROM trades)""",
        "closed_bars_stream": w + TRADES + closed,
        "route_stream": w + TRADES + """
          SELECT CASE WHEN trade_id % 17 = 0 THEN 'dlq' ELSE 'trade' END AS route, symbol, trade_id,
                 CASE WHEN trade_id % 17 <> 0 THEN CAST(price AS VARCHAR) END AS price FROM trades""",
        "bronze_stream": w + TRADES + """
          SELECT symbol, trade_id, CAST(price AS VARCHAR) AS price, CAST(quantity AS VARCHAR) AS quantity,
                 trade_time, is_buyer_maker FROM trades""",
        "sma": w + SERIES + f"""
          SELECT symbol, open_time, round(avg(x) OVER {_frame(20)}, 8) AS sma_20,
                 round(avg(x) OVER {_frame(50)}, 8) AS sma_50 FROM s""",
        "rolling_std": w + SERIES + f"""
          SELECT symbol, open_time, round(coalesce(stddev_samp(x) OVER {_frame(20)}, 0), 6) AS vol_20 FROM s""",
        "bollinger": w + SERIES + f"""
          SELECT symbol, open_time, round(avg(x) OVER {_frame(20)} + 2 * stddev_pop(x) OVER {_frame(20)}, 6) AS bb_upper,
                 round(avg(x) OVER {_frame(20)} - 2 * stddev_pop(x) OVER {_frame(20)}, 6) AS bb_lower FROM s""",
        "returns_target": w + SERIES + f"""
          SELECT symbol, open_time, round({STEP}, 8) AS returns_1,
                 CAST(CASE WHEN nx > x THEN 1 ELSE 0 END AS BIGINT) AS target_direction FROM s""",
        "target_horizon_5": w + SERIES + """
          SELECT symbol, open_time, CAST(CASE WHEN lead(x, 5) OVER (PARTITION BY symbol ORDER BY open_time) > x
            THEN 1 ELSE 0 END AS BIGINT) AS target_direction FROM s""",
        "bfill_ffill": w + BARS + """,
          holes AS (SELECT symbol, open_time, CASE WHEN m % 3 = 0 THEN CAST(open AS DOUBLE) END AS open,
                           CASE WHEN m % 7 = 0 THEN CAST(high AS DOUBLE) END AS high FROM bars)
          SELECT symbol, open_time,
            coalesce(first_value(open IGNORE NULLS) OVER ahead, last_value(open IGNORE NULLS) OVER behind) AS open,
            coalesce(first_value(high IGNORE NULLS) OVER ahead, last_value(high IGNORE NULLS) OVER behind) AS high
          FROM holes WINDOW
            ahead AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
            behind AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "ema": "WITH RECURSIVE " + LOOP_EMA + "SELECT symbol, open_time, round(e, 6) AS ema_10 FROM r",
        "rsi": "WITH RECURSIVE " + SERIES + "," + LOOP_RSI
               + "SELECT symbol, open_time, round(rsi_14, 6) AS rsi_14 FROM rsi",
        "macd": "WITH RECURSIVE " + SERIES + "," + LOOP_MACD + """
          SELECT symbol, open_time, round(f - g, 6) AS macd, round(sg, 6) AS macd_signal,
                 round(f - g - sg, 6) AS macd_hist FROM md""",
        # The serial loop over each whole series, as a fold that grows the list of averages.
        "ema_long_series": w + LINES + f""",
          placed AS MATERIALIZED (SELECT *, row_number() OVER ({LINE_ORDER}) AS rn FROM lines),
          folded AS (SELECT symbol, list_reduce(list([x] ORDER BY rn), lambda a, b: list_append(
                       a, b[1] * (2.0::DOUBLE / 13) + a[len(a)] * (1 - 2.0::DOUBLE / 13))) AS e FROM placed GROUP BY symbol),
          averages AS (SELECT symbol, unnest(e) AS y, generate_subscripts(e, 1) AS rn FROM folded)
          SELECT {LINE_COLUMNS}, round(y, 4) AS ema_12 FROM placed JOIN averages USING (symbol, rn)""",
        "sma_long_series": w + LINES + f"""
          SELECT {LINE_COLUMNS}, round(avg(x) OVER ({LINE_ORDER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 4)
            AS sma_20 FROM lines""",
        "build_features": FEATURES_OUT,
        "features_roundtrip": FEATURES_OUT,
        "fit_scaler": FEATURES + "SELECT " + ", ".join(
            _scale(c, 6) for c in FEATURE_NAMES) + " FROM feats",
        "fit_scaler_zero_prices": FEATURES.replace(
            "CAST(close AS DOUBLE)", "(CASE WHEN m % 50 = 0 THEN 0.0::DOUBLE ELSE CAST(close AS DOUBLE) END)")
            + "SELECT " + ", ".join(_scale(c, 5) for c in FEATURE_NAMES) + " FROM feats",
        "apply_scaler": FEATURES + "SELECT symbol, open_time, " + ", ".join(
            f"round(({c} - (SELECT avg({c}) FROM feats)) / (SELECT stddev_samp({c}) FROM feats), 5) AS {c}"
            for c in FEATURE_NAMES) + " FROM feats",
        "sequences": FEATURES + f"""
          SELECT symbol, open_time, CAST(60 AS BIGINT) AS steps, CAST(660 AS BIGINT) AS cells, first_close, last_close,
                 round(total, 3) AS total, CAST(label AS BIGINT) AS label FROM (
            SELECT symbol, open_time, rn, n, lag(x, 59) OVER (PARTITION BY symbol ORDER BY open_time) AS first_close,
                   x AS last_close, sum({' + '.join(FEATURE_NAMES)}) OVER {_frame(60)} AS total, target_direction AS label
            FROM feats JOIN (SELECT symbol, open_time, rn, n, x FROM s) USING (symbol, open_time)) WHERE rn >= 60 AND rn < n""",
        "temporal_split": w + SERIES + """
          SELECT symbol, open_time, '1m' AS "interval",
                 CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM s""",
        "fingerprint": """
          SELECT count(*) AS row_count, CAST(sum(CAST(('0x' || substr(md5(""" + " || ".join(
            f"coalesce(length({c}) || ':' || {c}, '-')" for c in _line_texts()) + """), 1, 15)) AS HUGEINT)) AS VARCHAR) AS digest
          FROM lineitem""",
        "accuracy": w + BARS + """,
          t AS (SELECT CAST(close - open AS DOUBLE) AS rise, CASE WHEN lead(close) OVER
                (PARTITION BY symbol ORDER BY open_time) > close THEN 1 ELSE 0 END AS up FROM bars)
          SELECT count(*) AS total, count(*) FILTER (CASE WHEN rise > 0 THEN 1 ELSE 0 END = up) AS correct,
                 round(count(*) FILTER (CASE WHEN rise > 0 THEN 1 ELSE 0 END = up) / count(*), 6) AS accuracy FROM t""",
        "quality_checks": w + STAGED + f", d AS ({DAILY}) " + _rules(
            [("not_null", c, f"{c} IS NULL") for c in DAILY_NOT_NULL]
            + [("holds", "high >= low", "high < low"), ("holds", "volume >= 0", "volume < 0"),
               ("holds", "num_trades >= 0", "num_trades < 0")], "d") + _repeats("daily_kline_id", "d"),
        "quality_failures": w + DAMAGED + """,
          keyed AS (SELECT *, symbol || '|' || open_time AS bar_key FROM copied) """ + _rules(
            [("not_null", "open", "open IS NULL"), ("not_null", "close", "close IS NULL"),
             ("holds", "high >= low", "high < low"), ("holds", "volume >= 0", "volume < 0")], "keyed")
            + _repeats("bar_key", "keyed"),
        "quality_models": w + STAGED + f", h AS ({HOURLY}), q AS ({RETURNS}) " + " UNION ALL ".join(
            f"SELECT *, '{model}' AS model FROM ({sql})" for model, sql in {
                "source": _rules([("not_null", c, f'"{c}" IS NULL') for c in SOURCE_NOT_NULL], "bars"),
                "staging": _rules([("not_null", c, f'"{c}" IS NULL') for c in STAGING_NOT_NULL], "staged")
                + _repeats("kline_id", "staged"),
                "hourly": _rules([("not_null", c, f"{c} IS NULL") for c in HOURLY_NOT_NULL] + [
                    ("holds", "high >= low", "high < low"), ("holds", "volume >= 0", "volume < 0"),
                    ("holds", "num_trades >= 0", "num_trades < 0")], "h") + _repeats("hourly_kline_id", "h"),
                "returns": _rules([("not_null", c, f'"{c}" IS NULL') for c in RETURNS_NOT_NULL], "q")
                + _repeats("kline_return_id", "q"),
            }.items()),
        "metrics_daily": w + STAGED + f", d AS ({DAILY}) SELECT symbol, trade_date, {measures} FROM d GROUP BY ALL",
        "metrics_hourly": w + STAGED + f", h AS ({HOURLY}) SELECT symbol, hour_at, {measures} FROM h GROUP BY ALL",
        "metrics_returns": w + STAGED + f""", q AS ({RETURNS})
          SELECT symbol, "interval", {returns} FROM q GROUP BY ALL""",
        "rollup_returns": w + STAGED + f""", q AS ({RETURNS})
          SELECT symbol, date_trunc('day', open_at) AS open_at, {returns} FROM q GROUP BY ALL""",
        "rollup_requery": w + STAGED + f""", h AS ({HOURLY})
          SELECT symbol, CAST(date_trunc('week', hour_at) AS TIMESTAMP) AS hour_at, {measures} FROM h GROUP BY ALL""",
        "export_views": w + STAGED + f""", d AS ({DAILY})
          SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, CAST(sum(num_trades) AS BIGINT) AS total_trades,
                 max(high) AS max_high FROM d GROUP BY ALL""",
        "bronze_roundtrip": w + BARS + bronze,
        "silver_roundtrip": w + DAMAGED + silver + " " + survivors,
        "manifest_lineage": w + NODES + """
          SELECT 'node' AS kind, id, name, type AS detail, count(*) AS copies FROM made GROUP BY ALL
          UNION ALL SELECT 'edge', from_node, to_node, 'dbt_model_dependency', count(*) FROM links GROUP BY ALL""",
        "lineage_graph": w + NODES + "SELECT * FROM resolved",
        "validate": w + TRADES
        + """SELECT CASE WHEN trade_id % 5 = 2 THEN symbol END AS symbol, CASE WHEN trade_id % 5 = 2 THEN trade_id END AS trade_id,
               trade_id % 5 = 2 AND trade_id % 17 <> 0 AND trade_id % 13 <> 0 AS ok FROM trades""",
        "lineage_events": w + NODES + """
          SELECT '{"eventType":"COMPLETE","eventTime":"2024-01-01T00:00:00Z","run":{"runId":"'
            || md5(from_node || '|' || to_node) || '"},"job":{"namespace":"market","name":"' || from_node || '_to_'
            || to_node || '"},"inputs":[{"namespace":"market","name":"' || from_node
            || '"}],"outputs":[{"namespace":"market","name":"' || to_node
            || '"}],"producer":"tickframe","schemaURL":"https://openlineage.io/spec/1-0-5/OpenLineage.json#/$defs/RunEvent"}'
            AS run_event,
            '{"edge":{"fromEntity":{"id":"' || from_node || '","type":"' || from_type || '"},"toEntity":{"id":"'
            || to_node || '","type":"' || to_type || '"}},"lineageDetails":{"sqlQuery":"Relationship: '
            || relationship || '"}}' AS lineage_request FROM resolved""",
    }
    found["export_lineage"] = w + NODES + f"""
      SELECT 'node' AS kind, id AS a, name AS b, type || '|olap|' || CASE type WHEN 'table' THEN 'model built in SQL' ELSE 'raw table' END AS body
        FROM (SELECT DISTINCT * FROM made)
      UNION ALL SELECT 'node', 'source.customer.' || c_custkey, c_name, 'topic|lake|customer feed' FROM customer
      UNION ALL SELECT 'edge', from_node, to_node, relationship FROM resolved
      UNION ALL SELECT 'event', e.from_node, e.to_node, e.run_event || '|' || e.lineage_request
        FROM ({found['lineage_events'].split(NODES)[1].strip().replace("SELECT '", "SELECT from_node, to_node, '", 1)}) e"""
    # Small blocks change how a series is computed, not what comes out.
    return found | {f"{n}_blocks": found[n] for n in (
        "sma", "bollinger", "ema", "rsi", "macd", "sequences", "build_features", "target_horizon_5")}

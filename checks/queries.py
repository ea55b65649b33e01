"""One registered query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as V
from tickframe.functions.columns import ts_text
from tickframe.operators import events as E
from tickframe.operators import indicators as I
from tickframe.operators import lineage as L
from tickframe.operators import marts as M
from tickframe.operators import mlprep as P
from tickframe.operators import quality as Q
from tickframe.operators import recurrences as R
from tickframe.operators import silver as S
from tickframe.operators.microstructure import microstructure, type_trades
from tickframe.plans import metrics as X
from tickframe.plans.jobs import gold_facts, run_silver
from tickframe.schemas import FEATURE_COLUMNS, TRADE, TRADE_OPTIONAL
from tickframe.session import fresh_path, prepare
from tickframe.sources import lake, pages, sinks
from tickframe.streaming import jobs as J

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name; sessions are prepared first."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return V.ntz(fn(prepare(spark), sf.rstrip("/")))

    _QUERIES[fn.__name__] = run
    return run


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def doubles(df: DataFrame) -> DataFrame:
    """Decimals as double, which both engines print alike."""
    return df.withColumns({
        f.name: F.col(f.name).cast("double") for f in df.schema if f.dataType.typeName() == "decimal"
    })


def staged(spark, sf):
    return M.stg_klines(V.bars(spark, sf))


def features(spark, sf):
    return I.build_features(V.bars(spark, sf))


# --- messages ---------------------------------------------------------------------------------

@query
def route_events(spark, sf):
    routed = E.stored_routes(V.messages(spark, sf), fresh_path(spark, "routes"))
    trades = routed.trades.select(
        F.lit("trade").alias("route"), F.col("symbol").alias("key"), F.col("event_time"),
        F.col("price").alias("text"), "quantity")
    bars = E.flatten_klines(routed.klines).select(
        F.lit("kline").alias("route"), F.col("symbol").alias("key"),
        F.col("open_time").alias("event_time"), F.col("open").alias("text"),
        F.col("volume").alias("quantity"))
    dead = routed.dlq.select(
        F.concat(F.lit("dlq_"), "kind").alias("route"), "key",
        F.lit(None).cast("long").alias("event_time"), F.col("value").alias("text"),
        F.lit(None).cast("string").alias("quantity"))
    return trades.unionByName(bars).unionByName(dead)


@query
def validate(spark, sf):
    """All messages against the layout of long-named trades; some prices are numbers instead of text."""
    odd = F.get_json_object("value", "$.trade_id").cast("long") % 13 == 0
    value = F.when(odd, F.regexp_replace("value", '"price":"([^"]*)"', '"price":$1')).otherwise(F.col("value"))
    good, bad = E.validate(V.messages(spark, sf).select(value.alias("value")), TRADE, TRADE_OPTIONAL)
    return good.select("symbol", "trade_id", F.lit(True).alias("ok")).unionByName(bad.select(
        F.get_json_object("value", "$.symbol").alias("symbol"),
        F.get_json_object("value", "$.trade_id").cast("long").alias("trade_id"), F.lit(False).alias("ok")))


@query
def closed_bars_batch(spark, sf):
    return doubles(E.closed_bars(V.bar_events(spark, sf)))


@query
def kafka_json(spark, sf):
    return J.bar_messages(E.closed_bars(V.bar_events(spark, sf)))


# --- history pages ----------------------------------------------------------------------------

@query
def parse_kline_pages(spark, sf):
    return pages.parse_kline_pages(V.pages(spark, sf))


@query
def page_metrics(spark, sf):
    return pages.page_metrics(V.pages(spark, sf))


@query
def page_rejects(spark, sf):
    """Pages of which every third is an error object and every third is cut short."""
    kind = F.col("page") % 3
    payload = F.when(kind == 0, F.lit('{"code":-1121}')).when(kind == 1, F.lit('[[1,"2"')).otherwise(F.col("payload"))
    return pages.page_rejects(V.pages(spark, sf).withColumn("payload", payload))


@query
def backfill_plan(spark, sf):
    ranges = V.table(spark, sf, "events").groupBy(F.col("event_type").alias("symbol")).agg(
        F.min("ts").cast("date").alias("start_date"), F.max("ts").cast("date").alias("end_date"))
    return pages.backfill_plan(ranges, ["1m", "1h", "1d"])


# --- silver -----------------------------------------------------------------------------------

@query
def split_valid(spark, sf):
    good, bad = S.split_valid(S.cast_prices(S.keep_text(V.damaged(spark, sf))))
    keep = ["symbol", "interval", "open_time"]
    return good.select(*keep, F.lit("valid").alias("outcome")).unionByName(
        bad.select(*keep, F.col("reject_reason").alias("outcome")))


@query
def rejects_roundtrip(spark, sf):
    """Rejected bars written and read back with the text of their numbers; some lack a time or are out of range."""
    m, path = V.minute(), fresh_path(spark, "rejects")
    worse = V.damaged(spark, sf).withColumns({
        "high": F.when(m % 31 == 0, F.lit("30000000000000")).otherwise(F.col("high")),
        "open_time": F.when(m % 37 != 0, F.col("open_time"))})
    sinks.write_rejects(S.to_silver(worse)[1], path)
    return spark.read.parquet(path).select(
        "symbol", "interval", "open_time", "close_time", "open_text", "high_text", "close_text", "volume_text", "reject_reason")


@query
def dedup_latest(spark, sf):
    typed = S.cast_prices(V.copied(spark, sf))
    return doubles(S.dedup_latest(typed).select("symbol", "interval", "open_time", "close_time", "high"))


@query
def union_bronze(spark, sf):
    base = V.bronze(spark, sf)
    live = E.live_bronze(V.bar_events(spark, sf))
    return S.union_bronze(live, base)


@query
def to_silver(spark, sf):
    return doubles(S.to_silver(V.copied(spark, sf))[0])


@query
def silver_metrics(spark, sf):
    return S.silver_metrics(V.copied(spark, sf))


@query
def upsert_latest(spark, sf):
    old = V.bars(spark, sf).withColumn("_loaded_at", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    new = old.filter(V.minute() % 2 == 0).withColumns({
        "close": (F.col("close") + 1).cast("decimal(18,8)"),
        "_loaded_at": F.lit("2024-02-02 00:00:00").cast("timestamp"),
    })
    merged = S.upsert_latest(new, old)
    return doubles(merged.select("symbol", "interval", "open_time", "close", "_loaded_at"))


# --- facts ------------------------------------------------------------------------------------

@query
def stg_klines(spark, sf):
    return doubles(staged(spark, sf))


@query
def ohlcv_daily(spark, sf):
    return doubles(M.ohlcv(staged(spark, sf), "day"))


@query
def ohlcv_hourly(spark, sf):
    return doubles(M.ohlcv(staged(spark, sf), "hour"))


@query
def log_returns(spark, sf):
    return rounded(doubles(M.log_returns(staged(spark, sf))), "log_return", digits=8)


# --- trade windows ----------------------------------------------------------------------------

def _window_rows(df: DataFrame) -> DataFrame:
    # Quotients of cents fall on ties of six digits, which the last bit would decide; nine are too many for that.
    return rounded(rounded(df, "vwap", digits=9), "order_flow_imbalance", "price_volatility")


@query
def vwap_batch(spark, sf):
    t = V.trades(spark, sf)
    return _window_rows(microstructure(type_trades(t.unionByName(t)), "1 hour"))


def _event_stream(spark, sf):
    layout = V.table(spark, sf, "events").schema
    return lake.read_stream(spark, "parquet", {"path": sf, "pathGlobFilter": "events.parquet"}, layout)


def _finish(streaming_query) -> None:
    streaming_query.awaitTermination()


@query
def vwap_stream(spark, sf):
    """Runs the stream over everything there is, with both sinks, then reads the table back."""
    messages = V.trades_of(_event_stream(spark, sf)).drop("ts").select(
        F.to_json(F.struct("*")).alias("value"))
    rows = J.microstructure_stream(messages, "1 hour", "10 seconds")
    out, sent = fresh_path(spark, "vwap"), fresh_path(spark, "vwap-messages")

    def send(batch, batch_id):
        J.table_sink(sent)(J.window_messages(batch), batch_id)

    _finish(J.dual_sink(rows, [J.table_sink(out), send], fresh_path(spark, "progress")))
    return _window_rows(spark.read.parquet(out).drop("batch"))


@query
def closed_bars_stream(spark, sf):
    """Every trade as a bar message of its minute, closed where the buyer is the maker."""
    t = V.trades_of(_event_stream(spark, sf))
    opened = F.expr("trade_time div 60000") * 60000
    body = F.struct(
        opened.alias("open_time"), (opened + 59999).alias("close_time"), "symbol",
        F.lit("1m").alias("interval"), *[F.col("price").alias(c) for c in ("open", "close", "high", "low")],
        F.col("quantity").alias("volume"), F.col("trade_id").alias("number_of_trades"),
        F.col("is_buyer_maker").alias("is_closed"), F.col("price").alias("quote_volume"))
    messages = t.select(F.to_json(F.struct(
        F.lit("kline").alias("event_type"), "event_time", "symbol", body.alias("kline"))).alias("value"))
    out = fresh_path(spark, "closed")
    _finish(J.write_stream(J.closed_bars_stream(messages), out, fresh_path(spark, "progress")))
    return doubles(spark.read.parquet(out))


@query
def route_stream(spark, sf):
    """Trade messages through the streaming router; ones without a price end as dead letters."""
    t = V.trades_of(_event_stream(spark, sf))
    kept = t.withColumn("price", F.when(F.col("trade_id") % 17 != 0, F.col("price"))).drop("ts")
    messages = kept.select(F.to_json(F.struct("*")).alias("value"))
    good, bars, dead = (fresh_path(spark, n) for n in ("trades", "bars", "dead"))
    _finish(J.route_stream(messages, *map(J.table_sink, (good, bars, dead)), fresh_path(spark, "progress")))
    ok = spark.read.parquet(good).select(F.lit("trade").alias("route"), "symbol", "trade_id", "price")
    bad = spark.read.parquet(dead).select(
        F.lit("dlq").alias("route"), F.get_json_object("value", "$.symbol").alias("symbol"),
        F.get_json_object("value", "$.trade_id").cast("long").alias("trade_id"),
        F.lit(None).cast("string").alias("price"))
    return ok.unionByName(bad)


@query
def bronze_stream(spark, sf):
    """Trade messages landed by the bronze writer and read back without the arrival folders."""
    messages = V.trades_of(_event_stream(spark, sf)).drop("ts").select(
        F.to_json(F.struct("*")).alias("value"))
    out = fresh_path(spark, "bronze")
    _finish(J.write_bronze_stream(J.land_messages(messages, "trade"), out,
                                  fresh_path(spark, "progress"), every=None))
    return spark.read.parquet(out).select("symbol", "trade_id", "price", "quantity", "trade_time",
                                          "is_buyer_maker")


# --- indicators -------------------------------------------------------------------------------

BAR = ["symbol", "open_time"]


@query
def sma(spark, sf):
    return _sma(spark, sf)


def _sma(spark, sf, **blocks):
    bars = V.bars(spark, sf).select("symbol", "interval", "open_time", "close")
    both = I.sma(I.sma(bars, 20, **blocks), 50, **blocks)
    return rounded(both.select(*BAR, "sma_20", "sma_50"), "sma_20", "sma_50", digits=8)


@query
def rolling_std(spark, sf):
    return rounded(I.rolling_std(V.bars(spark, sf), 20).select(*BAR, "vol_20"), "vol_20")


@query
def bollinger(spark, sf):
    return _bollinger(spark, sf)


def _bollinger(spark, sf, **blocks):
    out = I.bollinger(V.bars(spark, sf), **blocks).select(*BAR, "bb_upper", "bb_lower")
    return rounded(out, "bb_upper", "bb_lower")


@query
def returns_target(spark, sf):
    out = I.target_direction(I.returns_1(V.bars(spark, sf)))
    return rounded(out.select(*BAR, "returns_1", "target_direction"), "returns_1", digits=8)


@query
def target_horizon_5(spark, sf):
    return _target_horizon_5(spark, sf)


def _target_horizon_5(spark, sf, **blocks):
    return I.target_direction(V.bars(spark, sf), horizon=5, **blocks).select(*BAR, "target_direction")


@query
def bfill_ffill(spark, sf):
    m = V.minute()
    holes = V.bars(spark, sf).withColumns({
        "open": F.when(m % 3 == 0, F.col("open")), "high": F.when(m % 7 == 0, F.col("high"))})
    return doubles(I.bfill_ffill(holes, ["open", "high"]).select(*BAR, "open", "high"))


@query
def ema(spark, sf):
    return _ema(spark, sf)


def _ema(spark, sf, **blocks):
    return rounded(R.ema(V.bars(spark, sf), 10, **blocks).select(*BAR, "ema_10"), "ema_10")


@query
def rsi(spark, sf):
    return _rsi(spark, sf)


def _rsi(spark, sf, **blocks):
    return rounded(R.rsi(V.bars(spark, sf), **blocks).select(*BAR, "rsi_14"), "rsi_14")


@query
def macd(spark, sf):
    return _macd(spark, sf)


def _macd(spark, sf, **blocks):
    names = ["macd", "macd_signal", "macd_hist"]
    return rounded(R.macd(V.bars(spark, sf), **blocks).select(*BAR, *names), *names)


@query
def ema_long_series(spark, sf):
    """Few keys, many rows: a 12-step average over every line item in ship order."""
    out = R.ema(V.lines(spark, sf), 12, series=V.LINE_SERIES)
    return rounded(out.select(*V.LINE_SERIES.keys, *V.LINE_SERIES.order, "ema_12"), "ema_12", digits=4)


@query
def sma_long_series(spark, sf):
    out = I.sma(V.lines(spark, sf), 20, series=V.LINE_SERIES)
    return rounded(out.select(*V.LINE_SERIES.keys, *V.LINE_SERIES.order, "sma_20"), "sma_20", digits=4)


@query
def build_features(spark, sf):
    return _build_features(spark, sf)


def _build_features(spark, sf, **blocks):
    return rounded(I.build_features(V.bars(spark, sf), **blocks), *FEATURE_COLUMNS, digits=8)


# --- model inputs -----------------------------------------------------------------------------

@query
def fit_scaler(spark, sf):
    stats = P.fit_scaler(features(spark, sf))
    return rounded(stats, *[c for c in stats.columns if not c.endswith("_odd")])


@query
def fit_scaler_zero_prices(spark, sf):
    """The scaler over features of bars of which some close at zero."""
    close = F.when(V.minute() % 50 == 0, F.lit(0)).otherwise(F.col("close")).cast("decimal(18,8)")
    stats = P.fit_scaler(I.build_features(V.bars(spark, sf).withColumn("close", close)))
    return rounded(stats, *[c for c in stats.columns if not c.endswith("_odd")], digits=5)


@query
def apply_scaler(spark, sf):
    rows = features(spark, sf)
    return rounded(P.apply_scaler(rows, P.fit_scaler(rows)).select(*BAR, *FEATURE_COLUMNS), *FEATURE_COLUMNS, digits=5)


@query
def sequences(spark, sf):
    return _sequences(spark, sf)


def _sequences(spark, sf, **blocks):
    """Sixty steps of all features."""
    out = P.sequences(features(spark, sf), **blocks)
    close = FEATURE_COLUMNS.index("close_float")
    total = F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda a, x: a + x)
    return rounded(out.select(
        *BAR, F.size("sequence").cast("long").alias("steps"), F.size(F.flatten("sequence")).cast("long").alias("cells"),
        F.element_at("sequence", 1)[close].alias("first_close"),
        F.element_at("sequence", -1)[close].alias("last_close"), total.alias("total"), F.col("label").cast("long").alias("label")),
        "total", digits=3)


# The same with series cut into blocks of a few hundred rows, so that halos and carries between blocks matter.
for _name, _made in {"sma": _sma, "bollinger": _bollinger, "ema": _ema, "rsi": _rsi, "macd": _macd, "sequences": _sequences,
                     "build_features": _build_features, "target_horizon_5": _target_horizon_5}.items():
    def _blocks(spark, sf, made=_made):
        return made(spark, sf, block_rows=500)

    _blocks.__name__ = f"{_name}_blocks"
    query(_blocks)


@query
def temporal_split(spark, sf):
    bars = V.bars(spark, sf).select(*BAR, "interval")
    train, test = P.temporal_split(bars)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def fingerprint(spark, sf):
    """Over all columns; amounts and times in the text that both engines write."""
    rows = V.table(spark, sf, "lineitem")
    kinds = {f.name: f.dataType.typeName() for f in rows.schema}
    return P.fingerprint(rows.withColumns({
        c: F.col(c).cast("decimal(18,2)") if k == "double" else F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        for c, k in kinds.items() if k == "double" or k.startswith("timestamp")}))


@query
def accuracy(spark, sf):
    """Guess that a bar goes on as it came: scores from its own move against the next one."""
    moved = I.target_direction(V.bars(spark, sf))
    rise = (F.col("close") - F.col("open")).cast("double")
    scored = moved.select(F.array(-rise, rise).alias("scores"), "target_direction")
    return rounded(P.accuracy(scored, "scores", "target_direction"), "accuracy")


# --- quality and metrics ----------------------------------------------------------------------

@query
def quality_checks(spark, sf):
    return Q.check(M.ohlcv(staged(spark, sf), "day"), Q.DAILY_RULES)


@query
def quality_models(spark, sf):
    """The rules of the other models: source bars, staging, hourly bars and returns."""
    bars = V.bars(spark, sf)
    staging = M.stg_klines(bars)
    checked = {
        "source": (bars, Q.SOURCE_RULES), "staging": (staging, Q.STAGING_RULES),
        "hourly": (M.ohlcv(staging, "hour"), Q.HOURLY_RULES),
        "returns": (M.log_returns(staging), Q.RETURNS_RULES),
    }
    parts = [Q.check(df, rules).withColumn("model", F.lit(name)) for name, (df, rules) in checked.items()]
    return reduce(DataFrame.unionByName, parts)


@query
def quality_failures(spark, sf):
    """The same kinds of rules on damaged and copied bars, where they fail."""
    typed = S.cast_prices(V.copied(spark, sf))
    keyed = typed.withColumn("bar_key", F.concat_ws("|", "symbol", "open_time"))
    return Q.check(keyed, Q.Rules(("open", "close"), ("bar_key",),
                                  {"high >= low": "high >= low", "volume >= 0": "volume >= 0"}))


@query
def metrics_daily(spark, sf):
    facts = M.ohlcv(staged(spark, sf), "day")
    return rounded(doubles(X.query(X.OHLCV_DAILY, facts, ["symbol", "trade_date"],
                                   list(X.DAILY.measures))), "avg_close", "total_volume", "total_quote_volume")


@query
def metrics_hourly(spark, sf):
    facts = M.ohlcv(staged(spark, sf), "hour")
    return rounded(doubles(X.query(X.OHLCV_HOURLY, facts, ["symbol", "hour_at"],
                                   list(X.HOURLY.measures))), "avg_close", "total_volume", "total_quote_volume")


@query
def metrics_returns(spark, sf):
    facts = M.log_returns(staged(spark, sf))
    out = X.query(X.PRICE_ANALYTICS, facts, ["symbol", "interval"], list(X.RETURNS.measures))
    return rounded(out, *X.RETURNS.measures, digits=8)


@query
def rollup_returns(spark, sf):
    """Hourly rollup of returns, read per symbol and day."""
    facts = M.log_returns(staged(spark, sf))
    rollup = X.build_rollup(facts, X.RETURNS_ROLLUP)
    out = X.query(X.PRICE_ANALYTICS, facts, ["symbol", "open_at"], list(X.RETURNS.measures), "day", (rollup,))
    return rounded(out, *X.RETURNS.measures, digits=8)


@query
def rollup_requery(spark, sf):
    """Hourly rollup of bars, read per symbol and week."""
    facts = M.ohlcv(staged(spark, sf), "hour")
    rollup = X.build_rollup(facts, X.HOURLY_ROLLUP)
    out = X.query(X.OHLCV_HOURLY, facts, ["symbol", "hour_at"], list(X.HOURLY.measures), "week", (rollup,))
    return rounded(doubles(out), "avg_close", "total_volume", "total_quote_volume")


@query
def rollup_daily(spark, sf):
    """Daily rollup of bars, read per symbol and week."""
    facts = M.ohlcv(staged(spark, sf), "day")
    rollup = X.build_rollup(facts, X.DAILY_ROLLUP)
    out = X.query(X.OHLCV_DAILY, facts, ["symbol", "trade_date"], list(X.DAILY.measures), "week", (rollup,))
    return rounded(doubles(out), "avg_close", "total_volume", "total_quote_volume").withColumn(
        "trade_date", F.col("trade_date").cast("date"))


@query
def export_views(spark, sf):
    """All views exported as CSV and the daily one read back as text."""
    folder = fresh_path(spark, "export")
    X.export_views(gold_facts(V.bars(spark, sf)), folder)
    return spark.read.option("header", True).csv(f"{folder}/fct_ohlcv_daily.csv").select(
        "symbol", "trade_date", F.col("total_trades").cast("long").alias("total_trades"),
        F.col("max_high").cast("double").alias("max_high"))


# --- lake -------------------------------------------------------------------------------------

@query
def bronze_roundtrip(spark, sf):
    path = fresh_path(spark, "bronze")
    sinks.write_bronze_klines(V.bronze(spark, sf), path)
    return lake.read_bronze_klines(spark, path)


@query
def silver_roundtrip(spark, sf):
    path = fresh_path(spark, "silver")
    kept, _ = S.to_silver(V.copied(spark, sf))
    sinks.write_silver(kept, path)
    return doubles(lake.read_silver_klines(spark, path))


@query
def live_to_silver(spark, sf):
    """Landed bar events and half of the history through the silver job; bars in both have the history's values."""
    landed, bronze, silver, bad = (fresh_path(spark, n) for n in ("landed", "bronze", "silver", "bad"))
    V.bar_events(spark, sf).write.parquet(landed)
    sinks.write_bronze_klines(V.bronze(spark, sf).filter(V.minute() % 2 == 0), bronze)
    run_silver(spark, bronze, silver, bad, live=landed)
    return doubles(lake.read_silver_klines(spark, silver))


@query
def scan_latest(spark, sf):
    """The newest version of bars of which the even minutes were loaded twice."""
    old = V.bars(spark, sf).withColumn("_loaded_at", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    new = old.filter(V.minute() % 2 == 0).withColumns({
        "close": (F.col("close") + 1).cast("decimal(18,8)"),
        "_loaded_at": F.lit("2024-02-02 00:00:00").cast("timestamp"),
    })
    return doubles(lake.scan_latest(new.unionByName(old)).select("symbol", "interval", "open_time", "close", "_loaded_at"))


@query
def features_roundtrip(spark, sf):
    path = fresh_path(spark, "features")
    sinks.write_features(features(spark, sf), path)
    return rounded(lake.read_features(spark, path), *FEATURE_COLUMNS, digits=8)


@query
def upsert_table(spark, sf):
    """Load all bars, then load the even minutes again with a later version."""
    path = fresh_path(spark, "serving")
    old = S.with_partitions(V.bars(spark, sf)).withColumn(
        "_loaded_at", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    new = old.filter(V.minute() % 2 == 0).withColumns({
        "close": (F.col("close") + 1).cast("decimal(18,8)"),
        "_loaded_at": F.lit("2024-02-02 00:00:00").cast("timestamp"),
    })
    for rows in (old, new, new):
        sinks.upsert_table(spark, rows, path, ["symbol", "year", "month"])
    stored = spark.read.schema(old.schema).parquet(path)
    return doubles(stored.select("symbol", "interval", "open_time", "close", "_loaded_at"))


# --- lineage ----------------------------------------------------------------------------------

def _graph(spark, sf):
    nodes, edges = L.stored_lineage(V.manifests(spark, sf), fresh_path(spark, "manifest"))
    customers = V.table(spark, sf, "customer").select(
        F.concat(F.lit("source.customer."), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_name").alias("name"), F.lit("topic").alias("type"), F.lit("lake").alias("layer"),
        F.lit("customer feed").alias("description"))
    return L.lineage_graph([(nodes, edges), (customers, None)])


@query
def manifest_lineage(spark, sf):
    nodes, edges = L.stored_lineage(V.manifests(spark, sf), fresh_path(spark, "manifest"))
    n = nodes.groupBy("id", "name", "type", "layer", "description").count()
    e = edges.groupBy("from_node", "to_node", "relationship").count()
    return n.select(F.lit("node").alias("kind"), "id", "name", F.col("type").alias("detail"), "count").unionByName(
        e.select(F.lit("edge").alias("kind"), F.col("from_node").alias("id"), F.col("to_node").alias("name"),
                 F.col("relationship").alias("detail"), "count")).withColumnRenamed("count", "copies")


@query
def lineage_graph(spark, sf):
    nodes, edges = _graph(spark, sf)
    return L.resolve_edges(edges, nodes)


@query
def lineage_events(spark, sf):
    nodes, edges = _graph(spark, sf)
    edge_text = F.concat_ws("|", "from_node", "to_node")
    return L.lineage_events(L.resolve_edges(edges, nodes), "market", F.lit("2024-01-01T00:00:00Z"),
                            F.md5(edge_text)).select("run_event", "lineage_request")


@query
def export_lineage(spark, sf):
    """Lineage written as JSON lines; nodes, edges and the bodies of the events read back."""
    nodes, edges = _graph(spark, sf)
    folder = fresh_path(spark, "lineage")
    edge_text = F.concat_ws("|", "from_node", "to_node")
    L.export_lineage(nodes, edges, folder, "market", event_time=F.lit("2024-01-01T00:00:00Z"), run_id=F.md5(edge_text))
    events = "from_node string, to_node string, relationship string, run_event string, lineage_request string"
    texts = F.concat_ws("|", "run_event", "lineage_request").alias("body")
    return (
        spark.read.schema(nodes.schema).json(f"{folder}/nodes").select(
            F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("name").alias("b"), F.concat_ws("|", "type", "layer", "description").alias("body"))
        .unionByName(spark.read.schema(edges.schema).json(f"{folder}/edges").select(
            F.lit("edge").alias("kind"), F.col("from_node").alias("a"), F.col("to_node").alias("b"), F.col("relationship").alias("body")))
        .unionByName(spark.read.schema(events).json(f"{folder}/events").select(
            F.lit("event").alias("kind"), F.col("from_node").alias("a"), F.col("to_node").alias("b"), texts)))

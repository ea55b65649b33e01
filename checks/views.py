"""Market data derived from the given tables: trades, bars and messages from ``events``,
one long series per flag pair from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.operators.series import Series
from tickframe.schemas import DECIMAL_COLUMNS, PRICE

LINE_SERIES = Series(
    keys=("symbol",),
    order=("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    cells=("unix_date(cast(l_shipdate AS date))", "l_orderkey div 1048576"),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ntz(df: DataFrame) -> DataFrame:
    """UTC timestamps without a zone, as the SQL side has them."""
    return df.withColumns({
        f.name: F.col(f.name).cast("timestamp_ntz")
        for f in df.schema if f.dataType.typeName() == "timestamp"
    })


def trades_of(events: DataFrame) -> DataFrame:
    """Events as trade rows, batch or stream."""
    k = F.get_json_object("props", "$.k").cast("int")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.select(
        F.lit("trade").alias("event_type"), at.alias("event_time"),
        F.col("event_type").alias("symbol"), F.col("event_id").alias("trade_id"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("price"),
        (k + 1).cast("string").alias("quantity"), at.alias("trade_time"),
        (k % 2 == 0).alias("is_buyer_maker"), F.col("ts").cast("timestamp").alias("ts"),
    )


def trades(spark: SparkSession, sf: str) -> DataFrame:
    return trades_of(table(spark, sf, "events"))


#: Days of events that come in one batch of a replayed stream.
BATCH_DAYS = 5


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Trades with the number of the batch they arrive in: most with their days, some one or two batches later, some
    twice, with the same time or a later one."""
    t = trades(spark, sf)
    day = F.expr("trade_time div 86400000")
    span = (day - F.lit(t.agg(F.min(day)).first()[0] or 0))
    i, batch = F.col("trade_id"), F.expr(f"CAST(_span div {BATCH_DAYS} AS INT)")
    first = t.withColumn("_span", span).withColumn(
        "batch", batch + F.when(i % 13 == 0, 1).when(i % 17 == 0, 2).otherwise(0)).drop("_span")
    hour = 3_600_000
    later = F.when(i % 11 == 0, 0).when(i % 19 == 0, hour).when(i % 23 == 0, 100 * hour)
    again = first.withColumn("later", later).filter("later IS NOT NULL").withColumns({
        "trade_time": F.col("trade_time") + F.col("later"), "batch": F.col("batch") + 1}).drop("later")
    return first.unionByName(again)


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """One-minute bars of the trades in the silver layout, without partition columns."""
    p, q = F.col("price").cast("decimal(18,2)"), F.col("quantity").cast("decimal(10,0)")
    buys = ~F.col("is_buyer_maker")
    start = F.expr("trade_time div 60000") * 60000
    zero = F.lit(0).cast("decimal(18,2)")
    out = (
        trades(spark, sf).groupBy("symbol", start.alias("open_time"))
        .agg(
            F.min_by(p, "ts").alias("open"), F.max(p).alias("high"), F.min(p).alias("low"),
            F.max_by(p, "ts").alias("close"), F.sum(q).alias("volume"),
            F.sum(p * q).alias("quote_volume"), F.count(F.lit(1)).alias("num_trades"),
            F.sum(F.when(buys, q).otherwise(zero)).alias("taker_buy_base_volume"),
            F.sum(F.when(buys, p * q).otherwise(zero)).alias("taker_buy_quote_volume"),
        )
    )
    close_time = F.col("open_time") + 59999
    return out.select(
        "symbol", F.lit("1m").alias("interval"), "open_time",
        *[F.col(c).cast(PRICE).alias(c) for c in DECIMAL_COLUMNS[:5]],
        close_time.alias("close_time"), F.col("quote_volume").cast(PRICE).alias("quote_volume"),
        "num_trades",
        *[F.col(c).cast(PRICE).alias(c) for c in DECIMAL_COLUMNS[6:]],
        F.timestamp_millis("open_time").alias("open_ts"), F.timestamp_millis(close_time).alias("close_ts"),
    )


def minute(column: str = "open_time"):
    return F.expr(f"{column} div 60000")


def bronze(spark: SparkSession, sf: str) -> DataFrame:
    """The bars as text, the way they land."""
    typed = bars(spark, sf).drop("open_ts", "close_ts")
    return typed.withColumns({c: F.col(c).cast("string") for c in DECIMAL_COLUMNS})


def damaged(spark: SparkSession, sf: str) -> DataFrame:
    """Bronze bars, some of which a rule makes invalid."""
    m = minute()
    return bronze(spark, sf).withColumns({
        "open": F.when(m % 17 != 0, F.col("open")),
        "volume": F.when(m % 19 == 0, F.concat(F.lit("-"), "volume")).otherwise(F.col("volume")),
        "close": F.when(m % 23 == 0, F.lit("abc")).otherwise(F.col("close")),
    })


def copied(spark: SparkSession, sf: str) -> DataFrame:
    """Damaged bars plus exact copies of a third and corrected copies of a fifth of them."""
    base, m = damaged(spark, sf), minute()
    later = base.filter(m % 5 == 0).withColumns({
        "close_time": F.col("close_time") + 1,
        "high": (F.col("high").cast(PRICE) + 1).cast(PRICE).cast("string"),
    })
    return base.unionByName(base.filter(m % 3 == 0)).unionByName(later)


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return messages_of(trades(spark, sf)).select("value")


def messages_of(t: DataFrame) -> DataFrame:
    """Raw message text per trade, with its topic: trades and bars in short and long spelling, some in an
    envelope, some malformed, some of other types and some no JSON at all."""
    kind, bad = F.col("trade_id") % 5, F.col("trade_id") % 17 == 0
    maker = F.col("is_buyer_maker").cast("string")

    def joined(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    c = {n: F.col(n) for n in t.columns}
    price = F.when(bad, F.lit("")).otherwise(joined('"p":"', c["price"], '",'))
    long_price = F.when(bad, F.lit("")).otherwise(joined('"price":"', c["price"], '",'))
    open_price = F.when(bad, F.lit("")).otherwise(joined('"o":"', c["price"], '",'))
    short = joined('{"e":"trade","E":', c["event_time"], ',"s":"', c["symbol"], '","t":', c["trade_id"],
                   ',', price, '"q":"', c["quantity"], '","T":', c["trade_time"], ',"m":', maker, '}')
    wrapped = joined('{"stream":"x","data":', short, '}')
    long = joined('{"event_type":"trade","event_time":', c["event_time"], ',"symbol":"', c["symbol"],
                  '","trade_id":', c["trade_id"], ',', long_price, '"quantity":"', c["quantity"],
                  '","trade_time":', c["trade_time"], ',"is_buyer_maker":', maker, '}')
    opened = F.expr("trade_time div 60000") * 60000
    bar = joined('{"e":"kline","E":', c["event_time"], ',"s":"', c["symbol"], '","k":{"t":', opened,
                 ',"T":', opened + 59999, ',"s":"', c["symbol"], '","i":"1m",', open_price, '"c":"',
                 c["price"], '","h":"', c["price"], '","l":"', c["price"], '","v":"', c["quantity"],
                 '","n":1,"x":', maker, ',"q":"1"}}')
    other = F.when(bad, F.lit("no json")).otherwise(F.lit('{"e":"depth","E":1}'))
    text = (F.when(kind == 0, wrapped).when(kind == 1, short).when(kind == 2, long)
            .when(kind == 3, bar).otherwise(other))
    topic = F.when(kind < 3, "trades").when(kind == 3, "klines").otherwise("other")
    return t.select(topic.alias("topic"), text.alias("value"), "trade_time")


def bar_events(spark: SparkSession, sf: str) -> DataFrame:
    """The bronze bars as nested live events; every fourth minute is still open."""
    b = bronze(spark, sf)
    k = F.struct(
        "open_time", "close_time", "symbol", "interval", "open", "close", "high", "low", "volume",
        F.col("num_trades").alias("number_of_trades"), (minute() % 4 != 0).alias("is_closed"),
        "quote_volume",
    )
    return b.select(F.lit("kline").alias("event_type"), F.col("close_time").alias("event_time"),
                    "symbol", k.alias("kline"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """History pages: the bars of at most 1000 minutes each as one JSON text; by a rule some rows
    are cut short and some hold a price that is no number."""
    b, m = bronze(spark, sf), minute()
    q = F.lit('"')
    cells = F.concat_ws(
        ",", F.col("open_time").cast("string"),
        F.when(m % 29 == 0, F.lit('"bad"')).otherwise(F.concat(q, "open", q)),
        *[F.concat(q, c, q) for c in ("high", "low", "close", "volume")],
        F.col("close_time").cast("string"), F.concat(q, "quote_volume", q),
        F.col("num_trades").cast("string"), F.concat(q, "taker_buy_base_volume", q),
        F.concat(q, "taker_buy_quote_volume", q), F.lit('"0"'),
    )
    row = F.when(m % 17 == 0, F.concat(F.lit("["), F.col("open_time").cast("string"), F.lit(',"bad"]'))
                 ).otherwise(F.concat(F.lit("["), cells, F.lit("]")))
    listed = F.array_sort(F.collect_list(F.struct("open_time", row.alias("row"))))
    return b.groupBy("symbol", "interval", F.expr("open_time div 60000000").alias("page")).agg(
        F.concat(F.lit("["), F.concat_ws(",", listed["row"]), F.lit("]")).alias("payload"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as long price series, one per flag pair."""
    return table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        *LINE_SERIES.order, F.col("l_extendedprice").alias("close"), "l_quantity",
    )


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    """One model manifest per order: a model that depends on its priority and its customer."""
    o = table(spark, sf, "orders")
    order, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    priority = F.concat(F.lit("source.priority."), "o_orderpriority")
    parents = F.struct(F.array(priority, F.concat(F.lit("source.customer."), customer)).alias("nodes"))
    schema = F.when(F.col("o_orderkey") % 2 == 0, F.lit("silver")).alias("schema")
    model = F.struct(F.lit("model").alias("resource_type"), F.concat(F.lit("order_"), order).alias("name"),
                     schema, parents.alias("depends_on"))
    test = F.struct(F.lit("test").alias("resource_type"), F.lit("t").alias("name"),
                    schema, parents.alias("depends_on"))
    nodes = F.create_map(F.concat(F.lit("model.order."), order), model,
                         F.concat(F.lit("test.order."), order), test)
    source = F.struct(F.lit("raw").alias("schema"), F.col("o_orderpriority").alias("name"))
    sources = F.create_map(priority, source)
    return o.select(F.to_json(F.struct(nodes.alias("nodes"), sources.alias("sources"))).alias("manifest"))

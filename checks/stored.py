"""Queries of tables that are kept and refreshed: rollups and what is answered from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from checks import views as V
from checks.oracles import DAILY, FEATURE_NAMES, FEATURES, HOURLY, RETURNS, SERIES, STAGED, _frame
from checks.queries import doubles, features, query, rounded, staged
from tickframe.operators import indicators as I
from tickframe.operators import marts as M
from tickframe.operators import silver as S
from tickframe.plans import metrics as X
from tickframe.plans import rollups as R
from tickframe.plans.jobs import gold_facts, run_features, run_silver
from tickframe.plans.model_input import ModelInput
from tickframe.schemas import FEATURE_COLUMNS, SILVER_KLINE
from tickframe.session import fresh_path
from tickframe.sources import lake, sinks
from tickframe.sources.keyed import KeyedTable

#: Until when the first load reaches, and until when the stored rollups are complete.
FIRST, UPTO = datetime(2024, 1, 12), datetime(2024, 1, 21)


def _spans(facts, time):
    """Facts before the first bound, and from there to the second."""
    at = F.col(time).cast("timestamp")
    return facts.filter(at < F.lit(FIRST)), facts.filter((at >= F.lit(FIRST)) & (at < F.lit(UPTO)))


@query
def rollup_stored(spark, sf):
    """Hourly returns stored in three loads, one of which is repeated and one adds to stored days; read per symbol and day."""
    facts = M.log_returns(staged(spark, sf))
    odd = F.minute("open_at") % 2 == 1
    store = R.RollupStore(spark, fresh_path(spark, "rollup"), X.RETURNS_ROLLUP)
    early = F.col("open_at") < F.lit(FIRST)
    store.load(facts.filter(early & odd), "first")
    store.load(facts.filter(~early), "second")
    store.load(facts.filter(early & ~odd), "rest of first")
    store.load(facts.filter(~early), "second")
    store.compact()
    out = X.query(X.PRICE_ANALYTICS, facts, ["symbol", "open_at"], list(X.RETURNS.measures), "day",
                  (X.Rollup(X.RETURNS_ROLLUP, store.states()),))
    return rounded(out, *X.RETURNS.measures, digits=8)


@query
def rollup_hybrid(spark, sf):
    """Returns per symbol and day: complete days from the stored rollup, the last ones from the bars."""
    facts = M.log_returns(staged(spark, sf))
    stores = []
    for spec in (X.RETURNS_ROLLUP, X.RETURNS_DAILY_ROLLUP):
        store = R.RollupStore(spark, fresh_path(spark, "rollup"), spec)
        first, second = _spans(facts, "open_at")
        store.load(first, "first", upto=FIRST)
        store.load(second, "second", upto=UPTO)
        stores.append(store)
    out = R.answer(X.PRICE_ANALYTICS, stores, facts, ["symbol", "open_at"], list(X.RETURNS.measures), "day")
    return rounded(out, *X.RETURNS.measures, digits=8)


@query
def rollup_hybrid_hours(spark, sf):
    """Hourly bars per symbol and hour from the stored hours and the bars after them."""
    facts = M.ohlcv(staged(spark, sf), "hour")
    store = R.RollupStore(spark, fresh_path(spark, "rollup"), X.HOURLY_ROLLUP)
    for name, rows, upto in zip(("first", "second"), _spans(facts, "hour_at"), (FIRST, UPTO)):
        store.load(rows, name, upto)
    out = R.answer(X.OHLCV_HOURLY, [store], facts, ["symbol", "hour_at"], list(X.HOURLY.measures), "hour")
    return rounded(doubles(out), "avg_close", "total_volume", "total_quote_volume")


@query
def upsert_atomic(spark, sf):
    """Load all bars, fail in the middle of a load, load the even minutes with a later version, and that once more."""
    old = S.with_partitions(V.bars(spark, sf)).withColumn("_loaded_at", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    even = old.filter(V.minute() % 2 == 0)
    new = even.withColumns({
        "close": (F.col("close") + 1).cast("decimal(18,8)"), "_loaded_at": F.lit("2024-02-02 00:00:00").cast("timestamp")})
    broken = new.withColumn("close", F.when(V.minute() % 20 == 0, F.raise_error(F.lit("cut off")).cast("decimal(18,8)")).otherwise(F.col("close")))
    store = KeyedTable(spark, fresh_path(spark, "serving"), old.schema, ["symbol", "year", "month"])
    store.load(old, "old")
    try:
        store.load(broken, "new")
    except PySparkException:
        pass
    before = store.read().agg(F.max("_loaded_at").alias("seen"))
    if before.first()["seen"].day != 1:
        raise AssertionError("a load that failed has left rows")
    for _ in range(2):
        store.load(new, "new")
    store.vacuum()
    return doubles(store.read().select("symbol", "interval", "open_time", "close", "_loaded_at"))


@query
def silver_metrics_stored(spark, sf):
    """The counts that the silver job gives of damaged and copied bars, from the footers of what it has written."""
    bronze, silver, bad = (fresh_path(spark, n) for n in ("bronze", "silver", "bad"))
    sinks.write_bronze_klines(V.copied(spark, sf), bronze)
    counts = run_silver(spark, bronze, silver, bad)
    stored = spark.read.schema(SILVER_KLINE).parquet(silver)
    if (stored.count(), spark.read.parquet(bad).count()) != (counts["kept"], counts["rejected"]):
        raise AssertionError("the counts are not those of the stored rows")
    return spark.createDataFrame([counts], "raw long, rejected long, kept long, duplicates long")


@query
def features_from_silver(spark, sf):
    """Features by the job, from stored silver bars to the stored feature table."""
    silver, gold = fresh_path(spark, "silver"), fresh_path(spark, "features")
    sinks.write_silver(S.with_partitions(V.bars(spark, sf)), silver)
    run_features(spark, silver, gold)
    return rounded(lake.read_features(spark, gold), *FEATURE_COLUMNS, digits=8)


@query
def model_input(spark, sf):
    """Sequences of all features, scaled by the moments of three updates of which the last brings a symbol again."""
    rows = features(spark, sf)
    store = ModelInput(spark, fresh_path(spark, "model"))
    early = F.col("symbol").isin("click", "view")
    store.update(rows.filter(early).withColumn("close_float", F.col("close_float") + 1))
    store.update(rows.filter(~early))
    store.update(rows.filter(early))
    total = F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda a, x: a + x)
    return rounded(store.read().select(
        "symbol", "open_time", "part", F.size(F.flatten("sequence")).cast("long").alias("cells"), total.alias("total"), "label"), "total", digits=4)


@query
def export_roundtrip(spark, sf):
    """All views exported as CSV and read back, every measure of every row; times are compared as they are written."""
    folder = fresh_path(spark, "export")
    X.export_views(gold_facts(V.bars(spark, sf)), folder)
    parts = []
    for view, dims in X.EXPORTS:
        rows = spark.read.option("header", True).csv(f"{folder}/fct_{view.name}.csv")
        at = dims[-1]
        measures = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m).cast("double"), 6).alias("value"))
                                       for m in view.cube.measures]))
        parts.append(rows.select(F.lit(view.name).alias("view"), "symbol", F.col(at).alias("at"), measures.alias("m")).select(
            "view", "symbol", "at", "m.*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _two_intervals(spark, sf):
    """The bars of one minute, and bars of five minutes that begin at the same times and close one higher."""
    one = V.bars(spark, sf)
    return one.unionByName(one.withColumns({"interval": F.lit("5m"), "close": (F.col("close") + 1).cast("decimal(18,8)")}))


@query
def ohlcv_two_intervals(spark, sf):
    """Daily bars come of the one-minute bars alone."""
    return doubles(M.ohlcv(M.stg_klines(_two_intervals(spark, sf)), "day"))


@query
def sma_two_intervals(spark, sf):
    """Each interval of a symbol is a series of its own."""
    return rounded(I.sma(_two_intervals(spark, sf), 20).select("symbol", "interval", "open_time", "sma_20"), "sma_20", digits=8)


def _export_sql() -> str:
    columns = {"total_volume": "volume", "total_quote_volume": "quote_volume", "total_trades": "num_trades", "avg_close": "close",
               "max_high": "high", "min_low": "low"}
    text = "strftime({}, '%Y-%m-%d %H:%M:%S.%g')"

    def rows(view: str, source: str, at: str, measures: dict[str, str]) -> str:
        return " UNION ALL ".join(f"SELECT '{view}' AS view, symbol, {at} AS at, '{m}' AS measure, round(CAST({c} AS DOUBLE), 6) AS value FROM {source}"
                                  for m, c in measures.items())

    return "WITH " + STAGED + f""", d AS ({DAILY}), h AS ({HOURLY}), r AS ({RETURNS})
      {rows('ohlcv_daily', 'd', "CAST(trade_date AS VARCHAR)", columns)}
      UNION ALL {rows('ohlcv_hourly', 'h', text.format('hour_at'), columns)}
      UNION ALL {rows('price_analytics', 'r', text.format('open_at'), {'avg_log_return': 'log_return', 'stddev_log_return': 'NULL'})}"""


def _model_sql() -> str:
    stats = ", ".join(f"avg({c}) FILTER (isfinite({c})) AS {c}_mean, stddev_samp({c}) FILTER (isfinite({c})) AS {c}_std" for c in FEATURE_NAMES)
    step = " + ".join(f"({c} - {c}_mean) / CASE WHEN {c}_std > 0 THEN {c}_std ELSE 1 END" for c in FEATURE_NAMES)
    return FEATURES + f""",
      sc AS (SELECT {stats} FROM feats),
      z AS (SELECT symbol, open_time, target_direction AS label, {step} AS t, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS rn,
                   count(*) OVER (PARTITION BY symbol) AS n FROM feats, sc),
      sq AS (SELECT *, sum(t) OVER {_frame(60)} AS total FROM z),
      kept AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS k, count(*) OVER (PARTITION BY symbol) AS m
               FROM sq WHERE rn >= 60 AND rn < n)
      SELECT symbol, open_time, CASE WHEN k <= floor(0.8 * m) THEN 'train' ELSE 'test' END AS part,
             CAST({60 * len(FEATURE_NAMES)} AS BIGINT) AS cells, round(total, 4) AS total, CAST(label AS BIGINT) AS label FROM kept"""


def oracles(known: dict[str, str]) -> dict[str, str]:
    """How an answer is stored does not change it."""
    return {"rollup_stored": known["rollup_returns"], "rollup_hybrid": known["rollup_returns"],
            "rollup_hybrid_hours": known["metrics_hourly"], "upsert_atomic": known["upsert_table"],
            "silver_metrics_stored": known["silver_metrics"], "features_from_silver": known["features_roundtrip"],
            "model_input": _model_sql(), "export_roundtrip": _export_sql(),
            "ohlcv_two_intervals": known["ohlcv_daily"], "sma_two_intervals": "WITH " + SERIES + f"""
              SELECT symbol, i AS "interval", open_time, round(avg(x + up) OVER (PARTITION BY symbol, i ORDER BY open_time
                ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 8) AS sma_20 FROM s, (VALUES ('1m', 0), ('5m', 1)) v(i, up)"""}

import glob
import hashlib
import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from samples import BAR_1, BAR_2, H, bronze
from tickframe.functions import columns as C
from tickframe.operators import marts as M
from tickframe.operators import quality as Q
from tickframe.operators.silver import to_silver
from tickframe.plans import jobs
from tickframe.plans import metrics as X
from tickframe.schemas import KLINE_COLUMNS
from tickframe.sources import lake, sinks


def minute_bars(spark, *bars):
    """(symbol, minute, open, high, low, close, volume) as silver bars."""
    rows = [(s, "1m", H + m * 60000, str(o), str(h), str(lo), str(c), str(v), H + m * 60000 + 59999,
             str(c * v), 2, "0", "0") for s, m, o, h, lo, c, v in bars]
    return to_silver(bronze(spark, *rows))[0]


BARS = [("A", 0, 10, 12, 9, 11, 1), ("A", 1, 11, 15, 10, 14, 2), ("A", 61, 14, 14, 8, 9, 3),
        ("A", 1440, 9, 10, 9, 10, 4), ("B", 5, 1, 1, 1, 1, 5)]


def test_surrogate_key_text(spark):
    row = spark.sql("SELECT 'a' x, CAST(NULL AS STRING) y, TIMESTAMP '2024-01-01 00:00:00' t").select(
        C.surrogate_key("x", "y", C.ts_text("t")).alias("k")).first()
    want = "a-_dbt_utils_surrogate_key_null_-2024-01-01 00:00:00.000"
    assert row.k == hashlib.md5(want.encode()).hexdigest()


def test_daily_and_hourly(spark):
    staged = M.stg_klines(minute_bars(spark, *BARS))
    daily = {(r.symbol, r.trade_date): r for r in M.ohlcv(staged, "day").collect()}
    first = daily["A", date(2024, 1, 1)]
    assert [float(first[c]) for c in ("open", "high", "low", "close", "volume")] == [10, 15, 8, 9, 6]
    assert float(first.quote_volume) == 66 and first.num_trades == 6 and len(daily) == 3
    hourly = M.ohlcv(staged, "hour").filter("symbol = 'A'").orderBy("hour_at").collect()
    assert [r.hour_at for r in hourly] == [datetime(2024, 1, 1, 0), datetime(2024, 1, 1, 1), datetime(2024, 1, 2, 0)]
    assert M.ohlcv(staged, "day", interval="1h").count() == 0
    with pytest.raises(ValueError):
        M.ohlcv(staged, "week")


def test_log_returns(spark):
    rows = M.log_returns(M.stg_klines(minute_bars(spark, *BARS))).filter("symbol = 'A'").orderBy("open_at").collect()
    assert rows[0].log_return is None
    assert [r.log_return for r in rows[1:]] == pytest.approx([math.log(14 / 11), math.log(9 / 14), math.log(10 / 9)])


def test_zero_previous_close_gives_null(spark):
    bars = minute_bars(spark, ("A", 0, 1, 1, 0, 0, 1), ("A", 1, 1, 1, 1, 1, 1))
    assert {r.log_return for r in M.log_returns(M.stg_klines(bars)).collect()} == {None}


def test_zero_close_is_minus_infinity(spark):
    bars = minute_bars(spark, ("A", 0, 1, 1, 1, 1, 1), ("A", 1, 1, 1, 0, 0, 1))
    assert [r.log_return for r in M.log_returns(M.stg_klines(bars)).orderBy("open_at").collect()] == [None, -math.inf]


def test_log_steps_around_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (0.0, 1.0), (2.0, 1.0), (1.0, None)], "x double, p double")
    got = [r.s for r in df.select(C.log_step(F.col("x"), F.col("p")).alias("s")).collect()]
    assert got == [0.0, 0.0, 0.0, pytest.approx(math.log(2)), 0.0]


def test_day_aggregation_combines_before_the_shuffle(spark):
    plan = M.ohlcv(M.stg_klines(minute_bars(spark, *BARS)), "day")._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "SortAggregate" not in plan


def test_interval_and_symbol_reach_the_folders(spark, tmp_path):
    path = str(tmp_path / "silver")
    sinks.write_silver(minute_bars(spark, *BARS), path)
    bars = spark.read.parquet(path).withColumn("_loaded_at", F.lit(1))
    plan = M.ohlcv(M.stg_klines(lake.scan_latest(bars)), "day").filter("symbol = 'A'")
    text = plan._jdf.queryExecution().executedPlan().toString()
    filters = text.split("PartitionFilters: [")[1].split("]")[0]
    assert "symbol" in filters and "interval" in filters


def test_rules_on_good_and_bad_facts(spark, rows):
    good = M.ohlcv(M.stg_klines(minute_bars(spark, *BARS)), "day")
    assert {r.failures for r in Q.check(good, Q.DAILY_RULES).collect()} == {0}
    bad = spark.createDataFrame([("k", 1.0, 2.0), ("k", None, 2.0), (None, 3.0, 2.0)], "id string, high double, low double")
    rules = Q.Rules(("id",), ("id",), {"high >= low": "high >= low"})
    assert rows(Q.check(bad, rules)) == [("holds", "high >= low", 1), ("not_null", "id", 1), ("unique", "id", 1)]
    strict = Q.Rules((), (), {"x": "high >= low"}, null_passes=False)
    assert rows(Q.check(bad, strict)) == [("holds", "x", 2)]


def test_view_query_and_unknown_member(spark, rows):
    facts = M.ohlcv(M.stg_klines(minute_bars(spark, *BARS)), "day")
    got = X.query(X.OHLCV_DAILY, facts, ["symbol"], ["total_trades", "avg_close", "max_high", "min_low"])
    assert [(s, n, float(a), float(h), float(lo)) for s, n, a, h, lo in rows(got)] == [
        ("A", 8, 9.5, 15.0, 8.0), ("B", 2, 1.0, 1.0, 1.0)]
    with pytest.raises(X.UnknownMember):
        X.query(X.OHLCV_DAILY, facts, ["symbol"], ["nothing"])
    with pytest.raises(X.UnknownMember):
        X.query(X.PRICE_ANALYTICS, facts, ["hour_at"], [])


@pytest.mark.parametrize("granularity", ["hour", "day", "month"])
def test_rollup_answers_like_the_facts(spark, granularity):
    returns = M.log_returns(M.stg_klines(minute_bars(
        spark, *[("A", m * 7, 5, 9, 1, 2 + (m * m) % 13, 1) for m in range(300)])))
    rollup = X.build_rollup(returns, X.RETURNS_ROLLUP)
    ask = (X.PRICE_ANALYTICS, returns, ["symbol", "open_at"], list(X.RETURNS.measures), granularity)
    stored, direct = X.query(*ask, (rollup,)), X.query(*ask)
    key = lambda r: r.open_at
    for a, b in zip(sorted(stored.collect(), key=key), sorted(direct.collect(), key=key), strict=True):
        assert a.open_at == b.open_at
        assert a.avg_log_return == pytest.approx(b.avg_log_return)
        assert a.stddev_log_return == pytest.approx(b.stddev_log_return)


def test_rollup_is_chosen_only_when_it_can_answer(spark):
    facts = M.ohlcv(M.stg_klines(minute_bars(spark, *BARS)), "day")
    empty = X.Rollup(X.DAILY_ROLLUP, X.rollup_table(facts, X.DAILY_ROLLUP).limit(0))
    served = X.query(X.OHLCV_DAILY, facts, ["symbol"], ["total_trades"], rollups=(empty,))
    assert served.count() == 0
    assert X.query(X.OHLCV_DAILY, facts, ["open"], ["total_trades"], rollups=(empty,)).count() > 0
    assert X.query(X.OHLCV_DAILY, facts, ["trade_date"], ["total_trades"], "hour", (empty,)).count() > 0


def test_prefix_is_dropped(spark):
    df = spark.createDataFrame([(1, 2)], "`ohlcv_daily.symbol` int, `ohlcv_daily.total_volume` int")
    assert X.without_prefix(df, X.OHLCV_DAILY).columns == ["symbol", "total_volume"]


def test_export_one_csv_per_view(spark, tmp_path):
    facts = jobs.gold_facts(minute_bars(spark, *BARS))
    paths = jobs.run_export(facts, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in paths] == [
        "fct_ohlcv_daily.csv", "fct_ohlcv_hourly.csv", "fct_price_analytics.csv"]
    back = spark.read.option("header", True).csv(paths[0])
    assert back.columns == ["symbol", "trade_date", *X.DAILY.measures]
    assert {r.trade_date for r in back.collect()} == {"2024-01-01", "2024-01-02"}


def test_empty_export_has_a_header(spark, tmp_path):
    path = sinks.export_csv(spark.createDataFrame([], "a int, b int"), str(tmp_path), "none")
    parts = glob.glob(f"{path}/part-*")
    assert len(parts) == 1 and open(parts[0]).read().strip() == "a,b"


def test_models_become_tables_and_views(spark):
    facts = jobs.build_gold(minute_bars(spark, *BARS))
    assert facts["fct_daily_klines"].count() == 3
    sinks.materialize(facts["fct_daily_klines"], "daily_view")
    assert spark.table("daily_view").count() == 3
    with pytest.raises(ValueError):
        sinks.materialize(facts["fct_daily_klines"], "x", "cache")


def test_feature_job_writes_by_symbol(spark, tmp_path):
    silver, gold = str(tmp_path / "s"), str(tmp_path / "g")
    sinks.write_silver(minute_bars(spark, *BARS), silver)
    jobs.run_features(spark, silver, gold)
    back = lake.read_features(spark, gold)
    assert back.count() == 5 and back.schema["volume"].dataType.typeName() == "double"
    assert sorted(p.rsplit("/", 1)[1] for p in glob.glob(f"{gold}/symbol=*")) == ["symbol=A", "symbol=B"]

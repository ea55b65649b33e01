import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from samples import H, ema_loop, macd_loop, rsi_loop, series, walk
from tickframe.operators import indicators as I
from tickframe.operators import recurrences as R
from tickframe.operators import series as Z

# Cells of 8 bars and blocks of 16 to 40 rows, so that short inputs cross many borders.
SMALL = Z.Series(cells=(Z.bar_cell(8),))
GAPS = {5: 40, 6: 100, 33: 7, 90: 5000}


def data(spark, n=203):
    return series(spark, {"A": walk(n), "B": walk(61, 7), "C": walk(3, 1), "D": [5.0]}, gaps=GAPS)


def by_symbol(df, *columns):
    out = {}
    for r in df.orderBy("symbol", "open_time").collect():
        out.setdefault(r.symbol, []).append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return out


def close_to(got, want, tol=1e-9):
    assert got.keys() == want.keys()
    for k in got:
        np.testing.assert_allclose(np.array(got[k], float), np.array(want[k], float), rtol=0, atol=tol)


def closes(df):
    return by_symbol(df, "close")


def test_positions_count_every_row(spark):
    out = by_symbol(Z.positions(data(spark), SMALL), "_pos", "_len")
    assert {k: len(v) for k, v in out.items()} == {"A": 203, "B": 61, "C": 3, "D": 1}
    for v in out.values():
        assert v == [(i, len(v)) for i in range(len(v))]


@pytest.mark.parametrize("block", [1, 3, 16, 1000])
def test_blocks_hold_their_neighbours(spark, block):
    cut = Z.blocks(data(spark), SMALL, before=5, after=2, block_rows=block)
    seen = {}
    for r in cut.collect():
        seen.setdefault((r.symbol, r._block), set()).add(r._pos)
        length = r._len
        seen.setdefault((r.symbol, "len"), length)
    for (symbol, b), have in seen.items():
        if b != "len":
            n = seen[symbol, "len"]
            assert have == set(range(max(0, b * block - 5), min(n, (b + 1) * block + 2)))
    assert Z.own_rows(cut, block).count() == 268


@pytest.mark.parametrize("block", [2, 16, 1000])
def test_frames_match_plain_windows(spark, block):
    df = data(spark)
    w = Window.partitionBy("symbol").orderBy("open_time")
    want = df.withColumns({
        "sma_20": F.avg("close").over(w.rowsBetween(-19, 0)),
        "vol_20": F.coalesce(F.stddev("close").over(w.rowsBetween(-19, 0)), F.lit(0.0)),
        "up": F.avg("close").over(w.rowsBetween(-19, 0)) + 2 * F.stddev_pop("close").over(w.rowsBetween(-19, 0)),
    })
    got = I.sma(I.rolling_std(I.bollinger(df, series=SMALL, block_rows=block), series=SMALL, block_rows=block),
                20, series=SMALL, block_rows=block)
    close_to(by_symbol(got, "sma_20"), by_symbol(want, "sma_20"))
    close_to(by_symbol(got, "vol_20"), by_symbol(want, "vol_20"))
    close_to(by_symbol(got, "bb_upper"), by_symbol(want, "up"))
    assert set(got.columns) == {*df.columns, "sma_20", "vol_20", "bb_upper", "bb_lower"}


def test_returns_and_targets(spark):
    df = data(spark)
    got = by_symbol(I.target_direction(I.returns_1(df, series=SMALL), series=SMALL), "returns_1", "target_direction")
    for symbol, x in closes(df).items():
        want = [(0.0 if i == 0 else math.log(x[i] / x[i - 1]), int(i + 1 < len(x) and x[i + 1] > x[i]))
                for i in range(len(x))]
        np.testing.assert_allclose(got[symbol], want, atol=1e-12)
    far = by_symbol(I.target_direction(df, horizon=4, series=SMALL, block_rows=9), "target_direction")
    for symbol, x in closes(df).items():
        assert far[symbol] == [int(i + 4 < len(x) and x[i + 4] > x[i]) for i in range(len(x))]


def test_null_values_stay_neighbours(spark):
    df = data(spark).withColumn("close", F.when(F.col("open_time") % 180000 != 0, F.col("close")))
    w = Window.partitionBy("symbol").orderBy("open_time")
    want = df.withColumns({"p": F.lag("close").over(w), "f": F.lead("close").over(w)})
    got = Z.neighbours(df, "close", SMALL, previous="p", following="f")
    assert by_symbol(got, "p", "f") == by_symbol(want, "p", "f")


def test_fill_gaps_backward_then_forward(spark):
    df = data(spark).withColumn("close", F.when(F.col("open_time") % 780000 == 0, F.col("close")))
    got = by_symbol(I.bfill_ffill(df, ["close"], SMALL), "close")
    for symbol, x in closes(df).items():
        filled = list(x)
        for i in reversed(range(len(x) - 1)):
            filled[i] = filled[i + 1] if filled[i] is None else filled[i]
        for i in range(1, len(x)):
            filled[i] = filled[i - 1] if filled[i] is None else filled[i]
        assert got[symbol] == filled


@pytest.mark.parametrize("block", [1, 16, 40, 1000])
def test_ema_matches_the_loop(spark, block):
    df = data(spark)
    got = by_symbol(R.ema(df, 10, series=SMALL, block_rows=block), "ema_10")
    close_to(got, {k: ema_loop(v, 10) for k, v in closes(df).items()})


@pytest.mark.parametrize("block", [15, 40, 1000])
def test_rsi_and_macd_match_the_loops(spark, block):
    df = data(spark)
    x = closes(df)
    close_to(by_symbol(R.rsi(df, series=SMALL, block_rows=block), "rsi_14"), {k: rsi_loop(v) for k, v in x.items()})
    got = by_symbol(R.macd(df, series=SMALL, block_rows=block), "macd", "macd_signal", "macd_hist")
    want = {}
    for k, v in x.items():
        line, trigger = macd_loop(v)
        want[k] = [(a, b, a - b) for a, b in zip(line, trigger)]
    close_to(got, want)


def test_flat_stretches_keep_their_strength(spark):
    """After a move a flat price leaves both averages shrinking alike: RSI must not jump to 100."""
    x = [100.0 + (-1) ** i for i in range(40)] + [100.0] * 160
    got = by_symbol(R.rsi(series(spark, {"A": x}), series=SMALL, block_rows=20), "rsi_14")["A"]
    np.testing.assert_allclose(got, rsi_loop(x), atol=1e-8)
    assert max(got[60:]) < 99
    rising = by_symbol(R.rsi(series(spark, {"A": [float(i) for i in range(60)]}), series=SMALL, block_rows=20),
                       "rsi_14")["A"]
    assert rising[:14] == [50.0] * 14 and rising[14:] == [100.0] * 46


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0.5, 1e6), min_size=1, max_size=80), st.integers(15, 50))
def test_any_prices_any_block(spark, prices, block):
    df = series(spark, {"A": prices})
    scale = max(prices)
    np.testing.assert_allclose(
        by_symbol(R.ema(df, 5, series=SMALL, block_rows=block), "ema_5")["A"], ema_loop(prices, 5), atol=1e-9 * scale)
    np.testing.assert_allclose(
        by_symbol(R.rsi(df, series=SMALL, block_rows=block), "rsi_14")["A"], rsi_loop(prices), atol=1e-6)


def test_other_columns_pass_through_scans(spark):
    df = data(spark).withColumns({
        "ts": F.timestamp_millis("open_time"), "amount": F.col("close").cast("decimal(18,8)"), "note": F.lit("n")})
    out = R.ema(df, 5, series=SMALL, block_rows=16)
    assert out.schema[:-1] == df.schema
    keep = ["symbol", "open_time", "ts", "amount", "note"]
    assert sorted(out.select(keep).collect()) == sorted(df.select(keep).collect())


def test_intervals_are_separate_series(spark):
    one = series(spark, {"A": walk(30)})
    hour = series(spark, {"A": walk(30, 5)}, interval="1h", step=3600000)
    out = R.ema(one.unionByName(hour), 10, series=SMALL, block_rows=16)
    for interval, seed in (("1m", 42), ("1h", 5)):
        got = [r.ema_10 for r in out.filter(F.col("interval") == interval).orderBy("open_time").collect()]
        np.testing.assert_allclose(got, ema_loop(walk(30, seed), 10), atol=1e-9)


def test_period_must_fit_a_block(spark):
    with pytest.raises(ValueError):
        R.rsi(data(spark), 14, block_rows=14)


def test_features_of_small_blocks_equal_one_block(spark):
    df = data(spark)
    names = ["sma_20", "sma_50", "vol_20", "rsi_14", "macd", "macd_signal", "bb_upper", "bb_lower",
             "returns_1", "target_direction"]
    df = df.withColumn("volume", F.col("volume").cast("decimal(18,8)"))
    small = by_symbol(I.build_features(df, series=SMALL, block_rows=20), *names)
    whole = by_symbol(I.build_features(df, block_rows=100000), *names)
    close_to(small, whole)
    x = closes(df)["A"]
    np.testing.assert_allclose([v[3] for v in small["A"]], rsi_loop(x), atol=1e-9)
    assert small["D"] == [(5.0, 5.0, 0.0, 50.0, 0.0, 0.0, 5.0, 5.0, 0.0, 0)]


def test_hot_series_is_spread_over_tasks(spark):
    """One symbol holds nearly all rows; its blocks land in more than one partition."""
    df = series(spark, {"HOT": walk(400), "B": walk(5)})
    cut = Z.blocks(df, SMALL, before=3, block_rows=20).repartition(4, "symbol", "interval", "_block")
    sizes = cut.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 400


def exchanges(df):
    """Shuffles above and below the first per-cell aggregate, in plan order."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
    return sum(i < scan for i in at), sum(i > scan for i in at)


def test_rows_are_shuffled_once_for_neighbours_and_twice_for_frames(spark, tmp_path):
    """With broadcasts off; every other exchange moves one row per cell or block."""
    data(spark).write.parquet(str(tmp_path / "bars"))
    df = spark.read.parquet(str(tmp_path / "bars"))
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for name in limits:
            spark.conf.set(name, "-1")
        assert exchanges(Z.neighbours(df, "close", previous="p")) == (1, 3)
        assert exchanges(I.sma(df, 20)) == (2, 3)
    finally:
        for name in limits:
            spark.conf.unset(name)


def test_rows_without_a_place_are_kept(spark):
    df = data(spark)
    loose = df.limit(2).withColumn("open_time", F.lit(None).cast("long")).unionByName(
        df.limit(1).withColumn("symbol", F.lit(None).cast("string")))
    both = df.unionByName(loose)
    lost = F.col("symbol").isNull() | F.col("open_time").isNull()
    outs = {
        "sma_5": I.sma(both, 5, series=SMALL, block_rows=16),
        "ema_5": R.ema(both, 5, series=SMALL, block_rows=16),
        "rsi_14": R.rsi(both, series=SMALL, block_rows=16),
        "p": Z.neighbours(both, "close", SMALL, previous="p"),
    }
    for name, out in outs.items():
        assert out.count() == df.count() + 3
        assert [r[name] for r in out.filter(lost).collect()] == [None] * 3
    alone = by_symbol(R.ema(df, 5, series=SMALL, block_rows=16), "ema_5")
    close_to(by_symbol(outs["ema_5"].filter(~lost), "ema_5"), alone)
    assert I.bfill_ffill(both, ["close"], SMALL).count() == df.count() + 3
    full = both.withColumn("volume", F.col("volume").cast("decimal(18,8)"))
    assert I.build_features(full, series=SMALL, block_rows=20).count() == df.count() + 3


@pytest.mark.parametrize("fan", [2, 3, 7])
def test_states_are_carried_over_a_tree_of_blocks(spark, monkeypatch, fan):
    """Few blocks per super-block, so that states cross many of both; results are those of the serial loops."""
    monkeypatch.setattr(R, "FAN", fan)
    df = data(spark)
    close_to(by_symbol(R.ema(df, 10, series=SMALL, block_rows=4), "ema_10"), {k: ema_loop(v, 10) for k, v in closes(df).items()})
    close_to(by_symbol(R.rsi(df, 14, series=SMALL, block_rows=16), "rsi_14"), {k: rsi_loop(v) for k, v in closes(df).items()})
    found = by_symbol(R.macd(df, series=SMALL, block_rows=5), "macd", "macd_signal")
    close_to(found, {k: list(zip(*macd_loop(v))) for k, v in closes(df).items()})


def test_no_task_walks_a_whole_series(spark, monkeypatch):
    """The walks are dealt by super-block; the one over super-blocks has one row for each of them."""
    monkeypatch.setattr(R, "FAN", 4)
    plan = R.ema(data(spark), 10, series=SMALL, block_rows=4)._jdf.queryExecution().executedPlan().toString()
    assert "_super" in plan
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(symbol" in line and "_super" in line]
    assert dealt

import pytest
from pyspark.sql import functions as F

from samples import H, series, walk
from tickframe.operators import mlprep as P
from tickframe.operators import quality as Q
from tickframe.operators import series as Z
from tickframe.schemas import FEATURE_COLUMNS

SMALL = Z.Series(cells=(Z.bar_cell(8),))


def features(spark, n=50, symbol="A"):
    rows = [(symbol, "1m", H + 60000 * i, i % 2, *[float(i + 1)] * 11) for i in range(n)]
    layout = "symbol string, interval string, open_time long, target_direction int, "
    return spark.createDataFrame(rows, layout + ", ".join(f"{c} double" for c in FEATURE_COLUMNS))


@pytest.mark.parametrize("block", [12, 1000])
def test_sequences(spark, block):
    both = features(spark).unionByName(features(spark, 9, "B")).unionByName(features(spark, 10, "C"))
    out = P.sequences(both, length=10, series=SMALL, block_rows=block).orderBy("open_time").collect()
    assert len(out) == 40 and {r.symbol for r in out} == {"A"}
    assert {(len(r.sequence), len(r.sequence[0])) for r in out} == {(10, 11)}
    for i, r in enumerate(out):
        assert [s[0] for s in r.sequence] == [float(v) for v in range(i + 1, i + 11)]
        assert r.label == (i + 9) % 2


def test_scaler(spark):
    df = features(spark).withColumn("volume", F.lit(3.0))
    stats = P.fit_scaler(df)
    row = stats.first()
    assert row.close_float_mean == 25.5 and row.close_float_std == pytest.approx(14.5773797)
    assert row.volume_std == 1.0
    scaled = P.apply_scaler(df, stats)
    first = scaled.orderBy("open_time").first()
    assert first.close_float == pytest.approx((1 - 25.5) / 14.5773797) and first.volume == 0.0
    some = P.apply_scaler(df, stats.select("volume_mean", "volume_std"))
    assert some.orderBy("open_time").first().close_float == 1.0
    assert P.fit_scaler(df.limit(1)).first().close_float_std == 1.0


def test_scaling_joins_nothing(spark):
    df = features(spark)
    plan = P.apply_scaler(df, P.fit_scaler(df))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_split_is_by_time_within_a_series(spark):
    df = series(spark, {"A": walk(10), "B": walk(7)})
    train, test = P.temporal_split(df, 0.8, SMALL)
    count = lambda d: {r.symbol: r["count"] for r in d.groupBy("symbol").count().collect()}
    assert count(train) == {"A": 8, "B": 5} and count(test) == {"A": 2, "B": 2}
    ends = {r.symbol: r.t for r in train.groupBy("symbol").agg(F.max("open_time").alias("t")).collect()}
    assert all(r.open_time > ends[r.symbol] for r in test.collect())
    assert train.columns == df.columns


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = features(spark)
    first = P.fingerprint(df).first()
    assert first == P.fingerprint(df.orderBy(F.desc("open_time"))).first() and first.row_count == 50
    assert first.digest != P.fingerprint(df.withColumn("volume", F.col("volume") + 1)).first().digest
    assert first.digest != P.fingerprint(df.unionByName(df.limit(1))).first().digest


def test_accuracy(spark):
    scores = spark.createDataFrame([([0.1, 0.9], 1), ([0.8, 0.2], 1), ([0.5, 0.5], 0)], "s array<double>, t int")
    assert P.accuracy(scores, "s", "t").first().accuracy == pytest.approx(2 / 3)
    assert P.accuracy(scores.limit(0), "s", "t").first().accuracy == 0.0
    assert P.accuracy(scores.withColumn("g", F.lit(1)), "g", "t").first().correct == 2


def test_fingerprint_tells_rows_apart(spark):
    def digest(*row):
        return P.fingerprint(spark.createDataFrame([row], "a string, b string")).first().digest

    rows = [("x|y", "z"), ("x", "y|z"), ("x", None), ("x", "\\N"), ("x", "-"), ("x", ""), (None, "x"), ("1:x", ""), ("", "1:x")]
    assert len({digest(*r) for r in rows}) == len(rows)


def test_scaler_counts_and_leaves_out_odd_values(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("inf"),), (float("nan"),), (None,)], "x double")
    row = P.fit_scaler(df, ["x"]).first()
    assert (row.x_mean, row.x_odd) == (2.0, 2) and abs(row.x_std - 2 ** 0.5) < 1e-12


def test_all_rules_in_one_pass(spark):
    """Two keys, nulls and a condition: one scan, one shuffle by key, and the counts of each rule on its own."""
    rows = [(1, "a", 2.0), (1, "b", None), (2, None, -1.0), (None, "b", 3.0), (1, "c", 4.0), (None, None, None)]
    df = spark.createDataFrame(rows, "k int, t string, x double")
    made = Q.check(df, Q.Rules(("k", "t"), ("k", "t", "x"), {"x > 0": "x > 0"}))
    assert {(r.rule, r.column): r.failures for r in made.collect()} == {
        ("not_null", "k"): 2, ("not_null", "t"): 2, ("holds", "x > 0"): 1, ("unique", "k"): 1, ("unique", "t"): 1, ("unique", "x"): 0}
    strict = Q.check(df, Q.Rules(holds={"x > 0": "x > 0"}, null_passes=False)).collect()
    assert [r.failures for r in strict] == [3]
    assert {r.failures for r in Q.check(df.limit(0), Q.Rules(("k",), ("t",), {"x > 0": "x > 0"})).collect()} == {0}
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1

import os
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from samples import BAR_1, BAR_2, H, bronze
from tickframe.operators import silver as S
from tickframe.plans import jobs
from tickframe.schemas import SILVER_KLINE
from tickframe.sources import lake, sinks


def changed(bar, **fields):
    names = [f.name for f in SILVER_KLINE][:13]
    return tuple(fields.get(n, v) for n, v in zip(names, bar))


def test_silver_job_dedups_and_partitions(spark, tmp_path):
    src, out, bad = (str(tmp_path / n) for n in ("bronze", "silver", "rejects"))
    bronze(spark, BAR_1, BAR_2, BAR_1).write.parquet(src)
    counts = jobs.run_silver(spark, src, out, bad)
    assert counts == {"raw": 3, "rejected": 0, "kept": 2, "duplicates": 1}
    assert os.path.isdir(f"{out}/symbol=BTCUSDT/interval=1h/year=2024/month=1")
    assert not os.path.exists(bad)
    rows = lake.read_silver_klines(spark, out).orderBy("open_time").collect()
    assert [r.open for r in rows] == [Decimal("51300.00000000"), Decimal("51500.00000000")]


def test_rejects_have_reasons(spark, tmp_path, rows):
    bars = bronze(spark, BAR_1, changed(BAR_1, open=None), changed(BAR_1, volume="-1"),
                  changed(BAR_1, close="abc"), changed(BAR_1, symbol=None), changed(BAR_1, high=None))
    kept, bad = S.to_silver(bars)
    assert rows(bad, "reject_reason") == [
        ("close unreadable",), ("open missing",), ("symbol missing",), ("volume negative",)]
    assert rows(bad.filter("close_text = 'abc'"), "close") == [(None,)]
    # A missing high is no reason to reject; both bars share a key, so one survives.
    assert kept.count() == 1
    assert sinks.write_rejects(bad, str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 4
    assert S.silver_metrics(bars).first().asDict() == {"raw": 6, "rejected": 4, "kept": 1, "duplicates": 1}


def test_rejects_keep_what_was_wrong(spark, rows):
    bars = bronze(spark, BAR_1, changed(BAR_1, volume="30000000000000"), changed(BAR_1, high="x"), changed(BAR_1, open_time=None),
                  changed(BAR_1, open_time=None, close_time=5), changed(BAR_1, quote_volume="20000000000.5"))
    kept, bad = S.to_silver(bars)
    assert kept.count() == 1
    assert rows(bad, "reject_reason", "volume_text", "high_text") == sorted([
        ("volume unreadable", "30000000000000", BAR_1[4]), ("high unreadable", BAR_1[7], "x"),
        ("open_time missing", BAR_1[7], BAR_1[4]), ("open_time missing", BAR_1[7], BAR_1[4]),
        ("quote_volume unreadable", BAR_1[7], BAR_1[4])], key=lambda t: tuple(map(str, t)))


def test_large_numbers_become_null(spark):
    assert S.cast_prices(bronze(spark, changed(BAR_1, open="12345678901"))).first().open is None


def test_dedup_is_the_same_in_any_order(spark):
    copies = [changed(BAR_1, close=str(c)) for c in (1, 5, 3)] + [changed(BAR_1, close="2", close_time=H + 9999999)]
    results = {S.dedup_latest(bronze(spark, *order)).first().close for order in (copies, copies[::-1])}
    assert results == {"2"}
    assert S.dedup_latest(bronze(spark, *copies[:3])).first().close == "5"


def test_dedup_prunes_copies_before_the_shuffle(spark):
    plan = S.dedup_latest(bronze(spark, BAR_1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_silver_overwrites_only_its_folders(spark, tmp_path):
    path = str(tmp_path / "silver")
    first, _ = S.to_silver(bronze(spark, BAR_1, changed(BAR_1, symbol="ETHUSDT")))
    sinks.write_silver(first, path)
    again, _ = S.to_silver(bronze(spark, changed(BAR_1, close="1")))
    sinks.write_silver(again, path)
    rows = {r.symbol: float(r.close) for r in lake.read_silver_klines(spark, path).collect()}
    assert rows == {"BTCUSDT": 1.0, "ETHUSDT": 51500.0}


def test_load_twice_keeps_rows(spark, tmp_path):
    silver, table = str(tmp_path / "silver"), str(tmp_path / "raw")
    sinks.write_silver(S.to_silver(bronze(spark, BAR_1, BAR_2))[0], silver)
    for _ in range(2):
        jobs.load_raw(spark, silver, table)
        assert spark.read.parquet(table).count() == 2


def test_upsert_highest_version_wins(spark, rows):
    layout = "symbol string, interval string, open_time long, close double, _loaded_at int"
    old = spark.createDataFrame([("A", "1m", 1, 1.0, 5), ("A", "1m", 2, 1.0, 1)], layout)
    new = spark.createDataFrame([("A", "1m", 1, 2.0, 4), ("A", "1m", 2, 2.0, 4), ("A", "1m", 3, 2.0, 4)], layout)
    assert rows(S.upsert_latest(new, old), "open_time", "close") == [(1, 1.0), (2, 2.0), (3, 2.0)]


def test_missing_path_is_an_error_and_harms_nothing(spark, tmp_path):
    none, gold, table = (str(tmp_path / n) for n in ("none", "gold", "table"))
    for read in (lake.read_silver_klines, lake.read_bronze_klines, lake.read_features):
        with pytest.raises(AnalysisException):
            read(spark, none)
    spark.range(4).write.parquet(gold)
    with pytest.raises(AnalysisException):
        jobs.run_features(spark, none, gold)
    assert spark.read.parquet(gold).count() == 4
    # Only the serving load may find nothing; it then writes nothing.
    jobs.load_raw(spark, none, table)
    assert not os.path.exists(table)


def test_bronze_folders_follow_each_bar(spark, tmp_path):
    path = str(tmp_path / "bronze")
    sinks.write_bronze_klines(bronze(spark, BAR_1, changed(BAR_2, symbol="123", open_time=H + 32 * 86400000)), path)
    assert os.path.isdir(f"{path}/symbol=BTCUSDT/interval=1h/year=2024/month=01/day=01")
    assert os.path.isdir(f"{path}/symbol=123/interval=1h/year=2024/month=02/day=02")
    back = lake.read_bronze_klines(spark, path)
    assert sorted(r.symbol for r in back.collect()) == ["123", "BTCUSDT"] and len(back.columns) == 13


def test_live_and_backfill_share_a_layout(spark):
    from samples import KLINE_TEXT
    from tickframe.operators.events import live_bronze, normalise_klines

    closed = spark.createDataFrame([(KLINE_TEXT.replace('"x":false', '"x":true'),)], "value string")
    both = S.union_bronze(live_bronze(normalise_klines(closed)), bronze(spark, BAR_1))
    kept, bad = S.to_silver(both)
    assert kept.count() == 2 and bad.count() == 0


def test_conform_casts_and_adds(spark):
    out = S.conform(spark.createDataFrame([(1, "x")], "open_time int, extra string"), SILVER_KLINE)
    assert out.schema.names == SILVER_KLINE.names and out.first().open_time == 1


def test_upsert_reads_and_rewrites_only_touched_folders(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    layout = "symbol string, interval string, open_time long, close double, _loaded_at int"
    load = lambda *r: sinks.upsert_table(spark, spark.createDataFrame(list(r), layout), path, ["symbol"])
    load(("1", "1m", 1, 1.0, 1), ("B", "1m", 1, 1.0, 1), (None, "1m", 1, 1.0, 1))
    kept = {f: os.path.getmtime(f"{path}/symbol=B/{f}") for f in os.listdir(f"{path}/symbol=B")}
    load(("1", "1m", 2, 2.0, 2), (None, "1m", 1, 2.0, 2), (None, "1m", 2, 2.0, 2))
    assert {f: os.path.getmtime(f"{path}/symbol=B/{f}") for f in os.listdir(f"{path}/symbol=B")} == kept
    stored = spark.read.schema(layout).parquet(path)
    assert rows(stored, "symbol", "open_time", "close") == [
        ("1", 1, 1.0), ("1", 2, 2.0), ("B", 1, 1.0), (None, 1, 2.0), (None, 2, 2.0)]


def test_upsert_handles_any_number_of_folders_and_odd_names(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    layout = "symbol string, interval string, open_time long, close double, _loaded_at int"
    names = [f"s{k} /%:ä" for k in range(30)]
    for version in (1, 2, 2):
        some = [(n, "1m", 1, float(version), version) for n in names[:: version]]
        sinks.upsert_table(spark, spark.createDataFrame(some, layout), path, ["symbol"])
    assert rows(spark.read.schema(layout).parquet(path), "symbol", "close") == sorted(
        (n, 2.0 if k % 2 == 0 else 1.0) for k, n in enumerate(names))


def test_job_counts_come_from_what_is_written(spark, tmp_path):
    """Bronze with a copy, a corrected copy and a bad bar; the counts of a second run are those of its own rows."""
    paths = [str(tmp_path / n) for n in ("bronze", "silver", "bad")]
    rows = bronze(spark, BAR_1, BAR_1, BAR_2, changed(BAR_1, symbol="ETHUSDT"), changed(BAR_2, symbol="ETHUSDT", close="abc"))
    sinks.write_bronze_klines(rows, paths[0])
    assert jobs.run_silver(spark, *paths) == {"raw": 5, "rejected": 1, "kept": 3, "duplicates": 1}
    other = str(tmp_path / "more")
    sinks.write_bronze_klines(bronze(spark, changed(BAR_1, symbol="ETHUSDT")), other)
    assert jobs.run_silver(spark, other, *paths[1:]) == {"raw": 1, "rejected": 0, "kept": 1, "duplicates": 0}
    assert spark.read.parquet(paths[1]).count() == 3 and spark.read.parquet(paths[2]).count() == 1

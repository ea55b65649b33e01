"""Loads of a keyed table that count whole or not at all."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tickframe.sources import files, keyed
from tickframe.sources.keyed import KeyedTable

LAYOUT = "symbol string, year int, open_time long, close double, _loaded_at timestamp"
ONE, TWO = datetime(2024, 1, 1), datetime(2024, 1, 2)


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], LAYOUT).schema, ["symbol", "year"], ["symbol", "open_time"])


def bars(spark, symbol, times, close, version, year=2024):
    return spark.createDataFrame([(symbol, year, t, close, version) for t in times], LAYOUT)


def closes(table, where=None):
    return {(r.symbol, r.open_time): r.close for r in table.read(where).collect()}


def test_newest_version_wins_in_any_order(spark, table):
    assert closes(table) == {} and table.load(bars(spark, "A", [1, 2], 2.0, TWO), "b")
    assert table.load(bars(spark, "A", [2, 3], 1.0, ONE), "a")
    assert closes(table) == {("A", 1): 2.0, ("A", 2): 2.0, ("A", 3): 1.0}
    assert not table.load(bars(spark, "A", [2, 3], 9.0, TWO), "a")
    assert table.read().count() == 3


def test_only_touched_folders_are_read_and_written(spark, table):
    table.load(bars(spark, "A", [1], 1.0, ONE).union(bars(spark, "B/c d", [1], 1.0, ONE)).union(bars(spark, None, [5], 1.0, ONE, None)), "one")
    table.load(bars(spark, "B/c d", [2], 2.0, TWO).union(bars(spark, None, [5], 3.0, TWO, None)), "two")
    assert {(r.symbol, r.load) for r in table.folders().collect()} == {("A", "one"), ("B/c d", "two"), (None, "two")}
    assert closes(table) == {("A", 1): 1.0, ("B/c d", 1): 1.0, ("B/c d", 2): 2.0, (None, 5): 3.0}
    assert all("symbol=A" in f for f in table.read("symbol = 'A'").inputFiles())
    assert table.vacuum() == 0
    table.load(bars(spark, "A", [1], 5.0, TWO), "three")
    assert table.vacuum() == 1 and files.names(spark, f"{table.root}/data") == ["load=three", "load=two"]


@pytest.mark.parametrize("step", ["arriving", "merging", "recording"])
def test_a_load_that_fails_changes_nothing(spark, table, step, monkeypatch):
    table.load(bars(spark, "A", [1, 2], 1.0, ONE), "one")
    new = bars(spark, "A", [2, 3], 2.0, TWO)
    if step == "arriving":
        with pytest.raises(Exception, match="cut off"):
            table.load(new.withColumn("close", F.when(F.col("open_time") == 3, F.raise_error(F.lit("cut off")).cast("double")).otherwise(2.0)), "two")
    else:
        class Lost(Exception):
            pass

        def fail(*_):
            raise Lost

        with monkeypatch.context() as m:
            if step == "merging":
                m.setattr(keyed, "upsert_latest", fail)
            else:
                m.setattr(type(new), "coalesce", fail)  # the new folders are there, the record is not
            with pytest.raises(Lost):
                table.load(new, "two")
    assert closes(table) == {("A", 1): 1.0, ("A", 2): 1.0}
    assert table.load(new, "two") and closes(table) == {("A", 1): 1.0, ("A", 2): 2.0, ("A", 3): 2.0}


def test_names_are_checked(spark, table):
    with pytest.raises(ValueError):
        table.load(bars(spark, "A", [1], 1.0, ONE), "a/b")

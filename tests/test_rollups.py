"""Stored rollups against the same query over all facts."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickframe.plans import metrics as X
from tickframe.plans import rollups as R

START = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(f"k{k}", "AB"[k % 2], "1m", START + timedelta(minutes=37 * k), 1e6 + math.sin(k), 1e6 + math.sin(k) / 50)
            for k in range(400)]
    rows += [("none", "A", "1m", None, 5.0, 0.25), ("null", "B", "1m", START, 5.0, None)]
    return spark.createDataFrame(
        rows, "kline_return_id string, symbol string, interval string, open_at timestamp, close double, log_return double")


def same(a, b):
    a, b = (sorted(map(tuple, d.collect()), key=str) for d in (a, b))
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert x[:-2] == y[:-2]
        for u, v in zip(x[-2:], y[-2:]):
            assert (u is None and v is None) or u == pytest.approx(v, rel=1e-9)


ALL = ["avg_log_return", "stddev_log_return"]
CUT = START + timedelta(days=4)


def ask(facts, stores=None, dims=("symbol", "open_at"), unit="day"):
    if stores is None:
        return X.query(X.PRICE_ANALYTICS, facts, list(dims), ALL, unit)
    return R.answer(X.PRICE_ANALYTICS, stores, facts, list(dims), ALL, unit)


def filled(spark, tmp_path, facts, spec=X.RETURNS_ROLLUP, name="r"):
    store = R.RollupStore(spark, str(tmp_path / name), spec)
    early = F.col("open_at") < F.lit(CUT)
    assert store.load(facts.filter(early & (F.col("symbol") == "A")), "a") == 4
    assert store.load(facts.filter(early & (F.col("symbol") == "B")), "b", upto=CUT) == 4
    return store


def test_loads_add_up_and_are_counted_once(spark, tmp_path, facts):
    store = filled(spark, tmp_path, facts)
    assert store.load(facts, "a") == 0
    covered = {r.folder: (r.loads, r.facts) for r in store.covered().collect()}
    assert set(covered) == {"2024-03-01", "2024-03-02", "2024-03-03", "2024-03-04"} and {c[0] for c in covered.values()} == {2}
    assert sum(c[1] for c in covered.values()) == facts.filter(F.col("open_at") < F.lit(CUT)).count()
    early = facts.filter(F.col("open_at") < F.lit(CUT))
    stored = X.query(X.PRICE_ANALYTICS, facts, ["symbol", "open_at"], ALL, "day", (X.Rollup(X.RETURNS_ROLLUP, store.states()),))
    same(stored, ask(early))
    assert store.compact() == 4 and store.compact() == 0
    assert {r.loads for r in store.covered().collect()} == {1}
    stored = X.query(X.PRICE_ANALYTICS, facts, ["symbol", "open_at"], ALL, "day", (X.Rollup(X.RETURNS_ROLLUP, store.states()),))
    same(stored, ask(early))
    assert store.held().upto == CUT


def test_answer_merges_stored_and_open_buckets(spark, tmp_path, facts):
    store = filled(spark, tmp_path, facts)
    for dims, unit in ((("symbol", "open_at"), "day"), (("symbol",), None), (("symbol", "open_at"), "week"), ((), None)):
        same(ask(facts, [store], dims, unit), ask(facts, None, dims, unit))


def test_stored_part_reads_no_facts(spark, tmp_path, facts):
    path = str(tmp_path / "facts")
    facts.withColumn("d", F.coalesce(F.to_date("open_at").cast("string"), F.lit("none"))).write.partitionBy("d").parquet(path)
    stored_facts = spark.read.parquet(path)
    store = R.RollupStore(spark, str(tmp_path / "all"), X.RETURNS_ROLLUP)
    store.load(stored_facts, "all", upto=START + timedelta(days=30))
    rows = X.query(X.PRICE_ANALYTICS, stored_facts, ["symbol", "open_at"], ALL, "day", (X.Rollup(X.RETURNS_ROLLUP, store.states()),))
    assert all("/all/state/" in f for f in rows.inputFiles())
    asked = ask(stored_facts, [store])
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(open_at" in plan and "PushedFilters" in plan
    same(asked, ask(stored_facts))


def test_touched_folders_only(spark, tmp_path, facts):
    store = filled(spark, tmp_path, facts)
    before = {r["folder"]: r["seq"] for r in store.parts()}
    day = F.to_date("open_at") == "2024-03-02"
    changed = facts.filter(day).withColumn("log_return", F.col("log_return") + 1)
    assert store.load(changed, "again", replaces=True) == 1
    after = {r["folder"]: r["seq"] for r in store.parts()}
    assert {k for k in after if after[k] != before[k]} == {"2024-03-02"}
    both = facts.filter(~day & (F.col("open_at") < F.lit(CUT))).unionByName(changed)
    stored = X.query(X.PRICE_ANALYTICS, facts, ["symbol", "open_at"], ALL, "day", (X.Rollup(X.RETURNS_ROLLUP, store.states()),))
    same(stored, ask(both))
    some = store.states(datetime(2024, 3, 2), datetime(2024, 3, 3))
    assert all("folder=2024-03-02" in f or "folder=2024-03-03" in f for f in some.inputFiles())
    assert {r.open_at.day for r in some.select("open_at").collect()} == {2}


def test_the_cheapest_store_answers(spark, tmp_path, facts):
    hourly, daily = filled(spark, tmp_path, facts), filled_daily(spark, tmp_path, facts)
    chosen = [R.cheapest([hourly, daily], X.PRICE_ANALYTICS, ["symbol", "open_at"], ALL, u) for u in ("day", "hour", "month")]
    assert chosen == [daily, hourly, daily]
    assert R.cheapest([hourly, daily], X.PRICE_ANALYTICS, ["close"], ALL, None) is None
    same(ask(facts, [hourly, daily]), ask(facts))


def filled_daily(spark, tmp_path, facts):
    store = R.RollupStore(spark, str(tmp_path / "daily"), X.RETURNS_DAILY_ROLLUP)
    store.load(facts.filter(F.col("open_at") < F.lit(CUT)), "all", upto=CUT)
    return store


def test_a_load_cut_off_before_its_record_is_not_counted_twice(spark, tmp_path, facts):
    store = R.RollupStore(spark, str(tmp_path / "cut"), X.RETURNS_ROLLUP)
    record = store.record
    early = facts.filter(F.col("open_at") < F.lit(CUT))

    class Lost(Exception):
        pass

    def fail():
        raise Lost

    states = X.rollup_table(early, X.RETURNS_ROLLUP, counted=True).withColumn("folder", F.date_format("open_at", "yyyy-MM-dd"))
    store.record = fail
    with pytest.raises(Lost):
        store._write(states, "a", CUT, False)  # its files are there, its record is not
    store.record = record
    assert store.parts() == [] and store.states() is None
    store.load(early, "a", upto=CUT)
    same(ask(facts, [store]), ask(facts))


def test_bounds_and_empty_loads(spark, tmp_path, facts):
    store = R.RollupStore(spark, str(tmp_path / "e"), X.RETURNS_ROLLUP)
    with pytest.raises(ValueError):
        store.load(facts, "x", upto=datetime(2024, 3, 1, 0, 30))
    assert store.load(facts.limit(0), "nothing", upto=CUT) == 0
    assert store.held() == R.Held(0, 0, CUT)
    same(ask(facts.filter(F.col("open_at") >= F.lit(CUT)), [store]), ask(facts.filter(F.col("open_at") >= F.lit(CUT))))

"""The stored model input against fitting and scaling everything at once."""

import math

import pytest
from pyspark.sql import functions as F

from tickframe.operators import mlprep as P
from tickframe.plans.model_input import ModelInput, merged_scaler, moments
from tickframe.schemas import FEATURE_COLUMNS, FEATURE_ROW


def features(spark, symbols, n=30, shift=0.0):
    rows = []
    for s in symbols:
        for k in range(n):
            values = {c: math.sin(k + j + ord(s)) + 1e5 * (s == "A") + shift for j, c in enumerate(FEATURE_COLUMNS)}
            values["volume"] = None
            if k == 3:
                values["vol_20"] = float("inf")
            rows.append((k * 60000, s, "1m", *[values[c] for c in FEATURE_COLUMNS], k % 2))
    return spark.createDataFrame(rows, FEATURE_ROW)


def test_merged_moments_equal_one_pass(spark):
    df = features(spark, "ABC")
    one, merged = P.fit_scaler(df).first(), merged_scaler(moments(df, ["symbol"])).first()
    assert one.asDict().keys() == merged.asDict().keys()
    for k, v in one.asDict().items():
        assert merged[k] == (v if v is None else pytest.approx(v, rel=1e-9))


def test_updates_touch_their_symbols_only(spark, tmp_path):
    store = ModelInput(spark, str(tmp_path / "m"), length=5, share=0.8)
    store.update(features(spark, "AB"))
    kept = {f for f in store._read("sequences", "label long, symbol string, part string").inputFiles() if "symbol=A" in f}
    store.update(features(spark, "BC", shift=2.0))
    store.update(features(spark, "A").limit(0))
    files = set(store._read("sequences", "label long, symbol string, part string").inputFiles())
    assert kept and kept <= files
    whole = features(spark, "A").unionByName(features(spark, "BC", shift=2.0))
    for k, v in P.fit_scaler(whole).first().asDict().items():
        assert store.scaler().first()[k] == (v if v is None else pytest.approx(v, rel=1e-9))
    rows = store.read().collect()
    assert len(rows) == 3 * (30 - 5) and {r.part for r in rows} == {"train", "test"}
    assert {len(r.sequence) for r in rows} == {5}
    scaled = {(r.symbol, r.open_time): r for r in P.apply_scaler(whole, P.fit_scaler(whole)).collect()}
    for r in rows:
        last = scaled[r.symbol, r.open_time]
        for got, want in zip(r.sequence[-1], (last[c] for c in FEATURE_COLUMNS)):
            assert got == want or got == pytest.approx(want, rel=1e-7, abs=1e-7)
    test = store.read("test").collect()
    assert len(test) == 3 * 5 and min(r.open_time for r in test) > max(r.open_time for r in rows if r.part == "train")

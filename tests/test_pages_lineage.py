import json

import pytest
from pyspark.sql import functions as F

from samples import BAR_1, BAR_2, bronze
from tickframe.operators import lineage as L
from tickframe.schemas import BRONZE_KLINE, KLINE_EVENT
from tickframe.sources import lake, pages, sinks

BAR = [1704067200000, "51300.50000000", "51800.00000000", "51100.00000000", "51500.00000000", "812.43210000",
       1704070799999, "41765432.10000000", 3321, "406.21605000", "20882716.05000000", "0"]


def page(spark, *payloads):
    return spark.createDataFrame([("BTCUSDT", "1h", p) for p in payloads],
                                 "symbol string, interval string, payload string")


def test_page_keeps_digits_and_counts_malformed(spark):
    df = page(spark, json.dumps([BAR, [1, "bad"]]), "[]", json.dumps([BAR, BAR[:10], BAR[:11]]))
    rows = pages.parse_kline_pages(df).collect()
    assert len(rows) == 3 and df.columns and pages.parse_kline_pages(df).schema.names == BRONZE_KLINE.names
    assert rows[0].open == "51300.50000000" and rows[0].volume == "812.43210000" and rows[0].num_trades == 3321
    assert pages.page_metrics(df).first().asDict() == {
        "symbol": "BTCUSDT", "interval": "1h", "bars": 3, "malformed": 2}


def test_unreadable_values_are_malformed(spark):
    bad = [[*BAR[:1], "abc", *BAR[2:]], ["x", *BAR[1:]], [*BAR[:8], None, *BAR[9:]]]
    assert pages.parse_kline_pages(page(spark, json.dumps(bad))).count() == 0


def test_backfill_pages_cover_the_range_once(spark):
    ranges = spark.createDataFrame([("A", "2024-01-01", "2024-01-02")], "symbol string, start_date string, end_date string")
    plan = pages.backfill_plan(ranges, ["1m", "1h", "1d"]).orderBy("interval", "page").collect()
    by = {}
    for r in plan:
        by.setdefault(r.interval, []).append((r.page_start, r.page_end))
    assert {k: len(v) for k, v in by.items()} == {"1m": 3, "1h": 1, "1d": 1}
    for spans in by.values():
        assert spans[0][0] == 1704067200000 and spans[-1][1] == 1704067200000 + 2 * 86400000
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_open_end_means_today(spark):
    ranges = spark.sql("SELECT 'A' symbol, current_date() start_date, CAST(NULL AS DATE) end_date")
    row = pages.backfill_plan(ranges, ["1d"]).first()
    assert row.page_end - row.page_start == 86400000


MANIFEST = json.dumps({
    "nodes": {
        "model.p.fct": {"resource_type": "model", "name": "fct", "schema": "gold", "description": "facts",
                        "depends_on": {"nodes": ["model.p.stg"]}},
        "model.p.stg": {"resource_type": "model", "name": "stg", "depends_on": {"nodes": ["source.p.raw"]}},
        "test.p.t": {"resource_type": "test", "name": "t", "depends_on": {"nodes": ["model.p.fct"]}},
    },
    "sources": {"source.p.raw": {"name": "raw", "schema": "silver"}},
})


def test_manifest_nodes_and_edges(spark, rows):
    nodes, edges = L.manifest_lineage(spark.createDataFrame([(MANIFEST,)], "manifest string"))
    assert rows(nodes, "id", "name", "type") == [
        ("model.p.fct", "gold.fct", "table"), ("model.p.stg", "gold.stg", "table"),
        ("source.p.raw", "silver.raw", "dbt_source")]
    assert rows(edges, "from_node", "to_node") == [("model.p.stg", "model.p.fct"), ("source.p.raw", "model.p.stg")]


def test_graph_events(spark, rows, tmp_path):
    layout = "id string, name string, type string, layer string, description string"
    nodes, edges = L.manifest_lineage(spark.createDataFrame([(MANIFEST,)], "manifest string"))
    later = spark.createDataFrame([("model.p.fct", "x", "view", "bi", "d")], layout)
    more = spark.createDataFrame([("model.p.fct", "gone", "exposes")], edges.schema)
    n, e = L.lineage_graph([(nodes, edges), (later, edges.unionByName(more))])
    assert n.count() == 3 and e.count() == 3
    resolved = L.resolve_edges(e, n)
    assert rows(resolved, "from_node", "from_type", "to_type") == [
        ("model.p.fct", "view", "table"), ("model.p.stg", "table", "view"), ("source.p.raw", "dbt_source", "table")]
    events = L.lineage_events(resolved, "ns", F.lit("2024-01-01T00:00:00Z"), F.lit("id-1"))
    one = events.filter("to_node = 'gone'").first()
    event, request = json.loads(one.run_event), json.loads(one.lineage_request)
    assert event["eventType"] == "COMPLETE" and event["run"]["runId"] == "id-1"
    assert event["job"] == {"namespace": "ns", "name": "model.p.fct_to_gone"}
    assert event["inputs"][0]["name"] == "model.p.fct" and event["outputs"][0]["name"] == "gone"
    assert request["edge"]["fromEntity"] == {"id": "model.p.fct", "type": "view"}
    assert request["lineageDetails"]["sqlQuery"] == "Relationship: exposes"
    L.export_lineage(n, e, str(tmp_path), "ns", run_id=F.lit("id-1"))
    assert [spark.read.json(str(tmp_path / p)).count() for p in ("nodes", "edges", "events")] == [3, 3, 3]
    assert L.lineage_events(resolved, "ns").count() == 3


def test_unreadable_pages_are_counted_and_kept(spark):
    whole = json.dumps([BAR, BAR])
    df = page(spark, whole, whole[:-1], "no json", '{"code":-1121,"msg":"Invalid symbol."}', "[]", None)
    assert pages.parse_kline_pages(df).count() == 2
    assert pages.page_metrics(df).first()[2:] == (2, 4)
    rejects = {(r.payload, r.reject_reason) for r in pages.page_rejects(df).collect()}
    assert rejects == {(p, "unreadable payload") for p in (whole[:-1], "no json", '{"code":-1121,"msg":"Invalid symbol."}')} | {
        (None, "no payload")}


def test_plan_refuses_what_it_cannot_plan(spark):
    ranges = spark.createDataFrame([("A", "2024-01-01", "2024-01-02")], "symbol string, start_date string, end_date string")
    with pytest.raises(ValueError, match="10m"):
        pages.backfill_plan(ranges, ["1d", "10m"])
    with pytest.raises(Exception, match="no start_date for A"):
        pages.backfill_plan(ranges.withColumn("start_date", F.lit(None).cast("string")), ["1d"]).collect()


def test_one_prefix_for_history_and_live_bars(spark, tmp_path):
    path = str(tmp_path / "mixed")
    sinks.write_bronze_klines(bronze(spark, BAR_1, BAR_2), path)
    symbol, interval, at, o, h, low, c, v, end, quote, n, *_ = BAR_1
    bars = [(at + 7_200_000, True), (at + 10_800_000, False)]
    events = [("kline", 5, symbol, (t, t + 3_599_999, symbol, interval, o, c, h, low, v, n, closed, quote)) for t, closed in bars]
    sinks.write_live_klines(spark.createDataFrame(events, KLINE_EVENT), path)
    rows = {r.open_time: r for r in lake.read_mixed_klines(spark, path).collect()}
    assert sorted(rows) == [at, at + 3_600_000, at + 7_200_000]
    live = rows[at + 7_200_000]
    assert (live.symbol, live.interval, live.open, live.num_trades, live.taker_buy_base_volume) == (symbol, interval, o, n, None)
    assert tuple(rows[at]) == BAR_1
    plan = lake.read_mixed_klines(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1


def test_stored_lineage_parses_once(spark, tmp_path):
    manifest = {"nodes": {"m.a": {"resource_type": "model", "name": "a", "depends_on": {"nodes": ["s.x", None]}},
                          "m.b": {"resource_type": "model", "name": "b", "schema": "silver", "depends_on": {"nodes": ["m.a"]}},
                          "t": {"resource_type": "test", "name": "t", "depends_on": {"nodes": ["m.a"]}},
                          "m.c": {"resource_type": "model", "name": "c"}},
                "sources": {"s.x": {"name": "x", "schema": "raw"}}}
    df = spark.createDataFrame([(json.dumps(manifest),), ("{}",), ("no json",), (None,)], "manifest string")
    made, stored = L.manifest_lineage(df), L.stored_lineage(df, str(tmp_path / "lineage"))
    for a, b in zip(made, stored):
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert {(r.from_node, r.to_node) for r in stored[1].collect()} == {("s.x", "m.a"), ("m.a", "m.b")}
    assert {r.id for r in stored[0].collect()} == {"s.x", "m.a", "m.b", "m.c"}


def test_export_is_compressed(spark, rows, tmp_path):
    """The repeated text of the events does not fill the disk; readers get the same rows with and without compression."""
    nodes = spark.range(200).select(F.concat(F.lit("n"), "id").alias("id"), *[F.lit("x").alias(c) for c in ("name", "type", "layer", "description")])
    edges = spark.range(200).select(F.concat(F.lit("n"), "id").alias("from_node"), F.lit("n0").alias("to_node"), F.lit("r").alias("relationship"))
    fixed = {"event_time": F.lit("t"), "run_id": F.lit("id-1")}
    found = {}
    for codec in ({}, {"compression": "none"}):
        folder = tmp_path / (codec.get("compression") or "default")
        L.export_lineage(nodes, edges, str(folder), "ns", **codec, **fixed)
        size = sum(f.stat().st_size for f in folder.glob("events/part-*"))
        found[folder.name] = size, [rows(spark.read.json(str(folder / n))) for n in ("nodes", "edges", "events")]
    assert found["default"][1] == found["none"][1] and len(found["none"][1][2]) == 200
    assert 5 * found["default"][0] < found["none"][0]

import json

from pyspark.sql import functions as F

from samples import KLINE_TEXT, TRADE_TEXT
from tickframe.operators import events as E
from tickframe.schemas import TRADE, TRADE_OPTIONAL


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def without(text, *path):
    body = json.loads(text)
    inner = body
    for key in path[:-1]:
        inner = inner[key]
    del inner[path[-1]]
    return json.dumps(body)


def test_trade_is_typed(spark):
    row = E.normalise_trades(texts(spark, TRADE_TEXT)).first()
    assert (row.event_type, row.symbol, row.trade_id) == ("trade", "BTCUSDT", 908172)
    assert (row.price, row.quantity) == ("712000.00", "0.001")
    assert (row.buyer_order_id, row.seller_order_id) == (111, 222)
    assert row.trade_time == 1720000000000 and row.is_buyer_maker is False


def test_both_spellings_agree(spark):
    long = json.dumps({
        "event_type": "trade", "event_time": 1720000000000, "symbol": "BTCUSDT", "trade_id": 908172,
        "price": "712000.00", "quantity": "0.001", "buyer_order_id": 111, "seller_order_id": 222,
        "trade_time": 1720000000000, "is_buyer_maker": False,
    })
    assert len(set(E.normalise_trades(texts(spark, TRADE_TEXT, long)).collect())) == 1


def test_kline_is_nested(spark):
    row = E.normalise_klines(texts(spark, KLINE_TEXT)).first()
    assert row.symbol == "BTCUSDT" and row.kline.interval == "1m"
    assert row.kline.open_time == 1720000000000 and row.kline.close_time == 1720000059999
    assert row.kline.number_of_trades == 150 and row.kline.is_closed is False


def test_route_counts_and_dead_letters(spark, rows):
    broken = [without(TRADE_TEXT, k) for k in "sptq"] + [without(KLINE_TEXT, "k", k) for k in "ochlv"]
    stray = ["no json", '{"e":"depth"}', "[1,2]", ""]
    wrapped = json.dumps({"stream": "btcusdt@trade", "data": json.loads(TRADE_TEXT)})
    routed = E.route_events(texts(spark, TRADE_TEXT, wrapped, KLINE_TEXT, *broken, *stray))
    assert routed.trades.count() == 2 and routed.klines.count() == 1
    assert routed.dlq.groupBy("kind").count().orderBy("kind").collect() == [("kline", 5), ("trade", 4)]
    assert {r.key for r in routed.dlq.collect()} == {"unknown"}
    assert sorted(json.dumps(json.loads(r.value)) for r in routed.dlq.collect()) == sorted(broken)


def test_order_ids_are_optional_and_wrong_types_are_not(spark):
    bare = without(without(TRADE_TEXT, "a"), "b")
    wrong = TRADE_TEXT.replace("908172", '"abc"')
    routed = E.route_events(texts(spark, bare, wrong))
    assert routed.trades.count() == 1 and routed.dlq.count() == 1


def test_validate_long_names(spark):
    fine = json.dumps({"event_type": "trade", "event_time": 1, "symbol": "A", "trade_id": 2, "price": "1",
                       "quantity": "2", "trade_time": 3, "is_buyer_maker": True})
    ok, bad = E.validate(texts(spark, fine, without(fine, "price"), "junk"), TRADE, TRADE_OPTIONAL)
    assert ok.count() == 1 and bad.count() == 2


def test_closed_bars_keep_final_ones(spark):
    closed = KLINE_TEXT.replace('"x":false', '"x":true')
    out = E.closed_bars(E.normalise_klines(texts(spark, KLINE_TEXT, closed))).collect()
    assert len(out) == 1
    assert float(out[0].open) == 712000 and float(out[0].volume) == 10.5 and out[0].num_trades == 150


def test_messages_are_parsed_once(spark):
    routed = E.route_events(texts(spark, TRADE_TEXT))
    for part in routed:
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1


def test_validate_refuses_other_types_for_text(spark):
    fine = {"event_type": "trade", "event_time": 1, "symbol": "A", "trade_id": 7, "price": "1.5", "quantity": "2", "trade_time": 1,
            "is_buyer_maker": True}
    odd = [dict(fine, price=712000), dict(fine, quantity=True), dict(fine, price=None), dict(fine, symbol=["A"]), dict(fine, trade_id="x")]
    lenient = [dict(fine, trade_id="7"), dict(fine, is_buyer_maker="true")]
    ok, bad = E.validate(texts(spark, *map(json.dumps, [fine, *odd, *lenient])), TRADE, TRADE_OPTIONAL)
    assert ok.count() == 3 and bad.count() == len(odd)
    assert {r.trade_id for r in ok.collect()} == {7}


def test_fields_are_checked_in_the_parse(spark):
    """No later step checks a field of a message again: with the checks in it, it was too long a method to be compiled."""
    plan = E.tag_events(E.unwrap_envelope(texts(spark, TRADE_TEXT, KLINE_TEXT)))._jdf.queryExecution().executedPlan().toString()
    steps = [line for line in plan.splitlines() if "variant_get" in line]
    assert len(steps) == 1 and "inline" in steps[0]


def test_a_bar_without_a_body(spark):
    """Its fields are null one by one; a body that is no object counts as none."""
    bare = [json.dumps({"e": "kline", "E": 5, "s": "A"} | more) for more in ({}, {"k": None}, {"k": 3}, {"kline": {"open_time": 7}})]
    rows = E.normalise_klines(texts(spark, *bare, None, "no json")).collect()
    assert [(r.event_type, r.event_time, r.symbol) for r in rows] == [("kline", 5, "A")] * 4 + [(None, None, None)] * 2
    assert [r.kline.open_time for r in rows] == [None, None, None, 7, None, None] and all(r.kline.close_time is None for r in rows)
    assert E.route_events(texts(spark, *bare)).dlq.count() == 4

import glob
import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from samples import KLINE_TEXT, TRADE_TEXT
from tickframe.operators.microstructure import microstructure, type_trades
from tickframe.schemas import TRADE
from tickframe.sources import lake
from tickframe.streaming import jobs as J

TRADES = [  # id, price, quantity, time, buyer is maker
    (1, "712000.0", "1.0", 1720000025000, False), (1, "712000.0", "1.0", 1720000025000, False),
    (2, "712010.0", "2.0", 1720000035000, True), (3, "712020.0", "3.0", 1720000045000, False),
    (4, "712005.0", "4.0", 1720000040000, True),
]
NEXT = (5, "712000.0", "1.0", 1720000095000, False)


def text(trade, symbol="BTCUSDT"):
    i, p, q, t, m = trade
    return json.dumps({"event_type": "trade", "event_time": t, "symbol": symbol, "trade_id": i, "price": p,
                       "quantity": q, "trade_time": t, "is_buyer_maker": m})


class Source:
    """A folder of text files, one per micro-batch, in order."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        folder.mkdir()

    def add(self, *lines):
        self.n += 1
        (self.folder / f"{self.n:04d}.txt").write_text("\n".join(lines) + "\n")

    def stream(self):
        return lake.read_stream(self.spark, "text", {"path": str(self.folder), "maxFilesPerTrigger": "1"})


@pytest.fixture
def source(spark, tmp_path):
    return Source(spark, tmp_path / "in")


def done(query):
    query.awaitTermination()
    assert query.exception() is None


def golden(row):
    assert row.window_start == datetime(2024, 7, 3, 9, 47) and row.window_end == datetime(2024, 7, 3, 9, 48)
    assert row.vwap == pytest.approx(712010.0) and row.order_flow_imbalance == pytest.approx(-2.0)
    assert row.price_volatility == pytest.approx(8.5391, abs=1e-4) and row.trade_count == 4


def test_closed_windows_only(spark, source, tmp_path):
    source.add(*map(text, TRADES))
    source.add(text(NEXT))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    done(J.write_stream(J.microstructure_stream(source.stream()), out, check))
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 1
    golden(rows[0])


def test_batch_gives_the_same_window(spark):
    df = spark.createDataFrame([(text(t),) for t in TRADES], "value string")
    golden(microstructure(type_trades(J.parse_json(df, TRADE))).first())


def test_ids_are_per_symbol(spark):
    df = spark.createDataFrame([(text(TRADES[0], s),) for s in "AB"], "value string")
    rows = microstructure(type_trades(J.parse_json(df, TRADE))).collect()
    assert [(r.trade_count, r.price_volatility) for r in rows] == [(1, 0.0), (1, 0.0)]


def test_zero_volume_has_no_vwap(spark):
    df = spark.createDataFrame([(text((1, "5", "0", 1720000025000, True)),)], "value string")
    assert microstructure(type_trades(J.parse_json(df, TRADE))).first().vwap is None


def test_late_trades_and_restart(spark, source, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    source.add(*map(text, TRADES[:4]))
    done(J.write_stream(J.microstructure_stream(source.stream()), out, check))
    source.add(text(NEXT))
    done(J.write_stream(J.microstructure_stream(source.stream()), out, check))
    source.add(text((6, "1.0", "9.0", 1720000026000, False)))
    source.add(text((7, "712000.0", "1.0", 1720000295000, False)))
    done(J.write_stream(J.microstructure_stream(source.stream()), out, check))
    rows = {r.window_start.minute: r.trade_count for r in spark.read.parquet(out).collect()}
    assert rows == {47: 3, 48: 1}


def test_both_sinks_see_each_row_once(spark, source, tmp_path):
    source.add(*map(text, TRADES))
    source.add(text(NEXT))
    table, sent = str(tmp_path / "table"), str(tmp_path / "sent")

    def messages(batch, batch_id):
        J.table_sink(sent)(J.window_messages(batch), batch_id)

    done(J.dual_sink(J.microstructure_stream(source.stream()), [J.table_sink(table), messages], str(tmp_path / "c")))
    golden(spark.read.parquet(table).first())
    message = spark.read.parquet(sent).first()
    body = json.loads(message.value)
    assert message.key == "BTCUSDT" and body["window_start"] == "2024-07-03 09:47:00" and body["trade_count"] == 4


def test_repeated_batch_replaces_itself(spark, tmp_path):
    sink = J.table_sink(str(tmp_path / "t"))
    for _ in range(2):
        sink(spark.range(3), 7)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_closed_bars(spark, source, tmp_path):
    body = {"open_time": 1720000000000, "close_time": 1720000059999, "symbol": "BTCUSDT", "interval": "1m",
            "open": "712000.00", "close": "712100.00", "high": "712200.00", "low": "711900.00", "volume": "10.5",
            "number_of_trades": 150, "is_closed": True, "quote_volume": "7477050.00"}
    event = {"event_type": "kline", "event_time": 1720000000000, "symbol": "BTCUSDT", "kline": body}
    source.add(json.dumps(event), json.dumps({**event, "kline": {**body, "is_closed": False}}))
    done(J.write_stream(J.closed_bars_stream(source.stream()), str(tmp_path / "o"), str(tmp_path / "c")))
    rows = spark.read.parquet(str(tmp_path / "o")).collect()
    assert len(rows) == 1 and rows[0].is_closed and rows[0].symbol == "BTCUSDT"
    assert float(rows[0].open) == 712000 and float(rows[0].volume) == 10.5 and rows[0].num_trades == 150


def test_router_writes_three_tables(spark, source, tmp_path):
    source.add(TRADE_TEXT, KLINE_TEXT, TRADE_TEXT.replace('"p":"712000.00",', ""), "junk")
    paths = [str(tmp_path / n) for n in ("trades", "klines", "dlq")]
    done(J.route_stream(source.stream(), *map(J.table_sink, paths), str(tmp_path / "c")))
    assert [spark.read.parquet(p).count() for p in paths] == [1, 1, 1]


def test_bronze_lands_by_symbol_and_day(spark, source, tmp_path):
    nameless = json.dumps({k: v for k, v in json.loads(text(TRADES[0])).items() if k != "symbol"})
    source.add(text(TRADES[0]), nameless, "not json", "")
    out = str(tmp_path / "bronze")
    done(J.write_bronze_stream(J.land_messages(source.stream(), "trade"), out, str(tmp_path / "c"), every=None))
    assert spark.read.parquet(out).count() == 2
    day = datetime.now(UTC)
    assert glob.glob(f"{out}/symbol=UNKNOWN/year={day:%Y}/month={day:%m}/day=*")


def test_bronze_bars_use_their_own_interval(spark, source, tmp_path):
    def bar(interval):
        return json.dumps({"event_type": "kline", "event_time": 1, "symbol": "A", "kline": {"interval": interval}})

    source.add(bar("1m"), bar("1h"))
    out = str(tmp_path / "bronze")
    done(J.write_bronze_stream(J.land_messages(source.stream(), "kline"), out, str(tmp_path / "c"),
                               ("symbol", "interval"), every=None))
    assert len(glob.glob(f"{out}/symbol=A/interval=*")) == 2


@pytest.mark.parametrize("window, delay", [("0 minutes", "10 seconds"), ("1 minute", "-1 seconds"), ("x", "1 second")])
def test_spans_are_checked(source, window, delay):
    source.add(text(NEXT))
    with pytest.raises(ValueError):
        J.microstructure_stream(source.stream(), window, delay)

"""Several outputs of one stream, landing groups, replayed batches."""

import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tickframe.sources import files
from tickframe.sources.replay import Replay
from tickframe.streaming import flush as G
from tickframe.streaming.outputs import Output, Outputs, tag_outputs, write_outputs

DAY = datetime(2024, 5, 6, 7)


def tagged(spark, ids, symbol="A"):
    df = spark.createDataFrame([(i, symbol if i % 5 else None, DAY) for i in ids], "id long, symbol string, at timestamp")
    return tag_outputs(df, {
        "odd": Output(F.struct("id", "symbol"), F.col("id") % 2 == 1, F.col("symbol"), F.col("at")),
        "all": Output(F.struct(F.col("id").cast("string").alias("text")), F.lit(True), F.col("symbol"), F.lit(None).cast("timestamp")),
    })


@pytest.fixture
def outputs(spark, tmp_path):
    return Outputs.like(tagged(spark, [1]), str(tmp_path / "out"), every=3)


def ids(outputs, name="odd"):
    return sorted(r[0] for r in outputs.read(name).select("id" if name == "odd" else "text").collect())


def test_rows_go_to_each_output_once(spark, outputs):
    assert ids(outputs) == [] and ids(outputs, "all") == []
    outputs.write(tagged(spark, range(6)), 0)
    assert ids(outputs) == [1, 3, 5] and ids(outputs, "all") == list("012345")
    keys = {(r.symbol_key, r.day_key) for r in outputs.read("all").collect()}
    assert keys == {("A", "1970-01-01"), ("UNKNOWN", "1970-01-01")}


def test_repeated_batches_replace_themselves(spark, outputs):
    for batch, rows in ((0, [1, 3]), (1, [5]), (1, [5, 7]), (2, [9])):
        outputs.write(tagged(spark, rows), batch)
    assert ids(outputs) == [1, 3, 5, 7, 9]
    outputs.write(tagged(spark, [11]), 3)  # the batches before it are compacted
    assert outputs.parts() == [(0, 2)] and outputs.batches() == [3] and ids(outputs) == [1, 3, 5, 7, 9, 11]
    outputs.write(tagged(spark, [5]), 1)  # finished long ago
    outputs.write(tagged(spark, [11]), 3)
    assert ids(outputs) == [1, 3, 5, 7, 9, 11]
    assert files.names(spark, f"{outputs.root}/data/output=odd/symbol=A/day=2024-05-06") == ["part=0-2"]


def test_batches_without_rows(spark, outputs):
    for batch in range(5):
        outputs.write(tagged(spark, [1] if batch == 2 else []), batch)
    outputs.compact(4)
    assert ids(outputs) == [1] and outputs.batches() == []


@pytest.mark.parametrize("step", ["_parts", "remove"])
def test_a_compaction_that_is_cut_off(spark, outputs, step, monkeypatch):
    for batch in range(3):
        outputs.write(tagged(spark, [10 * batch + 1]), batch)

    class Lost(Exception):
        pass

    def fail(*_):
        raise Lost

    with monkeypatch.context() as m:
        if step == "remove":
            m.setattr(files, "remove", fail)
        else:
            m.setattr(type(spark), "createDataFrame", fail)  # the files are written, the part does not count yet
        with pytest.raises(Lost):
            outputs.compact(2)
    assert ids(outputs) == [1, 11, 21]
    outputs.compact(2)
    assert ids(outputs) == [1, 11, 21] and outputs.batches() == [] and outputs.parts() == [(0, 2)]


def test_readers_prune(spark, outputs):
    for batch, symbol in enumerate("ABC"):
        outputs.write(tagged(spark, [1, 3], symbol), batch)
    outputs.compact(2)
    plan = outputs.read("odd").filter("symbol_key = 'B'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(symbol#" in plan.split("PartitionFilters: [")[1].split("]")[0]


# --- streams --------------------------------------------------------------------------------------

def message(i, symbol="A", **other):
    body = {"event_type": "trade", "event_time": 1, "symbol": symbol, "trade_id": i, "price": "1.5", "quantity": "1",
            "trade_time": 1720000000000, "is_buyer_maker": True} | other
    return json.dumps(body)


def test_replay_delivers_in_order(spark):
    rows = spark.createDataFrame([(b, i) for b in (3, 0, 1) for i in range(4)] + [(None, 9)], "b int, i int")
    replay = Replay(rows, "b", files=2)
    assert replay.waiting == [0, 1, 3] and replay.deliver(1) == 1 and replay.deliver() == 2 and replay.deliver(1) == 0
    seen = []
    query = (replay.stream().writeStream.option("checkpointLocation", replay.path + "-progress").trigger(availableNow=True)
             .foreachBatch(lambda df, i: seen.append(sorted({r.b if r.b is not None else 0 for r in df.collect()}))).start())
    query.awaitTermination()
    assert seen == [[0], [1], [3]]


def test_batches_are_spread_over_files(spark, monkeypatch):
    """A large batch has several files; a small one has as many, so that a trigger takes neither less nor more of it."""
    monkeypatch.setattr("tickframe.sources.replay.FILE_ROWS", 10)
    rows = [(0, i) for i in range(35)] + [(1, 100)] + [(2, i) for i in range(200, 240)]
    replay = Replay(spark.createDataFrame(rows, "b int, i int"), "b")
    assert replay.files == 4 and replay.deliver() == 3
    seen = []
    query = (replay.stream().writeStream.option("checkpointLocation", replay.path + "-progress").trigger(availableNow=True)
             .foreachBatch(lambda df, i: seen.append((df.columns, sorted(map(tuple, df.collect()))))).start())
    query.awaitTermination()
    assert seen == [(["b", "i"], [r for r in rows if r[0] == b]) for b in range(3)]
    assert len(files.names(spark, replay.path)) == 1 + 3 * 4  # and _SUCCESS


def test_staged_batches_are_read_apart(spark, monkeypatch):
    """A batch is staged in files of FILE_ROWS, so that its delivery is not one task."""
    monkeypatch.setattr("tickframe.sources.replay.FILE_ROWS", 10)
    replay = Replay(spark.createDataFrame([(0, i) for i in range(35)] + [(1, 100)], "b int, i int"), "b")
    sizes = replay._dealt.groupBy("_batch", F.input_file_name()).count().collect()
    assert max(r["count"] for r in sizes) <= 10 and [r["_batch"] for r in sizes].count(0) >= 4


def test_a_long_batch_is_waited_for(spark, tmp_path):
    """Patience is for a query that does nothing, not for a batch that takes longer."""
    replay = Replay(spark.createDataFrame([(0, "t", message(i)) for i in range(3)], "b int, topic string, value string"), "b")
    replay.deliver()
    seen = []

    def slow(df, i):
        n = df.count()
        time.sleep(6 if n else 0)
        seen.append(n)

    query = (G.flush_groups(replay.stream(), 3, 600).writeStream.option("checkpointLocation", str(tmp_path / "progress"))
             .trigger(processingTime="100 milliseconds").foreachBatch(slow).start())
    G.caught_up(query, patience=3)
    query.stop()
    assert seen[0] == 3


def test_groups_are_parsed_apart(spark, tmp_path):
    """The groups of one buffer leave in one task but are parsed and written in several."""
    replay = Replay(spark.createDataFrame([(0, "t", message(i)) for i in range(40)], "b int, topic string, value string"), "b")
    replay.deliver()
    tasks = []

    def look(df, i):
        tasks.append({r[0] for r in df.select(F.spark_partition_id()).collect()})

    query = (G.land_groups(replay.stream(), 2, 600).writeStream.option("checkpointLocation", str(tmp_path / "progress"))
             .trigger(processingTime="100 milliseconds").foreachBatch(look).start())
    G.caught_up(query)
    query.stop()
    assert len(tasks[0]) > 1


def landed(replay, tmp_path, seconds, max_rows=4, lanes=1):
    rows = G.land_groups(replay.stream(), max_rows, seconds, lanes)
    outputs = Outputs.like(rows, str(tmp_path / "out"), every=4)
    return outputs, write_outputs(rows, outputs, str(tmp_path / "progress"), every="200 milliseconds")


def test_groups_by_count_then_by_time(spark, tmp_path):
    """Full groups at once; what is left stays in the state over a restart and leaves when its time has come."""
    rows = [(0, "t", message(i)) for i in range(6)] + [(1, "t", message(i)) for i in range(6, 11)]
    rows += [(1, "u", message(20, "B")), (1, "u", None), (1, "t", "junk"), (1, "t", message(7, trade_id="7")), (1, "t", message(22, price=1.5))]
    replay = Replay(spark.createDataFrame(rows, "b int, topic string, value string"), "b")
    replay.deliver(1)
    outputs, query = landed(replay, tmp_path, seconds=600)
    G.caught_up(query)
    query.stop()
    first = outputs.read("trades").collect()
    assert len(first) == 4 and {r.flush for r in first} == {0}
    replay.deliver()
    outputs, query = landed(replay, tmp_path, seconds=2)
    G.drain(query, 2)
    query.stop()
    trades = outputs.read("trades").collect()
    # A field of the wrong kind is a dead letter; text that is no message at all is skipped.
    assert sorted(r.trade_id for r in trades) == sorted([*range(11), 7, 20])
    dead = outputs.read("dlq").collect()
    assert [json.loads(r.value)["trade_id"] for r in dead] == [22] and dead[0].key == "unknown"
    sizes = {}
    for r in [*trades, *dead]:
        sizes[r.topic, r.flush] = sizes.get((r.topic, r.flush), 0) + 1
    assert max(sizes.values()) <= 4 and [t for t, _ in sizes].count("u") == 1


def test_a_batch_done_again_does_not_end_the_wait(spark, tmp_path):
    """An empty batch that was planned before the stop says nothing about rows that came after it."""
    rows = [(i // 4, "t", message(i)) for i in range(16)]
    replay = Replay(spark.createDataFrame(rows, "b int, topic string, value string"), "b")
    replay.deliver(1)
    _, query = landed(replay, tmp_path, seconds=600)
    G.caught_up(query)
    query.stop()
    planned = max(int(n) for n in files.names(spark, str(tmp_path / "progress/offsets")) if n.isdigit())
    for name in (str(planned), f".{planned}.crc"):
        files.remove(spark, str(tmp_path / "progress/commits" / name))
    replay.deliver()
    outputs, query = landed(replay, tmp_path, seconds=600)
    G.caught_up(query)
    query.stop()
    assert sorted(r.trade_id for r in outputs.read("trades").collect()) == list(range(16))


def test_lanes_share_a_topic(spark, tmp_path):
    replay = Replay(spark.createDataFrame([(0, "t", message(i)) for i in range(40)], "b int, topic string, value string"), "b")
    replay.deliver()
    outputs, query = landed(replay, tmp_path, seconds=1, max_rows=8, lanes=3)
    G.drain(query, 1)
    query.stop()
    rows = outputs.read("trades").collect()
    assert sorted(r.trade_id for r in rows) == list(range(40)) and {r.lane for r in rows} == {0, 1, 2}


def test_bounds_are_checked(spark):
    for bad in ({"max_rows": 0}, {"seconds": 0}, {"lanes": 0}):
        with pytest.raises(ValueError):
            G.flush_groups(spark.createDataFrame([], "topic string, value string"), **bad)


def test_state_does_not_count_its_rows(spark):
    """A count costs a look-up for each row that is written or removed."""
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows") == "false"

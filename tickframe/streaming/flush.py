"""Landing buffers: messages leave in groups, cut at a number of rows or at a time, whichever comes first.

Each topic has a buffer in the state of the stream (several lanes of it, if it is busy, so that it is not
one task). A buffer that reaches ``max_rows`` gives groups of exactly that size at once. What is left gets
a timer: when its first row has waited for ``seconds``, it leaves as a smaller group. A stopped stream keeps its buffers in the
checkpoint and goes on with them, so a restart neither loses nor repeats a message. At most ``max_rows`` - 1 messages of a lane are held.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickframe.operators.events import split_tagged, tag_events, unwrap_envelope
from tickframe.streaming.outputs import Output, tag_outputs

GROUPS = "topic string, lane int, flush long, value string"
STATE = "held array<string>, since long, flush long"


def flush_groups(messages: DataFrame, max_rows: int = 1000, seconds: float = 30, lanes: int = 1) -> DataFrame:
    """Stream of (topic, value) to rows of (topic, lane, flush, value); a flush is one group of a lane, numbered from 0.

    Null values (tombstones) are skipped; a null topic is a topic.
    """
    if max_rows < 1 or seconds <= 0 or lanes < 1:
        raise ValueError("max_rows, seconds and lanes must be above zero")
    wait = int(seconds * 1000)

    def buffer(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, since, flush = state.get if state.exists else ([], 0, 0)
        held = list(held)

        def group(rows: list[str]) -> pd.DataFrame:
            return pd.DataFrame({"topic": key[0], "lane": key[1], "flush": flush, "value": rows})

        if state.hasTimedOut:
            yield group(held)
            state.update(([], 0, flush + 1))
            return
        now = state.getCurrentProcessingTimeMs()
        for frame in frames:
            values = frame["value"].tolist()
            while len(held) + len(values) >= max_rows:
                take = max_rows - len(held)
                yield group(held + values[:take])
                held, values, since, flush = [], values[take:], now, flush + 1
            held += values
        since = since or now
        state.update((held, since if held else 0, flush))
        if held:
            state.setTimeoutDuration(max(1, since + wait - now))

    lane = F.pmod(F.xxhash64("value"), F.lit(lanes)).cast("int")
    keyed = messages.filter(F.col("value").isNotNull()).select("topic", lane.alias("lane"), "value")
    return keyed.groupBy("topic", "lane").applyInPandasWithState(buffer, GROUPS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def tag_messages(df: DataFrame, carried: tuple[str, ...] = (), at=None) -> DataFrame:
    """Raw messages tagged for the outputs trades, klines and dlq, each with the columns ``carried``.

    Messages are checked strictly: one that lacks a field, or holds another kind of value in it, goes to dlq
    as it came. Folders are the symbol and the day of ``at``, by default that of arrival.
    """
    events = tag_events(unwrap_envelope(df))
    at = F.current_timestamp() if at is None else at
    good, kind, rest = F.col("is_valid"), F.col("kind"), [F.col(c) for c in carried]
    own = {n: f.schema.names for n, f in split_tagged(events)._asdict().items()}
    dead = F.struct("kind", F.lit("unknown").alias("key"), F.col("value").alias("value"), *rest)
    return tag_outputs(events, {
        "trades": Output(F.struct(*[F.col(f"trade.{c}") for c in own["trades"]], *rest), good & (kind == "trade"), F.col("trade.symbol"), at),
        "klines": Output(F.struct(*[F.col(f"bar.{c}") for c in own["klines"]], *rest), good & (kind == "kline"), F.col("bar.symbol"), at),
        "dlq": Output(dead, ~good, F.lit(None).cast("string"), at),
    })


def land_groups(messages: DataFrame, max_rows: int = 1000, seconds: float = 30, lanes: int = 1) -> DataFrame:
    """Stream of (topic, value) to tagged bronze rows, each with the topic, lane and flush it left in.

    Groups leave a buffer one after the other; they are dealt out again before their messages are parsed.
    """
    groups = flush_groups(messages, max_rows, seconds, lanes)
    # By a computed column: rows straight from the state operator cannot be shuffled.
    dealt = groups.withColumn("_group", F.xxhash64("topic", "lane", "flush")).repartition("_group").drop("_group")
    return tag_messages(dealt, ("topic", "lane", "flush"))


def _wait(query: StreamingQuery, since: float, empty: bool, patience: float) -> None:
    """Wait for the end of a batch that has begun after ``since`` and, if ``empty``, has brought no rows.

    The first batch of a run may be one that an earlier run has planned and not finished: that it is empty does not
    say what has come since. So an empty one counts only after another batch.
    Time in which a batch is at work does not count: how long one takes depends on what it holds.
    """
    end, last, first = max(since, time.time()) + patience, None, None
    while time.time() < end:
        done, working = query.lastProgress, query.status["isTriggerActive"]
        if done and first is None:
            first = done["batchId"]
        if done and datetime.fromisoformat(done["timestamp"].replace("Z", "+00:00")).timestamp() > since and not (
                empty and (done["numInputRows"] or done["batchId"] == first)):
            return
        if not query.isActive:
            raise query.exception() or RuntimeError("the query has stopped")
        if working or done and done["batchId"] != last:
            end, last = max(end, time.time() + patience), done and done["batchId"]
        time.sleep(0.2)
    raise TimeoutError(f"no such batch, and none at work for {patience} s")


def caught_up(query: StreamingQuery, patience: float = 120) -> None:
    """Wait until a batch finds nothing new. (A query with timers always has a next batch, so ``processAllAvailable`` never returns.)

    ``patience``: seconds without a batch at work after which to give up. A source that brings rows in every batch is never caught up.
    """
    _wait(query, time.time(), True, patience)


def drain(query: StreamingQuery, seconds: float, patience: float = 120) -> None:
    """Wait until all there is has been read and every buffer's time has come; the query must have a short trigger."""
    caught_up(query, patience)
    _wait(query, time.time() + seconds, False, patience)

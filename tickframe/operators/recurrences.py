"""EMA, RSI and MACD: recurrences y[k] = a*x[k] + (1-a)*y[k-1] over long series.

Spark has no built-in for a value that depends on its own previous value. Each step is linear in
the state, so a block can be scanned without knowing what came before it:

1. per block, the state it ends with when it starts from zero;
2. over one small row per block, in a tree of super-blocks, the true state each block starts from;
3. per block again, the scan from that state.

Steps 1 and 3 run on Arrow batches per (series, block) and share one shuffle; step 2 streams over
sorted rows of at most FAN blocks or super-blocks and keeps one state at a time. The results are those of the serial loop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.operators.series import BARS, BLOCK_ROWS, Series, framed, plain, spread


def _make_smooth() -> Callable:
    """Scan of one linear recurrence; a closure, so workers need no installed package."""

    def smooth(x, alpha: float, start: float):
        import numpy as np
        import pandas as pd

        seeded = pd.Series(np.concatenate(([start], x)))
        return seeded.ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]

    return smooth


#: Blocks that are walked by one task: of a super-block, and super-blocks of a series.
FAN = 4096


def _walk(rows: DataFrame, keys: list[str], order: str, layout: T.StructType, step: Callable) -> DataFrame:
    """Stream over ``rows`` sorted by ``keys`` and ``order`` with one state per group of ``keys``.

    ``step(state or None, row) -> (state, values)``; a row is (order, n, head, end), values are the columns of ``layout`` after the keys.
    """
    needed = [order, "_n", "_head", "_end"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            found = []
            columns = [batch.column(k).to_pylist() for k in keys]
            for key, body in zip(zip(*columns), zip(*[batch.column(c).to_pylist() for c in needed])):
                if key != current:
                    current, state = key, None
                state, values = step(state, body)
                found.append(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keys]
                + [pa.array([v[i] for v in found], _ARROW[f.dataType.typeName()]) for i, f in enumerate(layout.fields[len(keys):])],
                names=layout.names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(walk, layout)


_ARROW = {"long": pa.int64(), "double": pa.float64(), "array": pa.list_(pa.float64())}


def _carry_states(ends: DataFrame, series: Series, advance: Callable, fan: int | None = None) -> DataFrame:
    """Step 2: the true state that each block starts from, by ``advance(state or None, n, head, end) -> (start, next)``.

    A block maps the state before it to the one after it: A to the power of its rows, applied, plus its end from zero.
    Such maps compose, and their composition has the same form. So the blocks are walked in a tree of two levels: the blocks of
    every super-block on their own, starting from zero, then the super-blocks of a series from its true start. A task holds one
    state and walks at most ``fan`` rows a group; ``fan`` squared blocks are more rows than a series can have.
    """
    fan, keys = fan or FAN, list(series.keys)
    tall = ends.withColumn("_super", F.expr(f"_block div {fan}"))

    def own(*fields) -> T.StructType:
        return T.StructType([ends.schema[k] for k in keys] + [T.StructField(n, t) for n, t in fields])

    number, states = T.LongType(), T.ArrayType(T.DoubleType())

    def inner(state, body):
        """From zero: what the blocks of a super-block before this one come to, and with it."""
        block, n, head, end = body
        rows, first, total = state or (0, head, [0.0] * len(end))
        after = [float(v) for v in advance(total, n, head, end)[1]]
        return (rows + n, first, after), (block, rows, total, rows + n, first, after)

    partial = _walk(tall, [*keys, "_super"], "_block", T.StructType(
        [ends.schema[k] for k in keys] + [T.StructField("_super", number), T.StructField("_block", number),
         T.StructField("_rows", number), T.StructField("_before", states), T.StructField("_n", number),
         T.StructField("_head", T.DoubleType()), T.StructField("_end", states)]), inner)
    # A super-block is what its last block has come to.
    last = F.max(F.struct("_block", "_n", "_head", "_end")).alias("b")
    supers = partial.groupBy(*keys, "_super").agg(last).select(*keys, "_super", "b._n", "b._head", "b._end")

    def outer(state, body):
        place, n, head, end = body
        start, following = advance(state, n, head, end)
        return [float(v) for v in following], (place, start)

    roots = _walk(supers, keys, "_super", own(("_super", number), ("_root", states)), outer)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = []
            for n, before, root in zip(*[batch.column(c).to_pylist() for c in ("_rows", "_before", "_root")]):
                # The map of the blocks before, on the state of the super-block.
                starts.append([float(v) for v in advance(root, n, 0.0, before)[1]] if n else root)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [batch.column("_block"), pa.array(starts, pa.list_(pa.float64()))],
                                             names=[*keys, "_block", "_start"])

    joined = partial.select(*keys, "_super", "_block", "_rows", "_before").join(roots, [*keys, "_super"])
    return joined.mapInArrow(settled, own(("_block", number), ("_start", states)))


def _scan(
    blocked: DataFrame,
    x: str,
    series: Series,
    end_state: Callable,
    advance: Callable,
    emit: Callable,
    outputs: list[str],
    shared: Iterable[str],
) -> DataFrame:
    """Run the three steps on a blocked frame; ``_prev`` holds the value before ``x``.

    Step 1 needs few columns, but a narrower frame would be shuffled once more instead of
    sharing the blocks of step 3. A hash of the other columns keeps both plans alike up to there.
    """
    at = [*series.keys, "_block"]
    computed = {"_prev", "_pos", x, *at}
    ends_layout = T.StructType(
        [blocked.schema[k] for k in series.keys]
        + [T.StructField("_block", T.LongType()), T.StructField("_n", T.LongType()),
           T.StructField("_head", T.DoubleType()), T.StructField("_end", T.ArrayType(T.DoubleType()))]
    )

    def summarise(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        values, prev = table[x].to_numpy(), table["_prev"].to_numpy()
        first = table.slice(0, 1).select(at)
        end = end_state(values, prev, first["_block"][0].as_py() == 0)
        return (
            first.append_column("_n", pa.array([len(values)], pa.int64()))
            .append_column("_head", pa.array([float(values[0])], pa.float64()))
            .append_column("_end", pa.array([[float(v) for v in end]], pa.list_(pa.float64())))
        )

    rest = [c for c in shared if c in blocked.columns and c not in computed
            and c in spread(blocked)]
    slim = blocked.select(*at, "_pos", x, "_prev", F.hash(*rest).alias("_rest"))
    ends = slim.filter("_block >= 0").groupBy(*at).applyInArrow(summarise, ends_layout)
    starts = _carry_states(ends, series, advance)

    kept = [c for c in blocked.columns if c not in ("_x", "_prev")]
    out_layout = T.StructType(
        [blocked.schema[c] for c in kept] + [T.StructField(o, T.DoubleType()) for o in outputs])

    def finish(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        values, prev = table[x].to_numpy(), table["_prev"].to_numpy()
        start = table["_start"][0].as_py()
        out = table.select(kept)
        if start is None:
            for name in outputs:
                out = out.append_column(name, pa.nulls(out.num_rows, pa.float64()))
            return out
        for name, value in zip(outputs, emit(values, prev, table["_block"][0].as_py() == 0, start)):
            out = out.append_column(name, pa.array(value, pa.float64()))
        return out

    joined = blocked.join(starts, at, "left")
    return joined.groupBy(*at).applyInArrow(finish, out_layout)


def _scan_series(df: DataFrame, value: str, series: Series, block_rows: int, steps: tuple,
                 outputs: list[str]) -> DataFrame:
    """Cut a plain frame into blocks and scan it."""
    inputs = df.withColumn("_x", F.col(value).cast("double"))
    cut = framed(inputs, {"_prev": F.lag("_x").over(series.block_window())}, series, before=1,
                 block_rows=block_rows, helpers=True)
    return plain(_scan(cut, "_x", series, *steps, outputs, [*df.columns, "_len"]))


def _momentum(
    fast: int | None, slow: int | None, signal: int | None, period: int | None
) -> tuple[Callable, Callable, Callable]:
    """Block functions for MACD (fast, slow, signal) and/or RSI (period)."""
    smooth = _make_smooth()

    def gains_losses(x, prev):
        import numpy as np

        step = x - prev
        return np.where(step > 0, step, 0.0), np.where(step > 0, 0.0, -step)

    def wilder(gain, loss, first_block, start):
        """Average gain and loss per row; rows before the seed are not a number."""
        import numpy as np

        alpha = 1.0 / period
        if not first_block:
            return smooth(gain, alpha, start[0]), smooth(loss, alpha, start[1])
        n = len(gain)
        avg_gain, avg_loss = np.full(n, np.nan), np.full(n, np.nan)
        if n > period:
            seeds = gain[1:period + 1].sum() / period, loss[1:period + 1].sum() / period
            for avg, step, seed in ((avg_gain, gain, seeds[0]), (avg_loss, loss, seeds[1])):
                avg[period] = seed
                avg[period + 1:] = smooth(step[period + 1:], alpha, seed)
        return avg_gain, avg_loss

    def lines(x, start):
        quick = smooth(x, 2.0 / (fast + 1), start[0])
        calm = smooth(x, 2.0 / (slow + 1), start[1])
        line = quick - calm
        return quick, calm, line, smooth(line, 2.0 / (signal + 1), start[2])

    def end_state(x, prev, first_block):
        out = []
        if fast:
            quick, calm, _, trigger = lines(x, (0.0, 0.0, 0.0))
            out += [quick[-1], calm[-1], trigger[-1]]
        if period:
            gain, loss = gains_losses(x, prev)
            avg_gain, avg_loss = wilder(gain, loss, first_block, (0.0, 0.0))
            out += [avg_gain[-1], avg_loss[-1]]
        return out

    def advance(state, n, head, end):
        import numpy as np

        size = len(end)
        step = np.zeros((size, size))
        if fast:
            a, b, c = 2.0 / (fast + 1), 2.0 / (slow + 1), 2.0 / (signal + 1)
            step[0, 0], step[1, 1] = 1 - a, 1 - b
            step[2, :3] = c * (1 - a), -c * (1 - b), 1 - c
        for i in range(3 if fast else 0, size):
            step[i, i] = 1 - 1.0 / period
        if state is None:
            # The first value of a series is its own average; the MACD line starts at zero.
            state = np.zeros(size)
            if fast:
                state[0] = state[1] = head
        following = np.linalg.matrix_power(step, n) @ state + np.array(end)
        return [float(v) for v in state], following

    def emit(x, prev, first_block, start):
        import numpy as np

        out = []
        if period:
            gain, loss = gains_losses(x, prev)
            shift = 3 if fast else 0
            avg_gain, avg_loss = wilder(gain, loss, first_block, start[shift:shift + 2])
            with np.errstate(divide="ignore", invalid="ignore"):
                strength = 100.0 - 100.0 / (1.0 + avg_gain / avg_loss)
            out.append(np.where(np.isnan(avg_gain), 50.0, np.where(avg_loss == 0.0, 100.0, strength)))
        if fast:
            _, _, line, trigger = lines(x, start)
            out += [line, trigger, line - trigger]
        return out

    return end_state, advance, emit


def ema(
    df: DataFrame, n: int, value: str = "close", out: str | None = None,
    series: Series = BARS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exponential moving average with a = 2/(n+1), starting from the first value."""
    alpha = 2.0 / (n + 1)
    smooth = _make_smooth()

    def end_state(x, prev, first_block):
        return [smooth(x, alpha, 0.0)[-1]]

    def advance(state, rows, head, end):
        state = [head] if state is None else state
        return state, [(1.0 - alpha) ** rows * state[0] + end[0]]

    def emit(x, prev, first_block, start):
        return [smooth(x, alpha, start[0])]

    return _scan_series(df, value, series, block_rows, (end_state, advance, emit), [out or f"ema_{n}"])


def rsi(
    df: DataFrame, n: int = 14, value: str = "close", out: str | None = None,
    series: Series = BARS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Relative strength index with Wilder smoothing; 50 for the first ``n`` rows."""
    if block_rows <= n:
        raise ValueError("a block must be longer than the RSI period")
    return _scan_series(df, value, series, block_rows, _momentum(None, None, None, n), [out or f"rsi_{n}"])


def macd(
    df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, value: str = "close",
    series: Series = BARS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds ``macd``, ``macd_signal`` and ``macd_hist``."""
    return _scan_series(df, value, series, block_rows, _momentum(fast, slow, signal, None),
                        ["macd", "macd_signal", "macd_hist"])


def momentum(blocked: DataFrame, x: str, shared: Iterable[str], series: Series = BARS, n: int = 14,
             fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """RSI and MACD of column ``x`` in one scan of a frame that is already in blocks.

    ``shared`` names the columns the frame had when it was cut.
    """
    return _scan(blocked, x, series, *_momentum(fast, slow, signal, n),
                 [f"rsi_{n}", "macd", "macd_signal", "macd_hist"], shared)

"""Ordered series that are too long for one task.

A plain ``Window.partitionBy(symbol, interval)`` sorts a whole series in one task, so a symbol
that holds a third of all rows decides the run time. Here a series is cut twice:

* into *cells*, a coarsening of its order columns that every row can compute by itself (for bars:
  fixed spans of open time). Counting rows per cell is a map-side combined aggregation, and a
  running sum over that small table gives every cell the position of its first row;
* into *blocks* of an exact number of consecutive positions. A block also gets copies of the few
  rows before and after it that a row frame reaches into, so windows run per block and
  give the same values as on the whole series.

Both shuffles spread a hot series over all tasks, and both are functions of the row values only,
so a lost executor's work can be redone with the same outcome. A bar series has at most one row
per interval step, so ten years of one-second bars are 77 thousand cells: that is what a
running sum over the cells of one series sorts.

The order must be total within a series (the dedup of the silver tables sees to that). Rows with a
null key or order column have no place in a series: they are kept, with null results.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickframe.schemas import INTERVAL_MS

BARS_PER_CELL = 4096
BLOCK_ROWS = 16384


def bar_cell(bars: int = BARS_PER_CELL) -> str:
    """A span of open time that holds at most ``bars`` bars of the row's interval."""
    widths = " ".join(f"WHEN '{name}' THEN {ms}" for name, ms in INTERVAL_MS.items())
    return f"open_time div ({bars}L * CASE `interval` {widths} ELSE 60000 END)"


@dataclass(frozen=True)
class Series:
    """Names the series keys, their total order and the order-preserving cells.

    ``cells`` are SQL expressions whose tuple never decreases along ``order``.
    """

    keys: tuple[str, ...] = ("symbol", "interval")
    order: tuple[str, ...] = ("open_time",)
    cells: tuple[str, ...] = (bar_cell(),)

    @property
    def cell_names(self) -> list[str]:
        return [f"_cell{i}" for i in range(len(self.cells))]

    def placed(self) -> Column:
        """True for rows that have a place in a series."""
        ok = F.lit(True)
        for c in (*self.keys, *self.order):
            ok = ok & F.col(c).isNotNull()
        return ok

    def with_cells(self, df: DataFrame) -> DataFrame:
        """Add the cells. Rows without a place are dealt to cells by their hash, so that many of them
        (no symbol, no time) do not meet in one task."""
        loose = F.pmod(F.hash(*self.order, *self.keys, *spread(df)), F.lit(4096)).cast("long")
        return df.withColumns({
            n: F.when(self.placed(), F.expr(e).cast("long")).otherwise(loose) for n, e in zip(self.cell_names, self.cells)})

    def cell_window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, *self.cell_names).orderBy(*self.order)

    def over_cells(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.cell_names)

    def block_window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_block").orderBy("_pos")


BARS = Series()


def _running(counts: DataFrame, keys: list[str], order: list[str], first: str) -> DataFrame:
    """``counts`` with the sum of ``_n`` before each row and over all rows of its keys (``_len``)."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumns({
        first: F.coalesce(F.sum("_n").over(before), F.lit(0)), "_len": F.sum("_n").over(Window.partitionBy(*keys))})


def _offsets(counts: DataFrame, series: Series) -> DataFrame:
    """Rows before each cell (``_first``) and in the whole series (``_len``) from rows per cell.

    With several cell columns in two steps: first over the values of the first column (days, say), then
    over the cells of each value, so that the rows that meet in one task do not grow with the data of a day
    times its days.
    """
    keys, cells = list(series.keys), series.cell_names
    if len(cells) == 1:
        return _running(counts, keys, cells, "_first").drop("_n")
    coarse = _running(counts.groupBy(*keys, cells[0]).agg(F.sum("_n").alias("_n")), keys, cells[:1], "_base").drop("_n")
    fine = _running(counts, [*keys, cells[0]], cells[1:], "_inner").drop("_n", "_len")
    return fine.join(coarse, [*keys, cells[0]]).withColumn("_first", F.col("_base") + F.col("_inner")).drop("_base", "_inner")


def positions(df: DataFrame, series: Series = BARS) -> DataFrame:
    """Add ``_pos`` (0-based rank in the series) and ``_len`` (rows of the series)."""
    celled = series.with_cells(df)
    at = [*series.keys, *series.cell_names]
    counts = celled.filter(series.placed()).groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(counts, series)
    ranked = celled.withColumn("_rank", F.row_number().over(series.cell_window()))
    return (
        ranked.join(offsets, at, "left")
        .withColumn("_pos", F.when(series.placed(), F.col("_first") + F.col("_rank") - 1))
        .drop(*series.cell_names, "_rank", "_first")
    )


def blocks(
    df: DataFrame,
    series: Series = BARS,
    before: int = 0,
    after: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows with ``_pos``, ``_len`` and ``_block``; neighbours within ``before`` rows ahead of a
    block and ``after`` rows behind it appear in that block too, until ``own_rows`` drops them.

    Rows without a place are spread over blocks below zero.
    """
    numbered = positions(df, series)
    low = F.greatest(F.lit(0), F.expr(f"(_pos - {after}) div {block_rows}"))
    high = F.least(F.expr(f"(_len - 1) div {block_rows}"), F.expr(f"(_pos + {before}) div {block_rows}"))
    loose = F.array(-1 - F.pmod(F.hash(*series.order, *series.keys, *spread(df)), F.lit(4096)).cast("long"))
    own = F.when(F.col("_pos").isNotNull(), F.sequence(low, high)).otherwise(loose)
    # Never empty; an inner explode would add a filter that builds the sequence once more.
    return numbered.withColumn("_block", F.explode_outer(own))


def spread(df: DataFrame) -> list[str]:
    """Columns that can be hashed."""
    return [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]


def own_rows(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return df.filter(F.coalesce(F.expr(f"_pos div {block_rows}") == F.col("_block"), F.lit(True)))


def plain(df: DataFrame) -> DataFrame:
    """Drop the helper columns."""
    return df.drop("_pos", "_len", "_block")


def framed(
    df: DataFrame,
    columns: dict[str, Column],
    series: Series = BARS,
    before: int = 0,
    after: int = 0,
    block_rows: int = BLOCK_ROWS,
    helpers: bool = False,
) -> DataFrame:
    """Add window ``columns`` written over ``series.block_window()`` that look at most ``before``
    rows back and ``after`` rows ahead."""
    known = {name: F.when(F.col("_pos").isNotNull(), c) for name, c in columns.items()}
    out = own_rows(blocks(df, series, before, after, block_rows).withColumns(known), block_rows)
    return out if helpers else plain(out)


def neighbours(
    df: DataFrame,
    value: str,
    series: Series = BARS,
    previous: str | None = None,
    following: str | None = None,
) -> DataFrame:
    """Lag and/or lead by one row with a single shuffle of the rows.

    Inside a cell a window finds the neighbour; across cells it is the last (first) value of the
    next cell that has rows, taken from a per-cell aggregate.
    """
    celled = series.with_cells(df)
    at = [*series.keys, *series.cell_names]
    order = F.col(series.order[0]) if len(series.order) == 1 else F.struct(*series.order)
    edges, picks = [], {}
    if previous:
        edges.append(F.max_by(value, order).alias("_last"))
        picks["_before"] = F.lag("_last").over(series.over_cells())
    if following:
        edges.append(F.min_by(value, order).alias("_head"))
        picks["_after"] = F.lead("_head").over(series.over_cells())
    known = celled.filter(series.placed())
    carried = known.groupBy(*at).agg(*edges).withColumns(picks).select(*at, *picks)
    w = series.cell_window()
    out = {}
    if previous:
        out["_first_in_cell"] = F.lag(F.lit(True)).over(w).isNull()
        out[previous] = F.lag(value).over(w)
    if following:
        out["_last_in_cell"] = F.lead(F.lit(True)).over(w).isNull()
        out[following] = F.lead(value).over(w)
    joined = celled.withColumns(out).join(carried, at, "left")
    if previous:
        near = F.when(F.col("_first_in_cell"), F.col("_before")).otherwise(F.col(previous))
        joined = joined.withColumn(previous, F.when(series.placed(), near))
    if following:
        near = F.when(F.col("_last_in_cell"), F.col("_after")).otherwise(F.col(following))
        joined = joined.withColumn(following, F.when(series.placed(), near))
    return joined.drop(*series.cell_names, *picks, "_first_in_cell", "_last_in_cell")


def fill_gaps(df: DataFrame, columns: Iterable[str], series: Series = BARS) -> DataFrame:
    """Replace nulls by the next non-null value of the series, else by the last one before."""
    columns = list(columns)
    celled = series.with_cells(df)
    at = [*series.keys, *series.cell_names]
    order = F.col(series.order[0]) if len(series.order) == 1 else F.struct(*series.order)
    edges = []
    for c in columns:
        known = F.when(F.col(c).isNotNull(), order)
        edges += [F.min_by(c, known).alias(f"_head_{c}"), F.max_by(c, known).alias(f"_tail_{c}")]
    up = series.over_cells().rowsBetween(Window.unboundedPreceding, -1)
    down = (Window.partitionBy(*series.keys)
            .orderBy(*[F.col(n).desc() for n in series.cell_names])
            .rowsBetween(Window.unboundedPreceding, -1))
    picks = {}
    for c in columns:
        picks[f"_next_{c}"] = F.last(f"_head_{c}", ignorenulls=True).over(down)
        picks[f"_prev_{c}"] = F.last(f"_tail_{c}", ignorenulls=True).over(up)
    known = celled.filter(series.placed())
    carried = known.groupBy(*at).agg(*edges).withColumns(picks).select(*at, *picks)
    forward = series.cell_window().rowsBetween(Window.unboundedPreceding, 0)
    backward = (Window.partitionBy(*at).orderBy(*[F.col(o).desc() for o in series.order])
                .rowsBetween(Window.unboundedPreceding, 0))
    inside = {}
    for c in columns:
        inside[f"_up_{c}"] = F.last(c, ignorenulls=True).over(forward)
        inside[f"_down_{c}"] = F.last(c, ignorenulls=True).over(backward)
    joined = celled.withColumns(inside).join(carried, at, "left")
    filled = {
        c: F.coalesce(c, F.when(series.placed(), F.coalesce(
            f"_down_{c}", f"_next_{c}", f"_up_{c}", f"_prev_{c}"))) for c in columns
    }
    return joined.withColumns(filled).drop(*series.cell_names, *inside, *picks)

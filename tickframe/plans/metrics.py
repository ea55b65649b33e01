"""Named measures over fact tables, views on them, and rollups that answer coarser queries."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.sources.sinks import export_csv


class UnknownMember(ValueError):
    """A query names a dimension or measure the view does not have."""


@dataclass(frozen=True)
class Measure:
    """``kind`` is sum, avg, max, min or stddev (sample) of ``column``."""

    kind: str
    column: str

    def direct(self) -> Column:
        x = F.col(self.column)
        plain = {"sum": F.sum, "max": F.max, "min": F.min}
        if self.kind in plain:
            return plain[self.kind](x)
        return {"avg": F.avg, "stddev": F.stddev_samp}[self.kind](x.cast("double"))

    def partial(self, name: str) -> dict[str, Column]:
        """Columns a rollup stores so that the measure can be combined again."""
        x = F.col(self.column)
        if self.kind in ("sum", "max", "min"):
            return {name: self.direct()}
        d = x.cast("double")
        kept = {f"{name}__n": F.count(d), f"{name}__sum": F.coalesce(F.sum(d), F.lit(0.0))}
        if self.kind == "stddev":
            # Sum of squared distances from the mean of the stored group.
            kept[f"{name}__m2"] = F.coalesce(F.var_pop(d) * F.count(d), F.lit(0.0))
        return kept

    def combine(self, name: str) -> Column:
        """The measure from stored columns; a deviation also needs ``<name>__mean``, the mean of the whole group."""
        if self.kind in ("sum", "max", "min"):
            return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](name)
        n = F.sum(f"{name}__n")
        if self.kind == "avg":
            return F.try_divide(F.sum(f"{name}__sum"), n)
        return F.when(n > 1, F.sqrt(F.try_divide(self.spread(name), n - 1)))

    def spread(self, name: str) -> Column:
        """Squared distances from the common mean: those within the stored groups and those of their means.

        Means are subtracted before they are squared, so that nothing cancels out.
        """
        n, mean = F.col(f"{name}__n"), F.try_divide(F.col(f"{name}__sum"), F.col(f"{name}__n"))
        off = mean - F.col(f"{name}__mean")
        return F.sum(F.col(f"{name}__m2") + F.coalesce(n * off * off, F.lit(0.0)))

    def merge(self, name: str) -> dict[str, Column]:
        """The stored columns of several states merged into one."""
        if self.kind in ("sum", "max", "min"):
            return {name: self.combine(name)}
        kept = {f"{name}__n": F.sum(f"{name}__n"), f"{name}__sum": F.sum(f"{name}__sum")}
        return kept | ({f"{name}__m2": self.spread(name)} if self.kind == "stddev" else {})


@dataclass(frozen=True)
class Cube:
    """Measures and dimensions of one fact table."""

    table: str
    primary_key: str
    measures: dict[str, Measure]
    dimensions: tuple[str, ...]
    time: str


@dataclass(frozen=True)
class View:
    """The members of a cube that queries may use."""

    name: str
    cube: Cube
    includes: tuple[str, ...]

    def require(self, dimensions: list[str], measures: list[str]) -> None:
        for kind, names, known in (("dimension", dimensions, self.cube.dimensions),
                                   ("measure", measures, self.cube.measures)):
            for n in names:
                if n not in known or n not in self.includes:
                    raise UnknownMember(f"view {self.name} has no {kind} {n!r}")


@dataclass(frozen=True)
class RollupSpec:
    """A summary table: dimensions, one time granularity, measures."""

    cube: Cube
    dimensions: tuple[str, ...]
    granularity: str
    measures: tuple[str, ...]


@dataclass(frozen=True)
class Rollup:
    spec: RollupSpec
    data: DataFrame = field(compare=False)


# Which coarser units a stored unit adds up to.
COARSER = {
    "hour": {"hour", "day", "week", "month", "quarter", "year"},
    "day": {"day", "week", "month", "quarter", "year"},
    "week": {"week"},
    "month": {"month", "quarter", "year"},
    "quarter": {"quarter", "year"},
    "year": {"year"},
}


def _bucket(time: str, granularity: str) -> Column:
    return F.date_trunc(granularity, F.col(time).cast("timestamp")).alias(time)


def rollup_table(facts: DataFrame, spec: RollupSpec, counted: bool = False) -> DataFrame:
    """Summary rows per dimensions and time bucket with re-combinable measure columns; ``counted`` adds the number of facts."""
    stored = {"facts": F.count(F.lit(1))} if counted else {}
    for name in spec.measures:
        stored.update(spec.cube.measures[name].partial(name))
    return facts.groupBy(*spec.dimensions, _bucket(spec.cube.time, spec.granularity)).agg(
        *[c.alias(n) for n, c in stored.items()])


def build_rollup(facts: DataFrame, spec: RollupSpec) -> Rollup:
    return Rollup(spec, rollup_table(facts, spec))


def _with_means(states: DataFrame, cube: Cube, keys: list[str], measures: Iterable[str]) -> DataFrame:
    """States with the mean of their group of ``keys`` for every deviation; the grouping that follows needs no other shuffle."""
    spread = [m for m in measures if cube.measures[m].kind == "stddev"]
    own = Window.partitionBy(*keys)
    return states.withColumns({
        f"{m}__mean": F.try_divide(F.sum(f"{m}__sum").over(own), F.sum(f"{m}__n").over(own)) for m in spread})


def combined(states: DataFrame, cube: Cube, groups: list[Column], measures: list[str]) -> DataFrame:
    """Measures by ``groups`` from rows of stored states."""
    keys = [f"_g{k}" for k in range(len(groups))]
    keyed = states.select("*", *[g.alias(k) for g, k in zip(groups, keys)])
    names = states.select(*groups).columns
    out = _with_means(keyed, cube, keys, measures).groupBy(*keys).agg(*[cube.measures[m].combine(m).alias(m) for m in measures])
    return out.withColumnsRenamed(dict(zip(keys, names)))


def merged_states(states: DataFrame, spec: RollupSpec, keys: list[str]) -> DataFrame:
    """One state per ``keys`` from several; a count of facts is added up."""
    merged = {"facts": F.sum("facts")} if "facts" in states.columns else {}
    for m in spec.measures:
        merged |= spec.cube.measures[m].merge(m)
    return _with_means(states, spec.cube, keys, spec.measures).groupBy(*keys).agg(*[c.alias(n) for n, c in merged.items()])


def query_rollup(rollup: Rollup, dimensions: list[str], measures: list[str],
                 granularity: str | None = None) -> DataFrame:
    """Answer a query from a rollup; the time dimension is bucketed by ``granularity``."""
    cube = rollup.spec.cube
    groups = [_bucket(d, granularity) if d == cube.time and granularity else F.col(d) for d in dimensions]
    return combined(rollup.data, cube, groups, measures)


def _serves(spec: RollupSpec, cube: Cube, dimensions: list[str], measures: list[str],
            granularity: str | None) -> bool:
    timed = cube.time in dimensions
    plain = set(dimensions) - {cube.time}
    return (
        spec.cube == cube and plain <= set(spec.dimensions) and set(measures) <= set(spec.measures)
        and (not timed or granularity in COARSER[spec.granularity])
    )


def query(
    view: View,
    facts: DataFrame,
    dimensions: list[str],
    measures: list[str],
    granularity: str | None = None,
    rollups: tuple[Rollup, ...] = (),
) -> DataFrame:
    """Measures by dimensions, from the first rollup that can answer it, else from the facts."""
    view.require(dimensions, measures)
    cube = view.cube
    for r in rollups:
        if _serves(r.spec, cube, dimensions, measures, granularity):
            return query_rollup(r, dimensions, measures, granularity)
    groups = [_bucket(d, granularity) if d == cube.time and granularity else F.col(d) for d in dimensions]
    return facts.groupBy(*groups).agg(*[cube.measures[m].direct().alias(m) for m in measures])


def without_prefix(df: DataFrame, view: View) -> DataFrame:
    """``view.column`` headers as plain column names."""
    return df.toDF(*[c.removeprefix(f"{view.name}.") for c in df.columns])


# The names of tables, measures, dimensions and views below.
def _ohlcv_cube(table: str, key: str, time: str) -> Cube:
    return Cube(
        table, key,
        {
            "total_volume": Measure("sum", "volume"),
            "total_quote_volume": Measure("sum", "quote_volume"),
            "total_trades": Measure("sum", "num_trades"),
            "avg_close": Measure("avg", "close"),
            "max_high": Measure("max", "high"),
            "min_low": Measure("min", "low"),
        },
        ("symbol", time, "open", "high", "low", "close"), time,
    )


DAILY = _ohlcv_cube("fct_daily_klines", "daily_kline_id", "trade_date")
HOURLY = _ohlcv_cube("fct_hourly_klines", "hourly_kline_id", "hour_at")
RETURNS = Cube(
    "fct_kline_returns", "kline_return_id",
    {"avg_log_return": Measure("avg", "log_return"), "stddev_log_return": Measure("stddev", "log_return")},
    ("symbol", "interval", "open_at", "close", "log_return"), "open_at",
)

OHLCV_DAILY = View("ohlcv_daily", DAILY, (*DAILY.dimensions, *DAILY.measures))
OHLCV_HOURLY = View("ohlcv_hourly", HOURLY, (*HOURLY.dimensions, *HOURLY.measures))
PRICE_ANALYTICS = View("price_analytics", RETURNS, (*RETURNS.dimensions, *RETURNS.measures))

DAILY_ROLLUP = RollupSpec(DAILY, ("symbol",), "day", tuple(DAILY.measures))
HOURLY_ROLLUP = RollupSpec(HOURLY, ("symbol",), "hour", tuple(HOURLY.measures))
RETURNS_ROLLUP = RollupSpec(RETURNS, ("symbol", "interval"), "hour", tuple(RETURNS.measures))
RETURNS_DAILY_ROLLUP = RollupSpec(RETURNS, ("symbol", "interval"), "day", tuple(RETURNS.measures))

# What is exported of each view.
EXPORTS = [
    (OHLCV_DAILY, ["symbol", "trade_date"]),
    (OHLCV_HOURLY, ["symbol", "hour_at"]),
    (PRICE_ANALYTICS, ["symbol", "interval", "open_at"]),
]


def export_views(facts: dict[str, DataFrame], folder: str) -> list[str]:
    """One CSV per view from the fact tables, keyed by table name."""
    return [
        export_csv(query(v, facts[v.cube.table], dims, list(v.cube.measures)), folder, v.name)
        for v, dims in EXPORTS
    ]

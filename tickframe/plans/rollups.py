"""Stored rollups: mergeable states below time folders, refreshed load by load, and answers from them.

``state/folder=/part=`` holds the partial states of one load in one time folder (of days for hourly buckets, of months for
daily ones). ``_record`` has a row per folder and load, with the number of stored and of summarised rows, and until when the load is
complete. A load counts once its record is written, in one file; one that is repeated under its name replaces its own files and is
recorded once. Loads add to what is there, since states can be merged; a load that ``replaces`` stands alone in the folders it
touches. Folders that no load touches are neither read nor written. ``compact`` merges the parts of a folder.

A query is answered by the cheapest rollup that has its members: closed buckets from stored states, what came
after them from the facts, summarised alike, and both merged. Only files of folders in the asked span are read.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.plans.metrics import RollupSpec, View, _bucket, _serves, combined, merged_states, query, rollup_table
from tickframe.sources import files

#: The folder unit of a bucket unit, and its date pattern.
FOLDER = {"hour": "yyyy-MM-dd", "day": "yyyy-MM", "week": "yyyy", "month": "yyyy", "quarter": "yyyy", "year": "yyyy"}
_RECORD = "seq long, load string, folder string, rows long, facts long, replaces boolean, upto timestamp"


class Held(NamedTuple):
    """What a store has: rows of states and of facts behind them, and the time before which it is complete."""

    rows: int
    facts: int
    upto: datetime | None


class RollupStore:
    """The stored rollup ``spec`` below ``root``."""

    def __init__(self, spark: SparkSession, root: str, spec: RollupSpec):
        self.spark, self.root, self.spec = spark, root.rstrip("/"), spec

    # --- what is there ---

    def record(self) -> list:
        path = f"{self.root}/_record"
        if not files.exists(self.spark, path):
            return []
        return sorted(self.spark.read.schema(_RECORD).parquet(path).collect(), key=lambda r: (r["seq"], r["folder"] or ""))

    def parts(self) -> list:
        """The record of the parts that count: of every folder, those since the last one that replaces."""
        found: dict[str, list] = {}
        for r in self.record():
            if r["folder"] is not None:
                found.setdefault(r["folder"], []).append(r)
        kept = []
        for own in found.values():
            last = max((k for k, r in enumerate(own) if r["replaces"]), default=0)
            kept += own[last:]
        return kept

    def held(self) -> Held:
        parts = self.parts()
        upto = max((r["upto"] for r in self.record() if r["upto"]), default=None)
        return Held(sum(r["rows"] for r in parts), sum(r["facts"] for r in parts), upto)

    def covered(self) -> DataFrame:
        """folder, loads, rows and facts of every stored time folder."""
        rows = [(r["folder"], r["load"], r["rows"], r["facts"]) for r in self.parts()]
        return self.spark.createDataFrame(rows, "folder string, load string, rows long, facts long").groupBy("folder").agg(
            F.count("load").alias("loads"), F.sum("rows").alias("rows"), F.sum("facts").alias("facts"))

    # --- loads ---

    def load(self, facts: DataFrame, name: str, upto: datetime | None = None, replaces: bool = False) -> int:
        """Summarise ``facts`` into the folders they touch; returns how many. A name that is recorded does nothing.

        With ``replaces``, ``facts`` must be all facts of these folders. ``upto`` says that no fact before it is missing any more; it must
        be the start of a bucket. Facts without a time are stored in a folder of their own.
        """
        if name in {r["load"] for r in self.record()}:
            return 0
        time, unit = self.spec.cube.time, self.spec.granularity
        if upto is not None and self.spark.range(1).select(F.date_trunc(unit, F.lit(upto)) != F.lit(upto)).first()[0]:
            raise ValueError(f"{upto} is not the start of a {unit}")
        states = rollup_table(facts, self.spec, counted=True)
        return self._write(states.withColumn("folder", F.coalesce(F.date_format(time, FOLDER[unit]), F.lit("none"))), name, upto, replaces)

    def _write(self, states: DataFrame, name: str, upto: datetime | None, replaces: bool) -> int:
        keys = ["folder", "part"]
        (states.withColumn("part", F.lit(name)).hint("rebalance", *keys).sortWithinPartitions(*keys, self.spec.cube.time)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{self.root}/state"))
        written = self.spark.read.schema(self._layout(states)).parquet(f"{self.root}/state").filter(F.col("part") == name)
        seq = max((r["seq"] for r in self.record()), default=-1) + 1
        rows = written.groupBy("folder").agg(F.count("*").alias("rows"), F.sum("facts").alias("facts")).collect()
        record = [(seq, name, r["folder"], r["rows"], r["facts"], replaces, upto) for r in rows]
        # An empty load is recorded too: it may have moved the time up to which the store is complete.
        record = record or [(seq, name, None, 0, 0, False, upto)]
        self.spark.createDataFrame(record, _RECORD).coalesce(1).write.mode("append").parquet(f"{self.root}/_record")
        return len(rows)

    def _layout(self, states: DataFrame) -> T.StructType:
        own = [f for f in states.schema.fields if f.name not in ("folder", "part")]
        return T.StructType([*own, T.StructField("folder", T.StringType()), T.StructField("part", T.StringType())])

    def compact(self) -> int:
        """Merge the parts of folders that have several; returns how many folders had."""
        many: dict[str, list] = {}
        for r in self.parts():
            many.setdefault(r["folder"], []).append(r)
        many = {k: v for k, v in many.items() if len(v) > 1}
        if not many:
            return 0
        states = self._read([r for own in many.values() for r in own])
        keys = ["folder", *self.spec.dimensions, self.spec.cube.time]
        name = f"compacted-{max(r['seq'] for r in self.record()) + 1}"
        self._write(merged_states(states, self.spec, keys), name, None, True)
        for folder, own in many.items():
            for r in own:
                files.remove(self.spark, f"{self.root}/state/folder={folder}/part={r['load']}")
        return len(many)

    # --- reading ---

    def _read(self, parts: list) -> DataFrame:
        base = f"{self.root}/state"
        return self.spark.read.option("basePath", base).option("partitionOverwriteMode", "dynamic").option(
            "mergeSchema", "false").schema(self._stored_layout()).parquet(
            *[f"{base}/folder={r['folder']}/part={r['load']}" for r in parts])

    def _stored_layout(self) -> T.StructType:
        # Schemas are taken from one stored file; folder names stay text.
        path = next(f"{self.root}/state/folder={r['folder']}/part={r['load']}" for r in self.parts())
        return T.StructType([*self.spark.read.parquet(path).schema.fields, T.StructField("folder", T.StringType()),
                             T.StructField("part", T.StringType())])

    def states(self, since: datetime | None = None, until: datetime | None = None) -> DataFrame | None:
        """Stored states of buckets from ``since`` to before ``until``; None if nothing is stored. Other folders are not opened."""
        pattern = FOLDER[self.spec.granularity].replace("yyyy", "%Y").replace("MM", "%m").replace("dd", "%d")
        low, high = (t.strftime(pattern) if t else None for t in (since, until))
        parts = [r for r in self.parts() if r["folder"] == "none" and not (low or high) or r["folder"] != "none" and (
            (low is None or r["folder"] >= low) and (high is None or r["folder"] <= high))]
        if not parts:
            return None
        rows, time = self._read(parts), F.col(self.spec.cube.time).cast("timestamp")
        if since:
            rows = rows.filter(time >= F.lit(since))
        if until:
            rows = rows.filter(time < F.lit(until))
        return rows


def cheapest(stores: Iterable[RollupStore], view: View, dimensions: list[str], measures: list[str],
             granularity: str | None) -> RollupStore | None:
    """The store that answers with the fewest rows: its states, and the facts after them, at the rate of those it has summarised."""
    fit = [(s, s.held()) for s in stores if _serves(s.spec, view.cube, dimensions, measures, granularity)]
    fit = [(s, h) for s, h in fit if h.upto is not None]
    if not fit:
        return None
    newest = max(h.upto for _, h in fit)
    # The facts that a store lacks, against the store that is complete for longest.
    most = max(h.facts for _, h in fit)
    return min(fit, key=lambda f: (f[1].rows + (most - f[1].facts if f[1].upto < newest else 0), f[1].rows))[0]


def answer(view: View, stores: Iterable[RollupStore], facts: DataFrame, dimensions: list[str], measures: list[str],
           granularity: str | None = None) -> DataFrame:
    """Measures by dimensions: closed buckets from the cheapest store, the open ones from ``facts``, merged.

    Facts before the time up to which the store is complete are not read (the filter reaches their scan). Without a
    store that serves the query, all comes from the facts.
    """
    view.require(dimensions, measures)
    store = cheapest(stores, view, dimensions, measures, granularity)
    if store is None:
        return query(view, facts, dimensions, measures, granularity)
    spec, upto = store.spec, store.held().upto
    time = F.col(spec.cube.time)
    # The bound has the type of the column, so that it can be pushed down.
    bound = F.lit(upto).cast(facts.schema[spec.cube.time].dataType)
    tail = rollup_table(facts.filter((time >= bound) | time.isNull()), spec)
    names = tail.columns
    stored = store.states(until=upto)
    rows = tail if stored is None else stored.select(*names).unionByName(tail)
    groups = [_bucket(d, granularity) if d == spec.cube.time and granularity else F.col(d) for d in dimensions]
    return combined(rows, spec.cube, groups, measures)

"""Several tables fed by one stream: one write per batch, compacted into folders that readers prune.

Every row of a batch is tagged with the output it belongs to, so a batch is computed and written once, however
many outputs it has. A batch has a folder of its own, which a repeated batch replaces.

When a batch starts, all before it are finished and never repeated. Every few batches the finished ones are therefore
merged into ``data/output=/symbol=/day=/part=``, in one more write. A part is named after its batches, so a compaction
that is cut off and done again replaces its own files. A row in ``_parts`` makes a part count; only then are the folders
of its batches removed. Readers take the parts that count and the batches after them, so that they see each row once
at any moment, also after a failure between any two of these steps.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickframe.sources import files

FOLDERS = ["output", "symbol", "day"]
UNKNOWN = "UNKNOWN"


class Output(NamedTuple):
    """What goes to one output: a struct per row, which rows, and the symbol and time of their folders."""

    row: Column
    when: Column
    symbol: Column
    at: Column


def tag_outputs(df: DataFrame, outputs: Mapping[str, Output]) -> DataFrame:
    """Rows of (output, symbol, day, one struct column per output); a row of ``df`` gives one for each output it goes to.

    A missing symbol is UNKNOWN and a missing time 1970-01-01, so that no row is without a folder.
    """
    layout = df.select(*[o.row.alias(n) for n, o in outputs.items()]).schema
    tagged = []
    for name, o in outputs.items():
        own = [(o.row if n == name else F.lit(None)).cast(layout[n].dataType).alias(n) for n in outputs]
        day = F.coalesce(F.date_format(o.at, "yyyy-MM-dd"), F.lit("1970-01-01"))
        tagged.append(F.when(o.when, F.struct(F.lit(name).alias("output"), F.coalesce(o.symbol, F.lit(UNKNOWN)).alias("symbol"),
                                              day.alias("day"), *own)))
    return df.select(F.inline(F.filter(F.array(*tagged), lambda r: r.isNotNull())))


class Outputs:
    """The tables below ``root``; ``layouts`` names them and their columns. ``every`` so many batches are compacted."""

    def __init__(self, spark: SparkSession, root: str, layouts: Mapping[str, T.StructType], every: int = 16):
        self.spark, self.root, self.layouts, self.every = spark, root.rstrip("/"), dict(layouts), every
        self._schema = T.StructType([T.StructField(c, T.StringType()) for c in FOLDERS] + [
            T.StructField(n, s) for n, s in self.layouts.items()])

    @classmethod
    def like(cls, tagged: DataFrame, root: str, every: int = 16) -> Outputs:
        """Outputs with the layout of a tagged frame."""
        return cls(tagged.sparkSession, root, {f.name: f.dataType for f in tagged.schema if f.name not in FOLDERS}, every)

    # --- state ---

    def parts(self) -> list[tuple[int, int]]:
        """First and last batch of every part that counts."""
        path = f"{self.root}/_parts"
        if not files.exists(self.spark, path):
            return []
        return sorted(tuple(r) for r in self.spark.read.schema("first long, last long").parquet(path).distinct().collect())

    def compacted(self) -> int:
        """The last batch that is in a part; -1 at first."""
        return max((last for _, last in self.parts()), default=-1)

    def batches(self) -> list[int]:
        """Batches that have a folder of their own."""
        found = files.names(self.spark, f"{self.root}/_batches")
        return sorted(int(n.removeprefix("batch=")) for n in found if n.startswith("batch="))

    def _folder(self, batch_id: int) -> str:
        return f"{self.root}/_batches/batch={batch_id}"

    # --- writing ---

    def write(self, tagged: DataFrame, batch_id: int) -> None:
        """The sink of a stream of tagged rows."""
        done = self.compacted()
        if batch_id <= done:
            return
        tagged.select(*self._schema.names).write.mode("overwrite").option("compression", "snappy").partitionBy(
            "output").parquet(self._folder(batch_id))
        if batch_id - done > self.every:
            self.compact(batch_id - 1)

    def compact(self, last: int) -> None:
        """Merge the batches up to ``last``, all of them finished, into folders per output, symbol and day."""
        done = self.compacted()
        open_ = [b for b in self.batches() if b > done]
        own = [b for b in open_ if b <= last]
        if own:
            rows = self._pending(own).withColumn("part", F.lit(f"{own[0]}-{own[-1]}"))
            folders = [*FOLDERS, "part"]
            (rows.hint("rebalance", *folders).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .option("compression", "snappy").partitionBy(*folders).parquet(f"{self.root}/data"))
            self.spark.createDataFrame([(own[0], own[-1])], "first long, last long").coalesce(1).write.mode("append").parquet(
                f"{self.root}/_parts")
            done = own[-1]
        for b in self.batches():
            if b <= done:
                files.remove(self.spark, self._folder(b))

    # --- reading ---

    def _pending(self, batches: list[int]) -> DataFrame:
        paths = [self._folder(b) for b in batches]
        held = [p for p in paths if any(n.startswith("output=") for n in files.names(self.spark, p))]
        if not held:
            return self.spark.createDataFrame([], self._schema)
        # Each folder is a table of its own; a common base path would make the batch a column.
        frames = [self.spark.read.schema(self._schema).parquet(p).select(*self._schema.names) for p in held]
        out = frames[0]
        for f in frames[1:]:
            out = out.union(f)
        return out

    def read(self, output: str) -> DataFrame:
        """All rows of an output with ``symbol_key`` and ``day_key``, by which a filter prunes folders."""
        parts = self.parts()
        done = max((last for _, last in parts), default=-1)
        rows = self._pending([b for b in self.batches() if b > done])
        if parts and files.names(self.spark, f"{self.root}/data"):
            layout = T.StructType([*self._schema.fields, T.StructField("part", T.StringType())])
            stored = self.spark.read.schema(layout).parquet(f"{self.root}/data").filter(
                F.col("part").isin([f"{a}-{b}" for a, b in parts]))
            rows = stored.select(*self._schema.names).union(rows)
        return rows.filter(F.col("output") == output).select(
            F.col("symbol").alias("symbol_key"), F.col("day").alias("day_key"), f"{output}.*")


def write_outputs(tagged: DataFrame, outputs: Outputs, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Feed the outputs from a stream of tagged rows; without ``every`` it stops when all there is has been read."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (tagged.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**trigger).foreachBatch(outputs.write).start())

"""Stored rows as a stream that arrives in the same batches every time.

A stream over one table takes all of it in one trigger, in any order. ``Replay`` deals the rows to numbered
batches instead and delivers them in order, each as so many files that one trigger takes exactly one batch.
With it a backfill can go through a streaming job, and what a job does about late and repeated rows can be repeated.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.session import fresh_path


FILE_ROWS = 50_000  # rows of a file, unless their number is given


class Replay:
    """``batch`` numbers each row's batch (null rows come with the first); ``files`` is the number of files of a batch.

    Without ``files`` there are as many as the largest batch has FILE_ROWS, so that batches are written and read by more tasks as they
    grow. Every batch has the same number of files: each holds one row that is no message, which ``stream`` leaves out.
    The rows are staged by batch once, in files of at most FILE_ROWS that tasks read apart, and batches that hold no rows are passed over.
    The driver holds their numbers and sizes alone.
    """

    def __init__(self, rows: DataFrame, batch: str | Column, files: int | None = None):
        self.spark = rows.sparkSession
        self.path, staged = fresh_path(self.spark, "replay"), fresh_path(self.spark, "replay-batches")
        number = F.coalesce((F.col(batch) if isinstance(batch, str) else batch).cast("long"), F.lit(0))
        dealt = rows.withColumn("_batch", number)
        self.layout = rows.schema
        dealt.hint("rebalance", "_batch").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("_batch").parquet(staged)
        self._dealt = self.spark.read.schema(dealt.schema).parquet(staged)
        sizes = dict(self._dealt.groupBy("_batch").count().collect())
        self.waiting = sorted(sizes)
        self.files = files or max(1, ceil(max(sizes.values(), default=0) / FILE_ROWS))

    def deliver(self, batches: int | None = None) -> int:
        """Add the files of the next ``batches`` (all, if none is given); returns how many there were."""
        now, self.waiting = self.waiting[:batches], self.waiting[batches:] if batches is not None else []
        filler = self.spark.range(self.files).select(F.col("id").cast("int").alias("_file"), F.lit(True).alias("_filler"))
        for b in now:
            # A stream takes files by age, and each write ends before the next one begins.
            own = self._dealt.filter(F.col("_batch") == b).drop("_batch").withColumn(
                "_file", F.pmod(F.monotonically_increasing_id(), F.lit(self.files)).cast("int"))
            own.unionByName(filler, allowMissingColumns=True).repartitionById(self.files, "_file").drop("_file").write.mode(
                "append").parquet(self.path)
        return len(now)

    def stream(self) -> DataFrame:
        """What has been and will be delivered, one batch per trigger."""
        return (self.spark.readStream.format("parquet").schema(T.StructType([*self.layout, T.StructField("_filler", T.BooleanType())]))
                .option("maxFilesPerTrigger", self.files).load(self.path)
                .filter("_filler IS NULL").select(*self.layout.names))

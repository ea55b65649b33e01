"""A keyed table that is loaded whole or not at all.

Rows live below ``data/load=/<partitions>``; a load writes new folders beside the old ones and never changes a file that
is in use. ``_record`` says which load holds a partition folder at present: the last one. It gets the folders of a load in one file,
which is the moment the load counts. A load that fails before leaves the table as it was; one that is repeated
under its name does nothing. What a load has to read is found by joining its folders with the record, so neither the
number of stored files nor that of other folders matters to the driver. ``vacuum`` removes folders that no longer count.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.operators.silver import BAR_KEYS, upsert_latest
from tickframe.session import fresh_path
from tickframe.sources import files

#: As Spark writes a null in a folder name.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


class KeyedTable:
    """Parquet rows of ``layout`` below ``root``, at most one per key: the one with the highest ``version``."""

    def __init__(self, spark: SparkSession, root: str, layout: T.StructType, partitions: Iterable[str],
                 keys: Iterable[str] = BAR_KEYS, version: str = "_loaded_at"):
        self.spark, self.root, self.layout = spark, root.rstrip("/"), layout
        self.partitions, self.keys, self.version = list(partitions), list(keys), version

    def _recorded(self) -> T.StructType:
        own = [T.StructField(p, self.layout[p].dataType) for p in self.partitions]
        return T.StructType([T.StructField("seq", T.LongType()), T.StructField("load", T.StringType()), *own])

    def record(self) -> DataFrame:
        """seq, load and partition values of all loads."""
        path = f"{self.root}/_record"
        if not files.exists(self.spark, path):
            return self.spark.createDataFrame([], self._recorded())
        return self.spark.read.schema(self._recorded()).parquet(path)

    def folders(self) -> DataFrame:
        """The load that holds each partition folder at present."""
        last = Window.partitionBy(*self.partitions).orderBy(F.desc("seq"))
        return self.record().filter("load IS NOT NULL").withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")

    def _paths(self, folders: DataFrame) -> list[str]:
        parts = [F.coalesce(F.col(p).cast("string"), F.lit(NULL_FOLDER)).alias(p) for p in self.partitions]
        rows = folders.select("load", *parts).collect()
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return sorted("/".join([f"{self.root}/data/load={r['load']}", *[
            f"{p}={r[p] if r[p] == NULL_FOLDER else escape(r[p])}" for p in self.partitions]]) for r in rows)

    def _read(self, folders: DataFrame) -> DataFrame:
        names = self.layout.names
        paths = self._paths(folders)
        if not paths:
            return self.spark.createDataFrame([], self.layout)
        return self.spark.read.schema(self.layout).option("basePath", f"{self.root}/data").parquet(*paths).select(*names)

    def read(self, where: Column | str | None = None) -> DataFrame:
        """The rows; ``where``, a condition on partition columns, chooses the folders that are opened."""
        chosen = self.folders() if where is None else self.folders().filter(where)
        return self._read(chosen)

    def load(self, new: DataFrame, name: str) -> bool:
        """Merge ``new`` (computed once); false if a load of this name is recorded already."""
        if not re.fullmatch(r"[\w.-]+", name):
            raise ValueError(f"the name of a load is a folder name: {name!r}")
        record = self.record()
        if not record.filter(F.col("load") == name).isEmpty():
            return False
        arrived = fresh_path(self.spark, "arrived")
        names = self.layout.names
        by = [F.col(p) for p in self.partitions]
        new.select(*names).write.parquet(arrived)
        fresh = self.spark.read.schema(self.layout).parquet(arrived)
        touched = fresh.select(*self.partitions).distinct()
        stored = self._read(self.folders().alias("f").join(touched.alias("t"), [
            F.col(f"f.{p}").eqNullSafe(F.col(f"t.{p}")) for p in self.partitions], "left_semi"))
        rows = upsert_latest(fresh, stored, self.keys, self.version)
        (rows.withColumn("load", F.lit(name)).hint("rebalance", *by).sortWithinPartitions(*self.partitions, *self.keys)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load", *self.partitions)
         .parquet(f"{self.root}/data"))
        seq = record.agg(F.coalesce(F.max("seq"), F.lit(-1)) + 1).first()[0]
        done = touched.select(F.lit(seq).cast("long").alias("seq"), F.lit(name).alias("load"), *self.partitions)
        # One file: all folders of a load begin to count at once.
        done.coalesce(1).write.mode("append").parquet(f"{self.root}/_record")
        files.remove(self.spark, arrived)
        return True

    def vacuum(self) -> int:
        """Remove the folders of loads that hold nothing any more, failed ones too; no load may be running. Returns how many."""
        used = {r[0] for r in self.folders().select("load").distinct().collect()}
        gone = [n for n in files.names(self.spark, f"{self.root}/data") if n.startswith("load=") and n.removeprefix("load=") not in used]
        for n in gone:
            files.remove(self.spark, f"{self.root}/data/{n}")
        return len(gone)

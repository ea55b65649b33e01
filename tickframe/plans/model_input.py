"""A stored model input that follows new data: features, the moments of their scaler, and sequences with their split.

All of it lies in folders per symbol. An update rewrites the folders of the symbols it brings and no others. The scaler is
merged from the moments of all folders (count, mean, squared distances from the mean), so it follows an update without
a pass over the features. Sequences are stored as they are and scaled when they are read: each update moves the scaler a little, and
scaled ones would all have to be written again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.operators.mlprep import sequences, temporal_split
from tickframe.operators.series import BARS, BLOCK_ROWS, Series
from tickframe.schemas import FEATURE_COLUMNS, FEATURE_ROW

_MOMENT = "name string, n long, mean double, m2 double, odd long"


def moments(features: DataFrame, by: Iterable[str], columns: Iterable[str] = tuple(FEATURE_COLUMNS)) -> DataFrame:
    """A row per group and feature: finite values, their mean, the squared distances from it, and values that are not finite."""
    found, entries = [], []
    for c in columns:
        x = F.col(c).cast("double")
        odd = F.isnan(x) | (F.abs(x) == float("inf"))
        finite = F.when(~odd, x)
        n = F.count(finite)
        own = F.struct(F.lit(c).alias("name"), n.alias("n"), F.coalesce(F.avg(finite), F.lit(0.0)).alias("mean"),
                       F.coalesce(F.var_pop(finite) * n, F.lit(0.0)).alias("m2"), F.count_if(odd).alias("odd"))
        found.append(own.alias(f"_{c}"))
        entries.append(F.col(f"_{c}"))
    return features.groupBy(*by).agg(*found).select(*by, F.inline(F.array(*entries)))


def merged_scaler(stored: DataFrame, columns: Iterable[str] = tuple(FEATURE_COLUMNS)) -> DataFrame:
    """The one row that ``mlprep.fit_scaler`` gives, from moments. Means are subtracted before they are squared."""
    centres = stored.groupBy("name").agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("centre"))
    off = F.col("mean") - F.col("centre")
    merged = stored.join(centres, "name").groupBy("name").agg(
        F.sum("n").alias("n"), F.max("centre").alias("mean"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"), F.sum("odd").alias("odd"))
    std = F.sqrt(F.try_divide("m2", F.when(F.col("n") > 1, F.col("n") - 1)))
    rows = merged.withColumn("std", F.when(std > 0, std).otherwise(1.0))
    picks = []
    for c in columns:
        own = F.col("name") == c
        picks += [F.max(F.when(own, F.col("mean"))).alias(f"{c}_mean"), F.coalesce(F.max(F.when(own, F.col("std"))), F.lit(1.0)).alias(f"{c}_std"),
                  F.coalesce(F.max(F.when(own, F.col("odd"))), F.lit(0)).alias(f"{c}_odd")]
    return rows.agg(*picks)


class ModelInput:
    """The stored input below ``root``."""

    def __init__(self, spark: SparkSession, root: str, columns: Iterable[str] = tuple(FEATURE_COLUMNS), length: int = 60,
                 share: float = 0.8, series: Series = BARS, block_rows: int = BLOCK_ROWS):
        self.spark, self.root = spark, root.rstrip("/")
        self.columns, self.length, self.share, self.series, self.block_rows = list(columns), length, share, series, block_rows

    def _write(self, df: DataFrame, name: str, folders: list[str]) -> None:
        (df.hint("rebalance", *folders).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*folders).parquet(f"{self.root}/{name}"))

    def _read(self, name: str, layout: T.StructType | str) -> DataFrame:
        return self.spark.read.schema(layout).parquet(f"{self.root}/{name}")

    def update(self, features: DataFrame) -> None:
        """Take in all features of some symbols (others stay as they are). Sequences and moments are made of the stored rows."""
        names = [r[0] for r in features.select("symbol").distinct().collect()]
        if not names:
            return
        self._write(features.select(*FEATURE_ROW.names), "features", ["symbol"])
        own = self._read("features", FEATURE_ROW).filter(F.col("symbol").isin(names))
        self._write(moments(own, ["symbol"], self.columns), "moments", ["symbol"])
        made = sequences(own, self.columns, self.length, series=self.series, block_rows=self.block_rows)
        train, test = temporal_split(made, self.share, self.series)
        parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
        # Sequences of a symbol that has grown shorter than one leave no folder behind.
        self._write(parts.select("symbol", "part", "interval", "open_time", "sequence", "label"), "sequences", ["symbol", "part"])

    def scaler(self) -> DataFrame:
        return merged_scaler(self._read("moments", f"{_MOMENT}, symbol string"), self.columns)

    def read(self, part: str | None = None) -> DataFrame:
        """symbol, interval, open_time, part, the scaled sequence and its label; ``part`` is train or test."""
        stored = self._read("sequences", T.StructType([
            T.StructField("interval", T.StringType()), T.StructField("open_time", T.LongType()),
            T.StructField("sequence", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("label", T.LongType()),
            T.StructField("symbol", T.StringType()), T.StructField("part", T.StringType())]))
        fitted = self.scaler().select(F.struct(
            F.array(*[f"{c}_mean" for c in self.columns]).alias("mean"), F.array(*[f"{c}_std" for c in self.columns]).alias("std"))).scalar()

        def scaled(step: Column) -> Column:
            centred = F.zip_with(step, F.col("_fitted.mean"), lambda x, m: x - m)
            return F.zip_with(centred, F.col("_fitted.std"), lambda x, s: x / s)

        rows = stored if part is None else stored.filter(F.col("part") == part)
        # A column of its own first: a function over arrays may not hold a subquery.
        return rows.withColumn("_fitted", fitted).select("symbol", "interval", "open_time", "part", F.transform("sequence", scaled).alias("sequence"), "label")

"""Writers of lake tables, message frames and text exports."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.functions.columns import ms_to_ts, path_part
from tickframe.operators.silver import BAR_KEYS, upsert_latest
from tickframe.session import fresh_path
from tickframe.sources.lake import read_or_empty


def _by_folder(df: DataFrame, folders: list[str], order: Iterable[str] = ()) -> DataFrame:
    """Each task writes sorted runs of whole folders, which gives few files and tight
    row-group statistics. AQE splits an oversized folder again (it is a plain rebalance)."""
    return df.hint("rebalance", *folders).sortWithinPartitions(*folders, *order)


def write_silver(df: DataFrame, path: str) -> None:
    """Overwrite the (symbol, interval, year, month) folders present in ``df``, no others."""
    folders = ["symbol", "interval", "year", "month"]
    (_by_folder(df, folders, ["open_time"]).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
     .partitionBy(*folders).parquet(path))


def write_rejects(df: DataFrame, path: str, known: int | None = None) -> bool:
    """Append rejected rows; nothing is written when there are none. ``known``: their number, if counted before."""
    if known == 0 or known is None and df.isEmpty():
        return False
    df.write.mode("append").option("compression", "snappy").parquet(path)
    return True


def write_bronze_klines(df: DataFrame, path: str) -> None:
    """Append text-typed bars under symbol/interval/year/month/day of each bar's own open time."""
    ts = ms_to_ts("open_time")
    dated = df.withColumns({
        "year": F.year(ts), "month": path_part(F.month(ts)), "day": path_part(F.dayofmonth(ts)),
    })
    folders = ["symbol", "interval", "year", "month", "day"]
    (_by_folder(dated, folders, ["open_time"]).write.mode("append")
     .option("compression", "snappy").partitionBy(*folders).parquet(path))


def write_live_klines(df: DataFrame, path: str) -> None:
    """Append nested bar events below the same folders as history bars (text-typed, flat), so that one prefix holds both."""
    ts = ms_to_ts("kline.open_time")
    dated = df.withColumns({
        "interval": F.coalesce("kline.interval", F.lit("")), "year": F.year(ts), "month": path_part(F.month(ts)),
        "day": path_part(F.dayofmonth(ts)),
    })
    folders = ["symbol", "interval", "year", "month", "day"]
    (_by_folder(dated, folders, ["event_time"]).write.mode("append")
     .option("compression", "snappy").partitionBy(*folders).parquet(path))


def write_features(df: DataFrame, path: str) -> None:
    """Overwrite the feature table, one folder per symbol."""
    (_by_folder(df, ["symbol"], ["interval", "open_time"]).write.mode("overwrite")
     .partitionBy("symbol").parquet(path))


def _folders(df: DataFrame, root: str) -> set[str]:
    """Partition folders below ``root`` that hold files of a stored table, from its file listing."""
    base = f"{urlsplit(unquote(root)).path.rstrip('/')}/"
    paths = {urlsplit(f).path for f in df.inputFiles()}
    return {unquote(p).rpartition("/")[0].split(base, 1)[-1] for p in paths}


def upsert_table(
    spark: SparkSession,
    new: DataFrame,
    path: str,
    partitions: Iterable[str],
    keys: Iterable[str] = BAR_KEYS,
    version: str = "_loaded_at",
) -> None:
    """Merge ``new`` into a partitioned Parquet table, rewriting only the folders it touches.

    ``new`` is computed once, into a staged table in the shared folder. Its own folders name the ones of
    the table to read, however many they are. The merged rows are staged too, because a plan must not
    overwrite the files it still reads; both staged tables are emptied at the end.
    """
    partitions, root = list(partitions), path.rstrip("/")
    arrived, merged = fresh_path(spark, "arrived"), fresh_path(spark, "merged")
    _by_folder(new, partitions).write.partitionBy(*partitions).parquet(arrived)
    fresh = spark.read.schema(new.schema).parquet(arrived).select(*new.columns)
    stored = read_or_empty(spark, root, new.schema)
    touched = sorted(_folders(fresh, arrived) & _folders(stored, root))
    rows = fresh
    if touched:
        reader = spark.read.schema(new.schema).option("basePath", root)
        rows = upsert_latest(fresh, reader.parquet(*[f"{root}/{t}" for t in touched]).select(*new.columns), keys, version)
    else:
        rows = upsert_latest(fresh, fresh.limit(0), keys, version)
    _by_folder(rows, partitions).write.partitionBy(*partitions).parquet(merged)
    ready = spark.read.schema(new.schema).parquet(merged).select(*new.columns)
    (_by_folder(ready, partitions).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path))
    for staged in (arrived, merged):
        spark.createDataFrame([], new.schema).write.mode("overwrite").parquet(staged)


def to_kafka_json(df: DataFrame, key: str = "symbol", columns: Iterable[str] | None = None,
                  text: Iterable[str] = ()) -> DataFrame:
    """(key, value) message rows: value is the JSON of the columns, ``text`` ones as strings.

    Null fields are left out. A broker sink delivers at least once, so readers must dedup.
    """
    columns, text = list(columns or df.columns), set(text)
    body = F.struct(*[F.col(c).cast("string").alias(c) if c in text else F.col(c) for c in columns])
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(body).alias("value"))


def materialize(df: DataFrame, name: str, kind: str = "view", schema: str | None = None,
                order: Iterable[str] = ()) -> None:
    """A model as a view (staging) or as a table in its schema (marts), sorted by ``order`` within its files."""
    spark = df.sparkSession
    if kind == "view":
        df.createOrReplaceTempView(name)
    elif kind == "table":
        if schema:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}`")
        # Sorted within files; a global sort would compute the whole model once more to sample it.
        stored = df.hint("rebalance", *list(order)[:1]).sortWithinPartitions(*order) if order else df
        stored.write.mode("overwrite").saveAsTable(f"`{schema}`.`{name}`" if schema else f"`{name}`")
    else:
        raise ValueError(f"kind must be 'view' or 'table', not {kind!r}")


def times_as_text(df: DataFrame) -> DataFrame:
    """Timestamps and dates as text, for exports."""
    formats = {"timestamp": "yyyy-MM-dd HH:mm:ss.SSS", "timestamp_ntz": "yyyy-MM-dd HH:mm:ss.SSS",
               "date": "yyyy-MM-dd"}
    return df.withColumns({
        f.name: F.date_format(f.name, formats[f.dataType.typeName()])
        for f in df.schema if f.dataType.typeName() in formats
    })


def export_csv(df: DataFrame, folder: str, name: str) -> str:
    """Write ``fct_<name>.csv`` (a folder of parts) with a header also when there are no rows."""
    path = f"{folder.rstrip('/')}/fct_{name}.csv"
    times_as_text(df).write.mode("overwrite").option("header", True).csv(path)
    return path

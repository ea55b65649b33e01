"""Words, staged tables and other small things the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.session import fresh_path, prepare
from tickframe.sources.files import remove

#: The characters between words; words are everything else. ``bytes.split()`` splits at the same ones.
SPACES = " \t\n\x0b\x0c\r"


def small_batches(spark: SparkSession) -> SparkSession:
    """The prepared session; rows hold whole texts, so few of them go to a Python worker at once."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: computed once, lineage cut.

    The files survive the loss of executors, which a cache or a local checkpoint would not.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in frames:
        remove(df.sparkSession, df.staged_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def trimmed(text: Column) -> Column:
    """The text without spaces at its ends; null counts as empty."""
    return F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def words(text: Column) -> Column:
    """The words of a text as an array; empty for a null text or one without words."""
    inner = trimmed(text)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(
        F.split(inner, r"[\x20\x09-\x0D]+"))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest ``n`` so that at most ``most`` rows of ``counts`` have a column n of at least this, 1 or more."""
    sizes = counts.groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("n")).limit(most + 1).collect()
    held = 0
    for r in sizes:
        held += r["rows"]
        if held > most:
            return r["n"] + 1
    return 1

"""Bronze to silver: typing, validation, dedup, partition columns, counts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickframe.functions.columns import col_of, ms_to_ts, price
from tickframe.schemas import DECIMAL_COLUMNS, KLINE_COLUMNS

BAR_KEYS = ("symbol", "interval", "open_time")


def cast_prices(df: DataFrame, columns: Iterable[str] = tuple(DECIMAL_COLUMNS)) -> DataFrame:
    """Text to decimal(18,8); unreadable numbers become null and are rejected later."""
    return df.withColumns({c: price(c) for c in columns if c in df.columns})


def with_times(df: DataFrame) -> DataFrame:
    return df.withColumns({"open_ts": ms_to_ts("open_time"), "close_ts": ms_to_ts("close_time")})


def with_partitions(df: DataFrame, ts: str = "open_ts") -> DataFrame:
    return df.withColumns({"year": F.year(ts), "month": F.month(ts)})


def raw_name(column: str) -> str:
    return f"{column}_text"


def keep_text(df: DataFrame) -> DataFrame:
    """Copies of the number columns as they came, so that a rejected row still shows what was wrong."""
    return df.withColumns({raw_name(c): F.col(c) for c in DECIMAL_COLUMNS if c in df.columns})


def kline_rules(columns: Iterable[str] = ()) -> dict[str, Column]:
    """Reject reasons of a typed bar; each is true or false, never null.

    ``columns`` are those of the frame: where the text of a number is there, a number that could not be read
    or is out of range is told from a missing one, in optional columns too.
    """
    texts = [c for c in DECIMAL_COLUMNS if raw_name(c) in set(columns)]
    unreadable = {f"{c} unreadable": F.col(raw_name(c)).isNotNull() & F.col(c).isNull() for c in texts}
    keys = {f"{c} missing": F.col(c).isNull() for c in BAR_KEYS}
    missing = {f"{c} missing": F.col(c).isNull() for c in ("open", "close", "volume")}
    return {**keys, **unreadable, **missing, "volume negative": F.coalesce(F.col("volume") < 0, F.lit(False))}


def reject_reason(rules: Mapping[str, Column]) -> Column:
    """Name of the first rule a row breaks, null for a valid row."""
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])


def split_valid(
    df: DataFrame, rules: Mapping[str, Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with a ``reject_reason``."""
    tagged = df.withColumn("reject_reason", reject_reason(rules or kline_rules(df.columns)))
    valid = tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return valid, tagged.filter(F.col("reject_reason").isNotNull())


def dedup_latest(
    df: DataFrame,
    keys: Iterable[str] = BAR_KEYS,
    order: Iterable[str | Column] = ("close_time",),
) -> DataFrame:
    """Keep the row with the highest ``order`` per key.

    All other sortable columns break ties, so the survivor does not depend on the input order.
    Spark keeps one row per key and task before the shuffle (window group limit), so a key with
    many copies does not grow its task.
    """
    keys, order = list(keys), list(order)
    named = {o for o in order if isinstance(o, str)} | set(keys)
    rest = [F.col(f.name) for f in df.schema
            if f.name not in named and f.dataType.typeName() not in ("map", "variant")]
    w = Window.partitionBy(*keys).orderBy(*[col_of(c).desc() for c in [*order, *rest]])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def union_bronze(live: DataFrame, backfill: DataFrame) -> DataFrame:
    """Flat live bars and backfilled bars as one frame."""
    return backfill.unionByName(live, allowMissingColumns=True)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the columns and types of ``schema``; absent columns become null."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ])


def upsert_latest(new: DataFrame, existing: DataFrame, keys: Iterable[str] = BAR_KEYS,
                  version: str = "_loaded_at") -> DataFrame:
    """Rows of both frames, the highest version per key; loading twice changes nothing."""
    return dedup_latest(existing.unionByName(new), keys, [version])


def tag_typed(bronze: DataFrame) -> DataFrame:
    """Typed bronze bars with a ``reject_reason``, null for valid ones, and the text of their numbers in ``<column>_text``."""
    typed = cast_prices(keep_text(bronze.select(*KLINE_COLUMNS)))
    return typed.withColumn("reject_reason", reject_reason(kline_rules(typed.columns)))


def finish_silver(valid: DataFrame) -> DataFrame:
    """Valid typed bars to silver; derived columns are added after the dedup shuffle."""
    return with_partitions(with_times(dedup_latest(valid)))


def to_silver(bronze: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bronze bars to (silver, rejected). Rejected rows carry the text of their numbers in ``<column>_text``."""
    valid, rejected = split_valid(cast_prices(keep_text(bronze.select(*KLINE_COLUMNS))))
    return finish_silver(valid.select(*KLINE_COLUMNS)), with_times(rejected)


def silver_metrics(bronze: DataFrame) -> DataFrame:
    """One row: raw, rejected, kept and duplicate counts.

    Rows are counted per key first (combined before the shuffle), so no copies are moved.
    """
    typed = cast_prices(keep_text(bronze.select(*KLINE_COLUMNS)))
    bad = reject_reason(kline_rules(typed.columns)).isNotNull()
    per_key = typed.groupBy(*BAR_KEYS).agg(
        F.count(F.lit(1)).alias("raw"), F.count_if(bad).alias("rejected"))
    return per_key.agg(
        F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"),
        F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"),
        F.count_if(F.col("raw") > F.col("rejected")).alias("kept"),
    ).withColumn("duplicates", F.col("raw") - F.col("rejected") - F.col("kept"))

"""Scaling, sequences, splits, fingerprints and accuracy of model inputs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.functions.columns import argmax
from tickframe.operators.series import BARS, BLOCK_ROWS, Series, framed, plain, positions
from tickframe.schemas import FEATURE_COLUMNS


def fit_scaler(df: DataFrame, columns: Iterable[str] = tuple(FEATURE_COLUMNS)) -> DataFrame:
    """One row with ``<column>_mean`` and ``<column>_std`` over all finite values, and ``<column>_odd``, the
    number of values that are not finite.

    A deviation that is zero or undefined counts as 1, so scaling never divides by it.
    """
    stats = []
    for c in columns:
        x = F.col(c).cast("double")
        odd = F.isnan(x) | (F.abs(x) == float("inf"))
        finite = F.when(~odd, x)
        std = F.stddev_samp(finite)
        stats += [F.avg(finite).alias(f"{c}_mean"), F.when(std > 0, std).otherwise(1.0).alias(f"{c}_std"),
                  F.count_if(odd).alias(f"{c}_odd")]
    return df.agg(*stats)


def apply_scaler(df: DataFrame, stats: DataFrame,
                 columns: Iterable[str] = tuple(FEATURE_COLUMNS)) -> DataFrame:
    """(x - mean) / std; the one row of ``stats`` enters the plan as a scalar subquery."""
    fitted = stats.select(F.struct(*stats.columns)).scalar()
    known = set(stats.columns)

    def of(name: str, default: float) -> Column:
        return fitted.getField(name) if name in known else F.lit(default)

    return df.withColumns({
        c: (F.col(c).cast("double") - of(f"{c}_mean", 0.0)) / of(f"{c}_std", 1.0) for c in columns
    })


def sequences(df: DataFrame, columns: Iterable[str] = tuple(FEATURE_COLUMNS), length: int = 60,
              label: str = "target_direction", series: Series = BARS,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sliding ``length`` x features arrays with the label of their last row.

    The last row of a series ends no sequence (its label looks past the end), so a series of
    n rows gives n - length sequences and none if it is shorter.
    """
    step = F.array(*[F.col(c).cast("double") for c in columns])
    frame = series.block_window().rowsBetween(-(length - 1), 0)
    slim = df.select(*series.keys, *series.order, step.alias("_step"), F.col(label).alias("label"))
    out = framed(slim, {"sequence": F.collect_list("_step").over(frame)}, series,
                 before=length - 1, block_rows=block_rows, helpers=True)
    whole = out.filter((F.col("_pos") >= length - 1) & (F.col("_pos") < F.col("_len") - 1))
    return plain(whole).select(*series.keys, *series.order, "sequence", "label")


def temporal_split(df: DataFrame, share: float = 0.8,
                   series: Series = BARS) -> tuple[DataFrame, DataFrame]:
    """The first ``share`` of every series in time order, and the rest (with rows of no known time)."""
    numbered = positions(df, series)
    early = F.coalesce(F.col("_pos") < F.floor(F.col("_len") * F.lit(share)), F.lit(False))
    return plain(numbered.filter(early)), plain(numbered.filter(~early))


def fingerprint(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Row count and an order-free digest: the sum over rows of 60 bits of the row's md5.

    A value is written as its length, a colon and its text, a null as "-", so no two rows are written alike.
    """
    texts = [F.col(c).cast("string") for c in (columns or df.columns)]
    parts = [F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")) for t in texts]
    bits = F.conv(F.substring(F.md5(F.concat(*parts)), 1, 15), 16, 10)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(bits.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("digest"),
    )


def accuracy(df: DataFrame, prediction: str, target: str) -> DataFrame:
    """Share of rows whose prediction (a class, or an array of scores) equals the target."""
    is_scores = df.schema[prediction].dataType.typeName() == "array"
    guess = argmax(prediction) if is_scores else F.col(prediction)
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(guess == F.col(target)).alias("correct"),
    ).withColumn("accuracy", F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)))

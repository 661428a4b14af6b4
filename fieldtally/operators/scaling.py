"""Standardisation and min-max scaling.

The statistics are scalar subqueries: one aggregate with a one-row result, and
no join with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zscore(df: DataFrame, columns: list[str], suffix: str = "_std") -> DataFrame:
    """Add ``(x - mean) / sample std``; null where the deviation is zero."""
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_samp(c).alias(f"{c}_sd") for c in columns]
        ).alias("s")
    ).scalar()
    return df.withColumns(
        {
            c + suffix: F.try_divide(F.col(c) - stats.getField(f"{c}_mean"), stats.getField(f"{c}_sd"))
            for c in columns
        }
    )


def minmax(df: DataFrame, columns: list[str], suffix: str = "_norm") -> DataFrame:
    """Add ``(x - min) / (max - min)``, nulls ignored; null where all values are equal."""
    stats = df.agg(
        F.struct(
            *[F.min(c).cast("double").alias(f"{c}_min") for c in columns],
            *[F.max(c).cast("double").alias(f"{c}_max") for c in columns],
        ).alias("s")
    ).scalar()
    return df.withColumns(
        {
            c + suffix: F.try_divide(
                F.col(c) - stats.getField(f"{c}_min"), stats.getField(f"{c}_max") - stats.getField(f"{c}_min")
            )
            for c in columns
        }
    )

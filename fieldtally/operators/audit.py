"""Summaries that describe a table in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .daily import PRESENCE


def date_span(df: DataFrame, date_col: str = "date") -> DataFrame:
    """First and last date as text; fails when there is no date at all."""
    if date_col not in df.columns:
        raise ValueError(f"no column {date_col!r}")
    d = F.col(date_col).cast("date")
    known = F.when(F.count(d) > 0, F.lit(True)).otherwise(F.raise_error(F.lit("no valid dates found")).cast("boolean"))
    return df.agg(F.min(d).alias("lo"), F.max(d).alias("hi"), known.alias("known")).select(
        F.when(F.col("known"), F.date_format("lo", "yyyy-MM-dd")).alias("start_date"),
        F.date_format("hi", "yyyy-MM-dd").alias("end_date"),
    )


def dataset_summary(daily: DataFrame, flag: str = PRESENCE) -> DataFrame:
    """Rows, date range, days with observations and their share, total species count."""
    return daily.agg(
        F.count("*").alias("n_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.sum(flag).alias("days_present"),
        F.avg(flag).alias("share_present"),
        F.sum("species_count").alias("species_observations"),
    )


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null values per listed column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """Number of distinct non-null values, exact unless asked otherwise."""
    fn = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(fn(column).alias("n"))

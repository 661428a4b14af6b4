"""Counts of names and values, top-k, and simple groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_counts(df: DataFrame, list_col: str) -> DataFrame:
    """Occurrences of every list item; repeats within one list count."""
    return (
        df.select(F.explode(list_col).alias("species"))
        .groupBy("species")
        .agg(F.count("*").alias("occurrences"))
    )


def _frequency(df: DataFrame, list_col: str, source: str) -> DataFrame:
    return (
        item_counts(df, list_col)
        .select("species", "occurrences", F.lit(source).alias("source"))
    )


def species_frequency(days: DataFrame, photos: DataFrame) -> DataFrame:
    """Species counts from the photos, or from the days when the photos have no list column."""
    if "species_list" in photos.columns or "identified_species_list" not in days.columns:
        if "species_list" not in photos.columns:
            return photos.sparkSession.createDataFrame([], "species string, occurrences bigint, source string")
        return _frequency(photos, "species_list", "photo-level")
    return _frequency(days, "identified_species_list", "day-level")


def species_frequency_or_days(days: DataFrame, photos: DataFrame) -> DataFrame:
    """Variant that falls back to the days when no photo names any species.

    Both are counted in one job, and the least source that has rows is kept.
    """
    if "identified_species_list" not in days.columns or "species_list" not in photos.columns:
        return species_frequency(days, photos)
    both = _frequency(photos, "species_list", "photo-level").withColumn("_rank", F.lit(0)).unionAll(
        _frequency(days, "identified_species_list", "day-level").withColumn("_rank", F.lit(1))
    )
    best = both.select(F.min("_rank")).scalar()
    return both.where(F.col("_rank") == best).drop("_rank")


def value_counts(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """Rows per non-null value, in no order: sort at the sink."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias(name))
    )


def top_k(df: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    """The ``k`` rows with the largest ``by``; equal ones in the order of ``tie``."""
    return df.orderBy(F.desc(by), tie).limit(k)


def top_or_other(
    df: DataFrame, column: str, k: int = 25, name: str = "species_simplified", other: str = "Other"
) -> DataFrame:
    """Add ``name``: the value where it is among the ``k`` most frequent, else ``other``.

    The broadcast side is the result of a top-k and so never exceeds ``k`` rows.
    """
    top = top_k(value_counts(df, column, "_n"), k, "_n", column).select(F.col(column).alias("_top"))
    label = F.coalesce(F.col("_top"), F.lit(other))
    return df.join(F.broadcast(top), df[column] == top["_top"], "left").withColumn(name, label).drop("_top")


def count_by(df: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    """Rows per non-null key."""
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias(name))


def count_by_year(df: DataFrame, date_col: str = "date", name: str = "photo_count") -> DataFrame:
    """Rows per calendar year."""
    return count_by(df.select(F.year(date_col).alias("year")), "year", name=name)


def distinct_per_day(df: DataFrame, list_col: str, date_col: str = "date", name: str = "species_count") -> DataFrame:
    """Distinct non-null list items per day; days with none do not appear."""
    return (
        df.select(date_col, F.explode(list_col).alias("_item"))
        .where(F.col("_item").isNotNull())
        .groupBy(date_col)
        .agg(F.count_distinct("_item").alias(name))
    )

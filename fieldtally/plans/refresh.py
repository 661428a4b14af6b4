"""Refresh of the daily dataset after some days changed.

The stored dataset holds the state of every day: presence, counts and weather. When the records of some dates
change, only these dates are read from the sources. Rolling rain of a day looks back over seven rows, so
a change reaches the six rows after it as well; their other columns, and those of the six rows before, come
from the stored rows. The months that hold any of them are written anew, all others are not touched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.daily import PRESENCE, add_weather_features, attach_presence, calendar_from

SPAN = 7  # rows that the longest rolling window sees
COUNTS = [PRESENCE, "photo_count", "species_count"]


def write_daily(data: DataFrame, path: str) -> None:
    """Write a whole daily dataset, partitioned by month."""
    data.withColumn("month", F.date_format("date", "yyyy-MM")).write.mode("overwrite").partitionBy("month").parquet(path)


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).drop("month")


def reach(calendar: list[date], changed: Sequence[date]) -> tuple[set[date], set[date]]:
    """Of an ascending calendar, the dates whose rows change with those given, and those that they are worked out from."""
    affected, inputs = set(), set()
    for day in changed:
        at = bisect_left(calendar, day)
        affected.update(calendar[at : at + SPAN])
        inputs.update(calendar[max(0, at - SPAN + 1) : at + SPAN])
    return affected, inputs


def refresh_daily(
    spark: SparkSession, path: str, days: DataFrame, weather: DataFrame, photos: DataFrame | None, changed: Sequence[date]
) -> DataFrame:
    """Bring the dataset at ``path`` up to date with its sources for the ``changed`` dates, and read it back.

    The sources are filtered by date: partitioned by it, nothing else of them is read. Dates may be new
    or gone from the weather. A month of which no row would be left is an error, as a
    partition cannot be overwritten by nothing. One row per day is what the driver sees (dates only).
    """
    changed = sorted(set(changed))
    if not changed:
        return read_daily(spark, path)

    def of_changed(df: DataFrame) -> DataFrame:
        return df.where(F.col("date").isin(changed))

    stored = spark.read.parquet(path)
    fresh_weather = of_changed(weather)
    still = {r.date for r in calendar_from(fresh_weather).collect()}
    before = {r.date for r in stored.select("date").collect()}
    calendar = sorted(before.difference(changed) | still)
    affected, inputs = reach(calendar, changed)
    months = sorted({f"{d:%Y-%m}" for d in affected.union(changed)})
    lost = {f"{d:%Y-%m}" for d in before.intersection(changed)} - {f"{d:%Y-%m}" for d in calendar}
    if lost:
        raise ValueError(f"no row would be left in {sorted(lost)}")

    old = stored.where(F.col("month").isin(sorted({f"{d:%Y-%m}" for d in inputs})) & F.col("date").isin(sorted(inputs - set(changed))))
    base = attach_presence(calendar_from(fresh_weather), of_changed(days), None if photos is None else of_changed(photos))
    columns = [c for c in weather.columns if c != "date"]
    daily = base.select("date", *COUNTS).unionByName(old.select("date", *COUNTS))
    measured = fresh_weather.select("date", *columns).unionByName(old.select("date", *columns))
    rows = add_weather_features(daily, measured).where(F.col("date").isin(sorted(affected)))
    kept = stored.where(F.col("month").isin(months) & ~F.col("date").isin(sorted(affected.union(changed)))).drop("month")
    out = kept.unionByName(rows.select(*kept.columns)).withColumn("month", F.date_format("date", "yyyy-MM"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    return read_daily(spark, path)

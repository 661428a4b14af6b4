"""The calendar table: presence, counts, weather joins, rolling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import seasonal_cos, seasonal_sin
from ..functions.text import weather_metrics
from .filters import differing
from .frequency import count_by, distinct_per_day

PRESENCE = "has_mushroom"  # fixed value: the flag's name in the daily table


def calendar_from(weather: DataFrame) -> DataFrame:
    """Distinct dates of the weather table."""
    return weather.select("date").where(F.col("date").isNotNull()).distinct()


def zero_if_null(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0)).cast("bigint").alias(column)


def attach_presence(
    calendar: DataFrame,
    days: DataFrame,
    photos: DataFrame | None = None,
    flag: str = PRESENCE,
    keep_duplicates: bool = False,
) -> DataFrame:
    """Add the 0/1 flag, ``photo_count`` and ``species_count`` to the calendar.

    Day records are summed per date. With ``keep_duplicates`` a date that has
    several day records appears once for each of them instead.
    """
    has_counts = "photo_count" in days.columns
    if keep_duplicates:
        per_day = days.select("date", F.lit(1).alias(flag), *(["photo_count"] if has_counts else []))
        if not has_counts:
            per_day = per_day.distinct()
    else:
        sums = [F.sum("photo_count").alias("photo_count")] if has_counts else []
        per_day = days.groupBy("date").agg(F.max(F.lit(1)).alias(flag), *sums)
    out = calendar.join(per_day, "date", "left")
    if photos is not None and "species_list" in photos.columns:
        out = out.join(distinct_per_day(photos, "species_list"), "date", "left")
    return out.select(
        *calendar.columns,
        *[
            zero_if_null(c) if c in out.columns else F.lit(0).cast("bigint").alias(c)
            for c in (flag, "photo_count", "species_count")
        ],
    )


def rolling(
    df: DataFrame,
    value: str,
    windows: dict[str, int],
    how: str = "sum",
    order_by: str = "date",
    series: list[str] | None = None,
) -> DataFrame:
    """Rolling sum or mean over the last rows; windows may be short at the start, nulls are ignored.

    The input has one row per day, or per day and series, which bounds what one
    task sorts by the number of days. Reduce raw records to days first.
    """
    fn = {"sum": F.sum, "mean": F.avg}[how]
    w = Window.partitionBy(*(series or [])).orderBy(order_by)
    return df.withColumns({name: fn(value).over(w.rowsBetween(1 - n, 0)) for name, n in windows.items()})


def fill_calendar(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Add the missing days between the first and the last date, other columns null.

    Each row is followed by the days up to the next one; the input has one row
    per day.
    """
    following = F.lead(date_col).over(Window.orderBy(date_col))
    days = F.sequence(F.col(date_col), F.coalesce(F.date_sub("_next", 1), F.col(date_col)))
    others = [c for c in df.columns if c != date_col]
    return (
        df.where(F.col(date_col).isNotNull())
        .withColumn("_next", following)
        .withColumn("_day", F.explode(days))
        .select(
            *[
                F.col("_day").alias(c) if c == date_col else F.when(F.col("_day") == F.col(date_col), F.col(c)).alias(c)
                for c in [date_col, *others]
            ]
        )
    )


def temperature_features(df: DataFrame) -> DataFrame:
    """Mean temperature where the table has none, and the daily range."""
    if not {"temperature_max", "temperature_min"} <= set(df.columns):
        return df
    hi, lo = F.col("temperature_max"), F.col("temperature_min")
    if "temperature_mean" not in df.columns:
        df = df.withColumn("temperature_mean", (hi + lo) / 2.0)
    return df.withColumn("temp_range", hi - lo)


def rain_features(df: DataFrame) -> DataFrame:
    """Rain of the day and of the last three and seven rows."""
    if "rain_sum" not in df.columns:
        return df
    return rolling(df, "rain_sum", {"rain_3": 3, "rain_7": 7}).withColumn("rain_1", F.col("rain_sum"))


def seasonal_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    d = F.col(date_col)
    return df.withColumns({"seasonal_sin": seasonal_sin(d), "seasonal_cos": seasonal_cos(d)})


def add_weather_features(daily: DataFrame, weather: DataFrame) -> DataFrame:
    """Join the weather by date, then add rain, temperature and seasonal features."""
    out = daily.join(weather, "date", "left")
    for step in (rain_features, temperature_features, seasonal_features):
        out = out.transform(step)
    wanted = [*daily.columns, *[c for c in weather.columns if c != "date"]]
    added = ["rain_1", "rain_3", "rain_7", "temperature_mean", "temp_range", "seasonal_sin", "seasonal_cos"]
    return out.select(*wanted, *[c for c in added if c in out.columns and c not in wanted])


def uncovered_days(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """Dates with day records that the calendar lacks."""
    return days.select("date").distinct().join(calendar.select("date"), "date", "left_anti")


def compare_counts(days: DataFrame, photos: DataFrame) -> DataFrame:
    """Reported next to actual photos per day; ``actual_photo_count`` is null without photos."""
    actual = count_by(photos, "date", name="actual_photo_count")
    return days.select("date", "photo_count").join(actual, "date", "left")


def count_discrepancies(days: DataFrame, photos: DataFrame) -> DataFrame:
    """Days whose reported count is not the actual one, or where one is missing."""
    return compare_counts(days, photos).where(differing(F.col("photo_count"), F.col("actual_photo_count")))


def with_weather_metrics(days: DataFrame, sentence_col: str = "weather_summary", keep: tuple[str, ...] = ()) -> DataFrame:
    """Date, photo count, the columns in ``keep`` and the numbers of the weather sentence, side by side."""
    metrics = [c.alias(name) for name, c in weather_metrics(F.col(sentence_col)).items()]
    return days.select("date", "photo_count", *keep, *metrics)


JOIN_PIECES_PER_CORE = 4
#: Parts into which the records of a date are dealt; each meets a copy of the date's sentences.
JOIN_PARTS = 4


def join_weather_metrics(days: DataFrame, metrics: DataFrame) -> DataFrame:
    """Add temp, min, max and precip by date, a row for every sentence of the date.

    Where dates have several records, :func:`with_weather_metrics` with ``keep`` gives
    each record its own sentence instead, without a join. The rows of a date grow with the square of its records, so
    both sides are dealt to a fixed number of tasks: by the size of its input, adaptive execution would join all in one.
    The records of a date go to ``JOIN_PARTS`` of them, so one with very many does not fall to one task. A task holds the sentences of one date.
    """
    spark = days.sparkSession
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), JOIN_PIECES_PER_CORE * spark.sparkContext.defaultParallelism)
    # by content and partition, so copies of a record are divided too, and a task that runs again deals alike
    hashed = [c for c, kind in days.dtypes if "map<" not in kind]
    part = F.pmod(F.hash(*hashed) + F.spark_partition_id(), F.lit(JOIN_PARTS))
    copies = F.explode(F.sequence(F.lit(0), F.lit(JOIN_PARTS - 1)))
    records = days.withColumn("_part", part).repartition(pieces, "date", "_part")
    sentences = metrics.select("date", "temp", "min", "max", "precip", copies.alias("_part")).repartition(pieces, "date", "_part")
    return records.join(sentences.hint("merge"), ["date", "_part"], "left").drop("_part")

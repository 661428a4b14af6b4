"""Readers for the raw tables.

CSV files are read as text by header name and cast, so optional columns may be
missing and columns may come in any order, without a pass for schema inference.
With ``multi_line`` each file is read by one task; with ``split`` large files are read in
pieces, in two passes (see quoted_csv).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import filter_by_year
from .quoted_csv import read_quoted_csv

# Columns and types of the raw tables.
DAYS = {
    "date": "date", "url": "string", "weather_summary": "string", "identified_species_text": "string",
    "identified_species": "string", "kmz_url": "string", "photo_count": "bigint",
    "latitude": "double", "longitude": "double",
}
PHOTOS = {
    "date": "date", "page_url": "string", "photo_url": "string", "index_on_page": "int",
    "full_caption": "string", "common_name": "string", "species": "string", "location_text": "string",
    "latitude": "double", "longitude": "double",
}
WEATHER_VALUES = (
    "temperature_max", "temperature_min", "temperature_mean", "precipitation_sum", "rain_sum",
    "snowfall_sum", "wind_speed_max", "wind_speed_mean", "relative_humidity_mean",
    "soil_temp_mean", "soil_moisture_mean",
)
WEATHER = {"date": "date", **{c: "double" for c in WEATHER_VALUES}}


def read_table(
    spark: SparkSession, path: str, types: dict[str, str], fmt: str = "csv", multi_line: bool = False, strict: bool = True,
    pieces: int | None = None, split: bool = False,
) -> DataFrame:
    """A table with the known columns cast; unknown columns are kept as they are.

    ``strict`` fails on a value that cannot be cast, otherwise it becomes null.
    Nested columns of Parquet and ORC files keep their type. ``pieces`` deals the rows of a
    CSV file out anew, which helps if few large files with ``multi_line`` feed costly steps. ``split`` reads CSV files with line
    breaks inside quotes in as many pieces as they have splits.
    """
    if fmt != "csv":
        df = spark.read.format(fmt).load(path)
    elif split:
        df = read_quoted_csv(spark, path)
    else:
        df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multi_line)
        if pieces:
            df = df.repartition(pieces)

    def typed(name: str):
        c, target = F.col(name), types.get(name)
        if target is None or df.schema[name].dataType.typeName() in ("array", "struct", "map"):
            return c
        if df.schema[name].dataType.simpleString() == target:
            return c
        if target == "bigint" and fmt == "csv":  # counts with missing values are spelled 3.0
            c = c.cast("double") if strict else c.try_cast("double")
        return (c.cast(target) if strict else c.try_cast(target)).alias(name)

    return df.select(*[typed(c) for c in df.columns])


def read_days(spark: SparkSession, path: str, filter_years: bool = True, fmt: str = "csv", **options) -> DataFrame:
    """Day records, by default of the covered years only."""
    df = read_table(spark, path, DAYS, fmt, **options)
    return filter_by_year(df) if filter_years else df


def read_photos(
    spark: SparkSession, path: str, filter_years: bool = True, fmt: str = "csv", multi_line: bool = True, **options
) -> DataFrame:
    """Photo records, by default of the covered years only."""
    df = read_table(spark, path, PHOTOS, fmt, multi_line=multi_line, **options)
    return filter_by_year(df) if filter_years else df


def read_weather(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    """Daily weather."""
    return read_table(spark, path, WEATHER, fmt, **options)

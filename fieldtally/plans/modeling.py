"""Daily dataset, weather table, model frames and model runs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import END_YEAR, START_YEAR
from ..functions.geo import DEFAULT_ZOOM, Box
from ..functions.rules import RuleSet
from ..operators.audit import date_span
from ..operators.cells import add_cells, attach_by_cell, count_cell_days, fill_cell_days
from ..operators.counts import CountModel, fit_zip
from ..operators.daily import add_weather_features, attach_presence, calendar_from
from ..operators.filters import drop_incomplete, filter_by_year
from ..operators.scaling import zscore
from ..operators.taxonomy import filter_by_rules
from ..session import reusable
from ..sources.payload import unpivot_daily
from ..sources.sinks import write_table
from ..sources.tables import read_days, read_photos, read_weather
from .preprocess import process_photos, run_preprocessing

# Predictors of the weather model.
STANDARDISED = ["rain_7", "soil_moisture_mean", "temperature_mean", "relative_humidity_mean"]
SEASONAL = ["seasonal_sin", "seasonal_cos"]
WEATHER_PREDICTORS = [f"{c}_std" for c in STANDARDISED] + SEASONAL


def daily_dataset(
    days: DataFrame, weather: DataFrame, photos: DataFrame | None = None, years: tuple[int, int] | None = None
) -> DataFrame:
    """One row per weather date: presence, counts, weather and features.

    Presence and photo counts come from all day records, species counts from the
    photos given, which may be a selection.
    """
    if years is not None:
        days = filter_by_year(days, "date", *years)
        weather = filter_by_year(weather, "date", *years)
        # the calendar would drop other years anyway, but only after parsing them
        photos = None if photos is None else filter_by_year(photos, "date", *years)
    base = attach_presence(calendar_from(weather), days, photos)
    return add_weather_features(base, weather)


def run_modeling_dataset(
    spark: SparkSession,
    days_path: str,
    weather_path: str,
    output_dir: str,
    filter_years: bool = True,
    photos: DataFrame | None = None,
    in_fmt: str = "csv",
    out_fmt: str = "parquet",
    photos_path: str | None = None,
) -> DataFrame:
    """Build the daily dataset, write it partitioned by year, and read it back.

    Without ``photos`` they are read from ``photos_path``, by default the table
    named ``photos`` next to the days (``days.csv`` and ``photos.csv``).
    """
    years = (START_YEAR, END_YEAR) if filter_years else None
    if photos is None:
        folder, _, name = days_path.rstrip("/").rpartition("/")
        ending = name[name.index(".") :] if "." in name else ""
        photos = process_photos(read_photos(spark, photos_path or f"{folder or '.'}/photos{ending}", filter_years, in_fmt))
    data = daily_dataset(
        read_days(spark, days_path, filter_years, in_fmt), read_weather(spark, weather_path, in_fmt), photos, years
    )
    return write_table(data, f"{output_dir}/daily", out_fmt, by_year=True)


def run_full(
    spark: SparkSession,
    days_path: str,
    photos_path: str,
    weather_path: str,
    output_dir: str,
    filter_years: bool = True,
    rules: RuleSet | None = None,
    box: Box | None = None,
    in_fmt: str = "csv",
    out_fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """Preprocessing, then the daily dataset on the photos that were kept."""
    out = run_preprocessing(
        spark, days_path, photos_path, output_dir, filter_years, rules, box, in_fmt, out_fmt
    )
    out["daily"] = run_modeling_dataset(
        spark, days_path, weather_path, output_dir, filter_years, out["photos"], in_fmt, out_fmt
    )
    return out


def weather_table(days: DataFrame, payloads: DataFrame) -> DataFrame:
    """Landed payloads as daily weather, within the date range of the day records."""
    span = date_span(days).select(F.struct("start_date", "end_date").alias("s")).scalar()
    weather = unpivot_daily(payloads)
    return weather.where(
        F.col("date").between(span.getField("start_date").cast("date"), span.getField("end_date").cast("date"))
    )


def run_weather_table(
    spark: SparkSession, days_path: str, payload_path: str, output_dir: str, in_fmt: str = "csv", out_fmt: str = "parquet"
) -> DataFrame:
    """Build and write the weather table from payloads landed as one JSON text per line."""
    days = read_days(spark, days_path, False, in_fmt)
    weather = weather_table(days, spark.read.text(payload_path).withColumnRenamed("value", "payload"))
    return write_table(weather, f"{output_dir}/daily_weather", out_fmt)


def _weather_rows(daily: DataFrame, years: tuple[int, int]) -> tuple[DataFrame, str]:
    target = "species_count" if "species_count" in daily.columns else "photo_count"
    rows = filter_by_year(daily, "date", *years)
    return drop_incomplete(rows, [*STANDARDISED, *SEASONAL, target]), target


def weather_model_frame(daily: DataFrame, years: tuple[int, int] = (START_YEAR, END_YEAR)) -> tuple[DataFrame, str]:
    """Complete rows of the covered years with standardised predictors, and the target's name."""
    rows, target = _weather_rows(daily, years)
    return zscore(reusable(rows), STANDARDISED), target  # read for the statistics and for the rows


def run_weather_model(
    daily: DataFrame, years: tuple[int, int] = (START_YEAR, END_YEAR), prior_sd: float | None = 1.0
) -> tuple[CountModel, DataFrame]:
    """Zero-inflated fit of the daily counts on weather and season, with its summary."""
    rows, target = _weather_rows(daily, years)
    # read twice, for the statistics and for the rows; one row per day
    rows = reusable(rows.select(*STANDARDISED, *SEASONAL, target))
    model = fit_zip(zscore(rows, STANDARDISED), WEATHER_PREDICTORS, target, prior_sd)
    rows.unpersist()
    return model, model.summary(daily.sparkSession)


def cell_model_rows(
    photos: DataFrame,
    elevation: DataFrame,
    rules: RuleSet | None = None,
    species_col: str = "label_species",
    years: tuple[int, int] = (START_YEAR, END_YEAR),
    zoom: int = DEFAULT_ZOOM,
    fill: tuple[date, date] | None = None,
) -> DataFrame:
    """Counts per cell and day with the elevation of the cell.

    ``elevation`` has one row per cell. Counting comes first, so the lookup
    meets one row per cell and day. ``fill`` adds the zero days of a date range.
    """
    if rules is not None:
        photos = filter_by_rules(photos, rules, species_col, "full_caption", missing="error")
    counts = count_cell_days(add_cells(filter_by_year(photos, "date", *years), zoom=zoom))
    if fill is not None:
        counts = fill_cell_days(counts, *fill)
    return drop_incomplete(attach_by_cell(counts, elevation), ["elevation"])


def cell_model_frame(photos: DataFrame, elevation: DataFrame, **options) -> DataFrame:
    """:func:`cell_model_rows` with standardised elevation."""
    rows = reusable(cell_model_rows(photos, elevation, **options))
    return zscore(rows, ["elevation"])  # read for the statistics and for the rows


def run_spatial_model(
    photos: DataFrame, elevation: DataFrame, prior_sd: float | None = 1.0, **options
) -> tuple[CountModel, DataFrame, DataFrame]:
    """Zero-inflated fit of cell-day counts on elevation: the model, its summary, the counts."""
    # read for the statistics, the fit and the sink, but counted once
    rows = reusable(cell_model_rows(photos, elevation, **options))
    frame = zscore(rows, ["elevation"])
    model = fit_zip(frame, ["elevation_std"], "count", prior_sd)
    return model, model.summary(photos.sparkSession), frame

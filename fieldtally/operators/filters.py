"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import END_YEAR, START_YEAR, in_years
from ..functions.geo import Box
from ..functions.zorder import box_ranges, in_ranges


def _date_key(df: DataFrame, column: str) -> Column:
    """A date or timestamp column as it is, so that the filter can be pushed down; text is cast."""
    c = F.col(column)
    return c if df.schema[column].dataType.typeName().startswith(("date", "timestamp")) else c.cast("date")


def filter_by_year(
    df: DataFrame, date_col: str = "date", start_year: int = START_YEAR, end_year: int = END_YEAR
) -> DataFrame:
    """Rows within an inclusive range of years; rows without a date are dropped."""
    return df.where(in_years(_date_key(df, date_col), start_year, end_year))


def filter_by_bbox(
    df: DataFrame, box: Box, lat_col: str = "latitude", lon_col: str = "longitude"
) -> DataFrame:
    """Rows inside an inclusive box. Unknown coordinates are outside; without the columns nothing changes."""
    if lat_col not in df.columns or lon_col not in df.columns:
        return df
    return df.where(box.contains(F.col(lat_col), F.col(lon_col)))


def filter_by_bbox_in_order(
    df: DataFrame, box: Box, lat_col: str = "latitude", lon_col: str = "longitude", key: str = "z"
) -> DataFrame:
    """As :func:`filter_by_bbox`, of a table that :func:`fieldtally.sources.sinks.write_in_z_order` wrote: ranges of its
    key lead the scan past the files and row groups without points of the box."""
    return filter_by_bbox(df.where(in_ranges(F.col(key), box_ranges(box))), box, lat_col, lon_col)


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value in every listed column."""
    return df.na.drop(subset=columns)


def differing(a: Column, b: Column) -> Column:
    """True where two values differ; a null on either side counts as different."""
    return ~F.coalesce(a == b, F.lit(False))


def available(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])

"""Points to map cells, counts per cell and day, zero filling, GeoJSON."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import DEFAULT_ZOOM, cell_feature, cell_id, cell_lat, cell_lon, cell_ring
from ..functions.hexagons import DEFAULT_RESOLUTION, hex_cell_by_batch, hex_centre, hex_feature
from .columns import compute_once
from .joins import lookup_join

# Map centre (lat, lon) when there is nothing to show.
FALLBACK_CENTER = (31.9686, -99.9018)


def add_cells(
    df: DataFrame, lat_col: str = "latitude", lon_col: str = "longitude", zoom: int = DEFAULT_ZOOM
) -> DataFrame:
    """Add ``cell``, null where a coordinate is unknown."""
    return df.withColumn("cell", cell_id(F.col(lat_col), F.col(lon_col), zoom))


def add_hexagons(
    df: DataFrame, lat_col: str = "latitude", lon_col: str = "longitude", resolution: int | Column = DEFAULT_RESOLUTION
) -> DataFrame:
    """Add ``cell``, the id of the hexagon of a point, null where a coordinate is unknown. All that takes ``cell`` columns
    as keys (counts, grids, lookups) works on them as on tiles; for centres and borders see hexagons_of and hexagon_features."""
    found = df.withColumn("_cell", hex_cell_by_batch(F.col(lat_col), F.col(lon_col), resolution))
    return compute_once(found, {"cell": F.col("_cell")}).drop("_cell")  # a filter on the cell must not work it out again


def hexagons_of(df: DataFrame) -> DataFrame:
    """The distinct hexagons with their centres, one row each."""
    cells = df.select("cell").where(F.col("cell").isNotNull()).distinct()
    return cells.withColumn("centre", hex_centre(F.col("cell"))).select("cell", "centre.lat", "centre.lon")


def cells_of(df: DataFrame) -> DataFrame:
    """The distinct cells with their centres, one row each: what a lookup is keyed by."""
    cell = F.col("cell")
    return (
        df.select("cell").where(cell.isNotNull()).distinct()
        .select("cell", cell_lat(cell).alias("lat"), cell_lon(cell).alias("lon"))
    )


def count_cells(df: DataFrame, name: str = "photo_count") -> DataFrame:
    """Rows per cell."""
    return df.where(F.col("cell").isNotNull()).groupBy("cell").agg(F.count("*").alias(name))


def count_cell_days(df: DataFrame) -> DataFrame:
    """Rows per cell and day."""
    return df.na.drop(subset=["cell", "date"]).groupBy("cell", "date").agg(F.count("*").alias("count"))


def attach_by_cell(df: DataFrame, lookup: DataFrame, spread: int = 1) -> DataFrame:
    """Add the lookup's columns (one row per cell), null where a cell is not listed."""
    return lookup_join(df, lookup, "cell", spread)


def mean_by_cell(df: DataFrame, value: str = "elevation") -> DataFrame:
    """Mean of a value per cell, over rows that have both."""
    return df.na.drop(subset=["cell", value]).groupBy("cell").agg(F.avg(value).alias(value))


def space_time_grid(cells: DataFrame, start: date | Column, end: date | Column, every: str = "1 day") -> DataFrame:
    """Every cell with every date from ``start`` to ``end``; nothing when the range is empty.

    The dates are generated next to each cell, so nothing is joined or shuffled.
    """

    def as_date(v: date | Column) -> Column:
        return v.cast("date") if isinstance(v, Column) else F.lit(v).cast("date")

    first, last = as_date(start), as_date(end)
    dates = F.when(first <= last, F.sequence(first, last, F.expr(f"interval {every}")))
    return cells.select("cell", F.explode(dates).alias("date"))


def fill_cell_days(counts: DataFrame, start: date, end: date, cells: DataFrame | None = None) -> DataFrame:
    """Counts for every cell and every day, zero where nothing was seen.

    Equals the daily grid left-joined with the counts, but the grid is never
    built: each observed cell-day generates the empty days up to the next, and the
    first one of a cell also those before it. So the counts are read once and only
    observed cell-days are shuffled, at most one row per day and cell. ``cells``
    defaults to the cells that occur in ``counts``, which has one row per cell
    and day.
    """
    if end < start:
        raise ValueError("the date range is empty")
    rows = counts.select("cell", F.col("date").alias("_seen"), "count")
    if cells is not None:
        rows = cells.select("cell").distinct().join(rows, "cell", "left")
    in_order = Window.partitionBy("cell").orderBy("_seen")
    first = F.row_number().over(in_order) == 1
    opening = F.when(first, F.lit(start)).otherwise(F.greatest(F.lit(start), F.col("_seen")))
    # least() passes over the missing successor of a cell's last row
    closing = F.least(F.lit(end), F.date_sub(F.lead("_seen").over(in_order), 1))
    spans = rows.withColumn("_from", opening).withColumn("_to", closing).where(F.col("_from") <= F.col("_to"))
    return spans.select("cell", "_seen", "count", F.explode(F.sequence("_from", "_to")).alias("date")).select(
        "cell", "date", F.when(F.col("date") == F.col("_seen"), F.col("count")).otherwise(F.lit(0)).alias("count")
    )


def cell_features(df: DataFrame, value: str) -> DataFrame:
    """One GeoJSON feature per cell row."""
    return df.select("cell", cell_feature(F.col("cell"), **{value: F.col(value)}).alias("feature"))


def hexagon_features(df: DataFrame, value: str) -> DataFrame:
    """One GeoJSON feature per hexagon row."""
    return df.select("cell", hex_feature(F.col("cell"), **{value: F.col(value)}).alias("feature"))


def map_center(cells: DataFrame, ring: Callable[[Column], Column] = cell_ring) -> DataFrame:
    """Mean of the polygon vertices (closing vertex included), or the fixed fallback. ``ring`` is hex_ring for hexagons."""
    points = cells.select(F.explode(ring(F.col("cell"))).alias("p"))
    lat, lon = FALLBACK_CENTER
    return points.agg(
        F.coalesce(F.avg(F.col("p")[1]), F.lit(lat)).alias("lat"),
        F.coalesce(F.avg(F.col("p")[0]), F.lit(lon)).alias("lon"),
    )

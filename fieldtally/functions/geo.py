"""Bounding box and map-cell expressions.

Cells are the tiles of the Web Mercator quad tree. A cell id is one BIGINT that
packs zoom, column and row, so it groups and joins as a fixed-width key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zoom 14 has tiles of about 2.1 km at latitude 30.
DEFAULT_ZOOM = 14
_BITS = 29
_MASK = (1 << _BITS) - 1


@dataclass(frozen=True)
class Box:
    """Inclusive bounding box."""

    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float

    @classmethod
    def default(cls) -> "Box":
        # The default study area.
        return cls(min_lon=-95.9, min_lat=29.9, max_lon=-94.0, max_lat=31.2)

    def contains(self, lat: Column, lon: Column) -> Column:
        """True inside or on the border; null where a coordinate is null."""
        return lat.between(self.min_lat, self.max_lat) & lon.between(self.min_lon, self.max_lon)


def cell_id(lat: Column, lon: Column, zoom: int = DEFAULT_ZOOM) -> Column:
    """Cell that holds a point; null where a coordinate is null or on no globe.

    Latitudes beyond the projection (85.05 degrees) belong to the outermost row.
    """
    if not 0 <= zoom <= _BITS:
        raise ValueError(f"zoom must be between 0 and {_BITS}")
    n = 1 << zoom
    lat, lon = lat.cast("double"), lon.cast("double")
    x = F.floor((lon + 180.0) / 360.0 * float(n))
    y = F.floor((F.lit(1.0) - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * float(n))

    def clamp(v: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0).cast("bigint")), F.lit(n - 1).cast("bigint"))

    known = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    packed = F.lit(zoom << (2 * _BITS)).cast("bigint") + clamp(x) * F.lit(1 << _BITS).cast("bigint") + clamp(y)
    return F.when(known, packed)


def cell_zoom(cell: Column) -> Column:
    return F.shiftright(cell, 2 * _BITS).cast("int")


def cell_column(cell: Column) -> Column:
    return F.shiftright(cell, _BITS).bitwiseAND(F.lit(_MASK))


def cell_row(cell: Column) -> Column:
    return cell.bitwiseAND(F.lit(_MASK))


def cell_parent(cell: Column) -> Column:
    """The enclosing cell one zoom level up."""
    return (
        F.shiftleft((cell_zoom(cell) - 1).cast("bigint"), 2 * _BITS)
        + F.shiftleft(F.shiftright(cell_column(cell), 1), _BITS)
        + F.shiftright(cell_row(cell), 1)
    )


def _lon_at(cell: Column, x: Column) -> Column:
    return x / F.pow(F.lit(2.0), cell_zoom(cell)) * 360.0 - 180.0


def _lat_at(cell: Column, y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - y * 2.0 / F.pow(F.lit(2.0), cell_zoom(cell))))))


def cell_lat(cell: Column) -> Column:
    """Latitude of the cell centre."""
    return _lat_at(cell, cell_row(cell) + F.lit(0.5))


def cell_lon(cell: Column) -> Column:
    """Longitude of the cell centre."""
    return _lon_at(cell, cell_column(cell) + F.lit(0.5))


def cell_ring(cell: Column) -> Column:
    """Closed border of the cell as an array of [lon, lat] pairs."""
    x, y = cell_column(cell).cast("double"), cell_row(cell).cast("double")
    west, east = _lon_at(cell, x), _lon_at(cell, x + 1.0)
    north, south = _lat_at(cell, y), _lat_at(cell, y + 1.0)
    return F.array(
        F.array(west, north), F.array(west, south), F.array(east, south), F.array(east, north), F.array(west, north)
    )


def cell_feature(cell: Column, **properties: Column) -> Column:
    """GeoJSON feature text: the cell polygon with the given properties."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(cell.alias("cell"), *[c.alias(k) for k, c in properties.items()]).alias("properties"),
            F.struct(F.lit("Polygon").alias("type"), F.array(cell_ring(cell)).alias("coordinates")).alias("geometry"),
        ),
        {"ignoreNullFields": "false"},
    )

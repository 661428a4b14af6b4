"""Z-order keys of points, and boxes as ranges of keys.

A key interleaves the bits of a tile's column and row at ``KEY_ZOOM``, so each tile of any coarser
zoom is one range of keys, and points close to each other mostly have close keys. A box is covered by
few such ranges: the files and row groups of a table in key order that lie outside of them are not read.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import Box

KEY_ZOOM = 26  # tiles of half a metre at the equator; keys have 52 bits
MAX_RANGES = 24

# How bits are spread, from halves down to single bits (32-bit numbers to every second of 64).
SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def _tile(lat: Column, lon: Column) -> tuple[Column, Column]:
    n = 1 << KEY_ZOOM
    x = F.floor((lon + 180.0) / 360.0 * float(n))
    y = F.floor((F.lit(1.0) - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * float(n))
    low, high = F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")
    return F.least(F.greatest(x, low), high), F.least(F.greatest(y, low), high)


def z_key(lat: Column, lon: Column) -> Column:
    """The key of a point; null where a coordinate is null or on no globe."""
    lat, lon = lat.cast("double"), lon.cast("double")

    def key(xy: Column) -> Column:
        """Both spread at once, each step on an array of the two: a step mentions its argument twice."""
        for shift, mask in SPREAD:
            xy = _spread(xy, shift, mask)
        return F.aggregate(F.reverse(xy), F.lit(0).cast("bigint"), lambda k, v: F.shiftleft(k, 1).bitwiseOR(v))

    known = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.when(known, key(F.array(*_tile(lat, lon))))


def _spread(xy: Column, shift: int, mask: int) -> Column:
    return F.transform(xy, lambda v: v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask)))


def tile_of(lat: float, lon: float) -> tuple[int, int]:
    """Column and row of a point's tile, as the expressions have it up to the last digit of their arithmetic."""
    n = 1 << KEY_ZOOM
    lat = min(max(lat, -89.999999), 89.999999)
    x = math.floor((lon + 180.0) / 360.0 * n)
    y = math.floor((1.0 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2.0 * n)
    return min(max(x, 0), n - 1), min(max(y, 0), n - 1)


def interleaved(x: int, y: int) -> int:
    return sum(((x >> b & 1) << 2 * b) | ((y >> b & 1) << 2 * b + 1) for b in range(KEY_ZOOM))


def box_ranges(box: Box, most: int = MAX_RANGES) -> list[tuple[int, int]]:
    """Up to ``most`` ranges of keys (both ends included) that hold all points of a box, in order.

    Tiles are divided from the whole map on, always the one with the most area outside of the box, until the
    ranges are as many as allowed; neighbours are joined. A margin of a tile makes up for rounding.
    """
    if box.min_lon > box.max_lon or box.min_lat > box.max_lat:
        return []
    n = 1 << KEY_ZOOM
    (x0, y1), (x1, y0) = tile_of(box.min_lat, box.min_lon), tile_of(box.max_lat, box.max_lon)
    x0, y0, x1, y1 = max(x0 - 1, 0), max(y0 - 1, 0), min(x1 + 1, n - 1), min(y1 + 1, n - 1)

    def outside(level: int, x: int, y: int) -> int:
        """Area of a tile outside of the box; -1 for a tile that has none inside."""
        size = n >> level
        wide = min(x1, (x + 1) * size - 1) - max(x0, x * size) + 1
        high = min(y1, (y + 1) * size - 1) - max(y0, y * size) + 1
        return size * size - wide * high if wide > 0 and high > 0 else -1

    def ranges(tiles) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for low, high in sorted((interleaved(x * (n >> lv), y * (n >> lv)), (n >> lv) ** 2) for _, lv, x, y in tiles):
            if out and out[-1][1] + 1 == low:
                out[-1] = (out[-1][0], low + high - 1)
            else:
                out.append((low, low + high - 1))
        return out

    heap = [(-outside(0, 0, 0), 0, 0, 0)]
    best = ranges(heap)
    while heap and heap[0][0] < 0 and len(heap) < 8 * most:
        _, level, x, y = heapq.heappop(heap)
        for dx in (0, 1):
            for dy in (0, 1):
                child = (level + 1, 2 * x + dx, 2 * y + dy)
                if (area := outside(*child)) >= 0:
                    heapq.heappush(heap, (-area, *child))
        found = ranges(heap)
        if len(found) <= most:
            best = found
    return best


def in_ranges(key: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a key is in one of the ranges, in a form that reaches the file scan."""
    each = [(key >= low) & (key <= high) for low, high in ranges]
    return reduce(Column.__or__, each) if each else F.lit(False)

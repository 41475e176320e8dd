"""Map projection and tile arithmetic as column expressions.

Longitude and latitude are degrees; mercator coordinates run from 0 to 1, y
from north to south.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import Grid

#: Tiles reach this part of their width beyond their edge.
REACH = 2 / 256


def mercator_x(lng: Column) -> Column:
    return (lng + F.lit(180.0)) / F.lit(360.0)


def mercator_y(lat: Column) -> Column:
    """Null at and beyond the poles."""
    y = (F.lit(180.0) - F.degrees(F.ln(F.tan(F.radians(F.lit(90.0) + lat) / F.lit(2.0))))) / F.lit(360.0)
    return F.when(F.abs(lat) < 90, y)


def mercator_to_lng(x: Column) -> Column:
    return x * F.lit(360.0) - F.lit(180.0)


def mercator_to_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.exp(F.radians(F.lit(180.0) - y * F.lit(360.0))))) * F.lit(2.0) - F.lit(90.0)


def cell_edges(x: Column, y: Column, power: Column, grid: Grid) -> dict[str, Column]:
    """lng1, lng2, lat1, lat2 (degrees) and mx1, mx2, my1, my2 (mercator) of a cell; edge k lies half a cell before centre k."""
    width = F.shiftleft(F.lit(1), power) if isinstance(power, int) else F.pow(F.lit(2.0), power)
    half = F.lit(0.5)
    lng1 = F.lit(grid.lng_0) + (x - half) / F.lit(grid.lng_denom)
    lng2 = F.lit(grid.lng_0) + (x + width - half) / F.lit(grid.lng_denom)
    lat1 = F.lit(grid.lat_0) + (y - half) / F.lit(grid.lat_denom)
    lat2 = F.lit(grid.lat_0) + (y + width - half) / F.lit(grid.lat_denom)
    return {"lng1": lng1, "lng2": lng2, "lat1": lat1, "lat2": lat2, "mx1": mercator_x(lng1), "mx2": mercator_x(lng2), "my1": mercator_y(lat2), "my2": mercator_y(lat1)}


def tile_range(low: Column, high: Column, z: int | Column, reach: float | Column) -> tuple[Column, Column]:
    """First and last tile that a mercator interval touches when widened by reach."""
    scale = F.lit(float(2**z)) if isinstance(z, int) else F.pow(F.lit(2.0), z)
    first = F.floor((low - reach) * scale).cast("int")
    last = (F.ceil((high + reach) * scale) - 1).cast("int")
    return first, last


def normalised_bounds(west: float, south: float, east: float, north: float) -> tuple[float, float, float, float]:
    """Bounds within the world: a span of 360 degrees or one across the antimeridian becomes the whole."""
    south, north = max(-90.0, min(90.0, south)), max(-90.0, min(90.0, north))
    if east - west >= 360:
        return -180.0, south, 180.0, north
    shift = math.floor((west + 180) / 360) * 360
    west, east = west - shift, east - shift
    return (-180.0, south, 180.0, north) if east > 180 else (west, south, east, north)


def centre_zoom(west: float, south: float, east: float, north: float, min_zoom: int, max_zoom: int) -> int:
    span = min(360 / max(east - west, 1e-9), 180 / max(north - south, 1e-9))
    return max(min_zoom, min(max_zoom, max(0, min(22, math.floor(math.log2(span))))))


def hilbert_tile_id(z: int, x: int, y: int) -> int:
    """Place of a tile in an archive: tiles of lower zooms first, then along a Hilbert curve."""
    base, d, n = (4**z - 1) // 3, 0, 1 << z
    s = n >> 1
    while s:
        rx, ry = int(bool(x & s)), int(bool(y & s))
        d += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = n - 1 - x, n - 1 - y
            x, y = y, x
        s >>= 1
    return base + d

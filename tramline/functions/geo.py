"""Distances on the sphere and in the plane, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.functions.constants import EARTH_M


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Metres between two points in degrees."""
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    # Not least(1, ...), which would turn an unknown place into half the way around the earth.
    return F.lit(2 * EARTH_M) * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))


def planar_metres(lat1, lon1, lat2, lon2) -> Column:
    """Metres in a plane with fixed scales for a degree, good at 30 degrees north."""
    return F.hypot((lat2 - lat1) * 111000.0, (lon2 - lon1) * 96000.0)


def segment_metres(lat, lon, lat1, lon1, lat2, lon2) -> tuple[Column, Column]:
    """Metres from a point to a segment, and how far along the segment (0 to 1) the nearest place lies."""
    scale = F.cos(F.radians(lat)) * 111320.0
    px, py, qx, qy = (lon - lon1) * scale, (lat - lat1) * 111320.0, (lon2 - lon1) * scale, (lat2 - lat1) * 111320.0
    length = qx * qx + qy * qy
    t = F.when(length > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (px * qx + py * qy) / length))).otherwise(0.0)
    return F.hypot(px - t * qx, py - t * qy), t


def turn(ax, ay, bx, by, cx, cy) -> Column:
    """Whether going from a to b to c turns left."""
    return (cy - ay) * (bx - ax) > (by - ay) * (cx - ax)


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    return (turn(ax, ay, cx, cy, dx, dy) != turn(bx, by, cx, cy, dx, dy)) & (turn(ax, ay, bx, by, cx, cy) != turn(ax, ay, bx, by, dx, dy))


def in_polygon(lat, lon, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule over a constant polygon of (lat, lon)."""
    inside = F.lit(False)
    for (lat1, lon1), (lat2, lon2) in zip(polygon, polygon[-1:] + polygon[:-1], strict=True):
        if lat1 == lat2:
            continue
        crosses = (F.lit(lat1) > lat) != (F.lit(lat2) > lat)
        inside = inside != (crosses & (lon < (lat - lat1) * ((lon2 - lon1) / (lat2 - lat1)) + lon1))
    return inside

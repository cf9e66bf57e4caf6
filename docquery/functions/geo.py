"""Distances and areas on the globe as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

RADIUS_KM = 6371.0
KM_PER_MILE = 6371.0 / 3958.8


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km."""
    lat1, lon1, lat2, lon2 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return RADIUS_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def point_of_text(c: Column) -> tuple[Column, Column]:
    """lat and lon of "lat,lon"; null if it is not that."""
    parts = F.split(c, ",")
    two = F.size(parts) == 2
    return F.when(two, F.trim(F.get(parts, F.lit(0))).try_cast("double")), F.when(two, F.trim(F.get(parts, F.lit(1))).try_cast("double"))


def point_of_struct(c: Column) -> tuple[Column, Column]:
    """lat and lon fields, 0 where one of them is missing; null where the struct is."""
    return tuple(F.when(c.isNotNull(), F.coalesce(c[k].try_cast("double"), F.lit(0.0))) for k in ("lat", "lon"))


def point_of_pair(c: Column) -> tuple[Column, Column]:
    """lat and lon of [lon, lat]."""
    return F.get(c, F.lit(1)).cast("double"), F.get(c, F.lit(0)).cast("double")


def within(lat: Column, lon: Column, centre: tuple[float, float], distance: float, unit: str = "km") -> Column:
    """distance or nearer; a box of latitudes is tested first, and false where there is no point."""
    km = distance * KM_PER_MILE if unit in ("mi", "miles") else distance
    degrees = km / RADIUS_KM * 57.29577951308232 + 1e-9
    near = lat.between(centre[0] - degrees, centre[0] + degrees) & (haversine(centre[0], centre[1], lat, lon) <= km)
    return F.coalesce(near, F.lit(False))


def inside(lat: Column, lon: Column, polygon: list[tuple[float, float]]) -> Column:
    """Ray casting over (lat, lon) vertices; fewer than three hold nothing."""
    if len(polygon) < 3:
        return F.lit(False)
    edges = list(zip(polygon, [polygon[-1], *polygon[:-1]], strict=True))
    box = lat.between(min(p[0] for p in polygon), max(p[0] for p in polygon)) & lon.between(min(p[1] for p in polygon), max(p[1] for p in polygon))
    array = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(c)).alias("c"), F.lit(float(d)).alias("d")) for (a, b), (c, d) in edges if b != d])
    crosses = lambda e: ((e["b"] > lon) != (e["d"] > lon)) & (lat < (e["c"] - e["a"]) * (lon - e["b"]) / (e["d"] - e["b"]) + e["a"])
    return F.coalesce(box & F.aggregate(array, F.lit(False), lambda acc, e: acc != crosses(e)), F.lit(False))


def inside_any(lat: Column, lon: Column, polygons: list[list[tuple[float, float]]]) -> Column:
    return reduce(lambda a, p: a | inside(lat, lon, p), polygons, F.lit(False))


def near_line(lat: Column, lon: Column, line: list[tuple[float, float]], km: float, exact: bool = False) -> Column:
    """Whether a point is within km of a line of (lat, lon) points.

    As in the original formula the place on a segment is a product of radians over squared km, in effect its start;
    exact projects in degrees of equal length instead.
    """
    if len(line) < 2:
        return F.lit(False)
    parts = []
    for (a, b), (c, d) in zip(line[:-1], line[1:], strict=True):
        if (a, b) == (c, d):
            parts.append(haversine(lat, lon, a, b))
            continue
        if exact:
            k = F.pow(F.cos(F.radians(F.lit((a + c) / 2))), 2)
            u = ((lat - a) * (c - a) + k * (lon - b) * (d - b)) / ((c - a) ** 2 + k * (d - b) ** 2)
        else:
            u = (F.radians(lat - a) * F.radians(F.lit(c - a)) + F.radians(lon - b) * F.radians(F.lit(d - b))) / F.pow(haversine(a, b, c, d), 2)
        u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), u))
        parts.append(haversine(lat, lon, a + u * (c - a), b + u * (d - b)))
    return F.coalesce((F.least(*parts) if len(parts) > 1 else parts[0]) <= km, F.lit(False))

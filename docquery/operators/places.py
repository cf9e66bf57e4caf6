"""Many points against a table of circles, polygons and lines: cells of a grid as keys of an equi-join, then the exact test.

A shape is covered by cells of the grid level at which its box is a few cells wide, a point lies in one cell of each level
that any shape has. So a point and a shape meet once or not at all, small shapes meet few points, and large ones have few
cells. Longitudes go round: a cell's number is taken modulo the circle, so that circles and lines reach over the date line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docquery.functions.geo import RADIUS_KM, haversine

#: Cells of level n are 180 / 2 ** n degrees wide; a box is about CELLS of them wide at its shape's level.
LEVELS, CELLS = 20, 3
#: What makes two shapes one figure.
_FIGURE = ["kind", "points", "km"]


def _box(points: Column, km: Column) -> Column:
    """South, north, west and east of all that is within km of the points or between them, in degrees."""
    lats, lons = F.transform(points, lambda p: p["lat"].cast("double")), F.transform(points, lambda p: p["lon"].cast("double"))
    angle = km / RADIUS_KM + 1e-9
    degrees = F.degrees(angle)
    south, north = F.array_min(lats) - degrees, F.array_max(lats) + degrees
    furthest = F.radians(F.greatest(F.abs(F.array_min(lats)), F.abs(F.array_max(lats))))
    pole = (furthest + angle >= 1.5707) | (angle >= 1.57)
    aside = F.when(pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.sin(angle) / F.cos(furthest), F.lit(1.0)))) + 1e-9)
    return F.struct(south.alias("south"), north.alias("north"), (F.array_min(lons) - aside).alias("west"), (F.array_max(lons) + aside).alias("east"))


def _size(level: Column) -> Column:
    return F.lit(180.0) / F.pow(F.lit(2.0), level)


def _ring(level: Column) -> Column:
    return (2 * F.pow(F.lit(2.0), level)).cast("long")


def covered(shapes: DataFrame) -> DataFrame:
    """The shapes with their grid level and a row for each cell of it that their box touches.

    shapes: shape, kind (circle: one point; polygon: three or more; line: two or more), points array<struct<lat, lon>>, km
    (not for polygons). What is none of these, or has a null in it, holds nothing and is left out.
    """
    n = F.size("points")
    sound = ((F.col("kind") == "circle") & (n == 1)) | ((F.col("kind") == "polygon") & (n >= 3)) | ((F.col("kind") == "line") & (n >= 2))
    whole = F.forall("points", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    km = F.when(F.col("kind") == "polygon", 0.0).otherwise(F.col("km").cast("double"))
    rows = shapes.select("shape", "kind", "points", km.alias("km")).where(sound & whole & (F.col("km") >= 0)).withColumn("box", _box(F.col("points"), F.col("km")))
    widest = F.greatest(F.col("box.north") - F.col("box.south"), F.col("box.east") - F.col("box.west"), F.lit(1e-6))
    rows = rows.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(F.log2(180.0 * CELLS / widest)))).cast("int"))
    span = lambda a, b, zero: F.sequence(F.floor((F.col(a) + zero) / _size(F.col("level"))), F.floor((F.col(b) + zero) / _size(F.col("level"))))
    around = F.array_distinct(F.transform(span("box.west", "box.east", 180.0), lambda i: F.pmod(i, _ring(F.col("level")))))
    return rows.withColumn("y", F.explode(span("box.south", "box.north", 90.0))).withColumn("x", F.explode(around)).drop("box")


def _holds(lat: Column, lon: Column) -> Column:
    """The exact tests of functions.geo on a shape's own columns."""
    first = F.element_at("points", 1)
    reach = F.col("km") / RADIUS_KM * 57.29577951308232 + 1e-9
    circle = lat.between(first["lat"] - reach, first["lat"] + reach) & (haversine(first["lat"], first["lon"], lat, lon) <= F.col("km"))
    edges = F.arrays_zip(F.col("points").alias("p"), F.concat(F.slice("points", -1, 1), F.slice("points", 1, F.size("points") - 1)).alias("q"))
    slope = lambda e: (e["q"]["lat"] - e["p"]["lat"]) * (lon - e["p"]["lon"]) / F.nullif(e["q"]["lon"] - e["p"]["lon"], F.lit(0.0)) + e["p"]["lat"]
    crosses = lambda e: ((e["p"]["lon"] > lon) != (e["q"]["lon"] > lon)) & F.coalesce(lat < slope(e), F.lit(False))
    polygon = F.aggregate(edges, F.lit(False), lambda acc, e: acc != crosses(e))
    parts = F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("p"), F.slice("points", 2, F.size("points") - 1).alias("q"))

    def apart(e: Column) -> Column:
        a, b, c, d = e["p"]["lat"], e["p"]["lon"], e["q"]["lat"], e["q"]["lon"]
        u = (F.radians(lat - a) * F.radians(c - a) + F.radians(lon - b) * F.radians(d - b)) / F.nullif(F.pow(haversine(a, b, c, d), 2), F.lit(0.0))
        u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(u, F.lit(0.0))))
        return haversine(lat, lon, a + u * (c - a), b + u * (d - b))

    line = F.array_min(F.transform(parts, apart)) <= F.col("km")
    return F.coalesce(F.when(F.col("kind") == "circle", circle).when(F.col("kind") == "polygon", polygon).otherwise(line), F.lit(False))


def figures_at(spots: DataFrame, figures: DataFrame) -> DataFrame:
    """(_lat, _lon, kind, points, km) of places and figures that hold them, all of them distinct.

    Only the few grid levels that the figures have come to the driver.
    """
    cells = covered(figures.withColumn("shape", F.lit(""))).drop("shape")
    levels = sorted(r[0] for r in cells.select("level").distinct().collect())
    at = spots.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    y, x = F.floor((F.col("_lat") + 90.0) / _size(F.col("level"))), F.pmod(F.floor((F.col("_lon") + 180.0) / _size(F.col("level"))), _ring(F.col("level")))
    met = at.withColumns({"y": y, "x": x}).join(cells, ["level", "y", "x"])
    return met.where(_holds(F.col("_lat"), F.col("_lon"))).select("_lat", "_lon", *_FIGURE)


def located(points: DataFrame, key: str, lat: str, lon: str, shapes: DataFrame) -> DataFrame:
    """(key, shape) of every point and every shape that holds it, by the tests of functions.geo (lines by the original formula).

    Points without a place are in none. Equal places and equal figures are tested once, and their points and shapes joined to
    what was found.
    """
    typed = F.transform("points", lambda p: F.struct(p["lat"].cast("double").alias("lat"), p["lon"].cast("double").alias("lon")))
    km = F.when(F.col("kind") == "polygon", 0.0).otherwise(F.col("km").cast("double"))
    named = shapes.select("shape", "kind", typed.alias("points"), km.alias("km"))
    at = points.select(F.col(key).alias("_key"), F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon")).where("_lat is not null and _lon is not null")
    found = figures_at(at.select("_lat", "_lon").distinct(), named.select(*_FIGURE).distinct())
    return at.join(found.join(named, _FIGURE).select("_lat", "_lon", "shape"), ["_lat", "_lon"]).select(F.col("_key").alias(key), "shape")

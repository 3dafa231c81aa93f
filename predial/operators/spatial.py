"""Distances, radius counts and polygons, by grid cells instead of cross products of large sides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predial.functions.numeric import haversine
from predial.operators.clean import truth

METRES_PER_DEGREE = 111_194.9


def distinct_points(rows: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The distinct coordinates, computed on once and joined back."""
    return rows.select(lat, lon).dropna().distinct()


def _farthest(*sides: DataFrame) -> float:
    """The latitude of all sides that is farthest from the equator; one number reaches the driver for each."""
    return max(s.agg(F.max(F.abs(s.columns[0]))).first()[0] or 0.0 for s in sides)


def _cells(lat: Column, lon: Column, metres: float, widest_lat: float = 60.0) -> tuple[Column, Column]:
    """Cells at least metres wide up to the latitude widest_lat and metres beyond it."""
    step = metres / METRES_PER_DEGREE
    widest_lat = min(widest_lat + step, 89.99)
    return F.floor(lat / step), F.floor(lon / (step / math.cos(math.radians(widest_lat))))


def radius_count(points: DataFrame, others: DataFrame, metres: float, name: str) -> DataFrame:
    """Distinct points (lat, lon) with the number of others (lat, lon) nearer than metres (J11); null without coordinates.

    Both sides fall into grid cells as wide as the radius; each point looks into its nine cells, so only near pairs meet.
    """
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    far = _farthest(points.select("lat"), others.select("lat"))
    cy, cx = _cells(F.col("lat"), F.col("lon"), metres, far)
    asked = points.withColumns({"_y": cy, "_x": cx})
    asked = asked.withColumn("_dy", F.explode(near)).withColumn("_dx", F.explode(near)).withColumns({"_y": F.col("_y") + F.col("_dy"), "_x": F.col("_x") + F.col("_dx")})
    oy, ox = _cells(F.col("_olat"), F.col("_olon"), metres, far)
    given = others.select(F.col("lat").alias("_olat"), F.col("lon").alias("_olon")).groupBy("_olat", "_olon").agg(F.count("*").alias("_m")).withColumns({"_y": oy, "_x": ox})
    hit = asked.join(given, ["_y", "_x"]).filter(haversine(F.col("lat"), F.col("lon"), F.col("_olat"), F.col("_olon")) < metres)
    counts = hit.groupBy("lat", "lon").agg(F.sum("_m").alias(name))
    return points.join(counts, ["lat", "lon"], "left").withColumn(name, F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.coalesce(name, F.lit(0))))


#: Points of interest are broadcast up to this number; above, they are searched for ring by ring.
FEW = 5_000


def nearest(points: DataFrame, others: DataFrame, name: str, ring: float = 2_000.0) -> DataFrame:
    """Distinct points (lat, lon) with the distance to the nearest of others.

    A few others are broadcast; many are met in the grid cells around, in rings that double until each point has met one
    within the ring's reach.
    """
    d = haversine(F.col("lat"), F.col("lon"), F.col("_olat"), F.col("_olon"))
    given = others.select(F.col("lat").alias("_olat"), F.col("lon").alias("_olon")).distinct()
    n = given.limit(FEW + 1).count()
    if n == 0:
        return points.withColumn(name, F.lit(None).cast("double"))
    if n <= FEW:
        return points.crossJoin(F.broadcast(given)).groupBy("lat", "lon").agg(F.min(d).alias(name))
    found, left = None, points
    far = _farthest(points.select("lat"), given.select("_olat"))
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    while ring < 4e7:
        cy, cx = _cells(F.col("lat"), F.col("lon"), ring, far)
        oy, ox = _cells(F.col("_olat"), F.col("_olon"), ring, far)
        asked = left.withColumns({"_y": cy, "_x": cx}).withColumn("_dy", F.explode(near)).withColumn("_dx", F.explode(near)).withColumns({"_y": F.col("_y") + F.col("_dy"), "_x": F.col("_x") + F.col("_dx")})
        best = asked.join(given.withColumns({"_y": oy, "_x": ox}), ["_y", "_x"]).groupBy("lat", "lon").agg(F.min(d).alias(name)).filter(F.col(name) <= ring)
        found = best if found is None else found.unionByName(best)
        left = left.join(best.select("lat", "lon"), ["lat", "lon"], "left_anti")
        if left.isEmpty():
            break
        ring *= 4
    return found


def nearest_pole(lat: Column, lon: Column, poles: list[tuple[float, float]]) -> Column:
    """The distance to the nearest of a few fixed places."""
    return F.least(*(haversine(lat, lon, F.lit(a), F.lit(b)) for a, b in poles), F.lit(None).cast("double"))


def crossings(x: Column, y: Column) -> Column:
    """Whether the ray to the right of (x, y) crosses the edge x1, y1, x2, y2."""
    spans = (F.col("y1") > y) != (F.col("y2") > y)
    at = F.col("x1") + F.try_divide((y - F.col("y1")) * (F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1"))
    return truth(spans & (x < at))


def edge_distance(x: Column, y: Column) -> Column:
    """The distance in the plane from (x, y) to the edge x1, y1, x2, y2."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.try_divide((x - F.col("x1")) * dx + (y - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(x - F.col("x1") - t * dx, 2) + F.pow(y - F.col("y1") - t * dy, 2))


def point_in_polygon(points: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """Pairs of distinct points (x, y) and polygons (poly_id) that hold them.

    Polygons are known in the grid cells that their boxes cover; a point meets those of its own cell and counts crossings.
    """
    box = edges.groupBy("poly_id").agg(F.floor(F.min("x1") / cell).alias("xa"), F.floor(F.max("x1") / cell).alias("xb"), F.floor(F.min("y1") / cell).alias("ya"), F.floor(F.max("y1") / cell).alias("yb"))
    cells = box.select("poly_id", F.explode(F.sequence("xa", "xb")).alias("cx"), "ya", "yb").select("poly_id", "cx", F.explode(F.sequence("ya", "yb")).alias("cy"))
    asked = points.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    met = asked.join(cells, ["cx", "cy"]).join(edges, "poly_id")
    inside = met.groupBy("x", "y", "poly_id").agg(F.sum(crossings(F.col("x"), F.col("y")).cast("int")).alias("_n"))
    return inside.filter("_n % 2 = 1").select("x", "y", "poly_id")


def assign_polygon(points: DataFrame, edges: DataFrame, priority: DataFrame, cell: float) -> DataFrame:
    """Distinct points with the first of their polygons in a priority (poly_id, orden), and how many hold them."""
    inside = point_in_polygon(points, edges, cell).join(priority, "poly_id")
    best = inside.groupBy("x", "y").agg(F.min_by("poly_id", F.struct("orden", "poly_id")).alias("poly_id"), F.count("*").alias("n_poligonos"))
    return points.join(best, ["x", "y"], "left").withColumn("n_poligonos", F.coalesce("n_poligonos", F.lit(0)))


def edge_distances(points: DataFrame, edges: DataFrame, name: str, ring: float = 500.0, few: int = FEW) -> DataFrame:
    """Distinct points (x, y) with the distance to the nearest edge.

    A few edges are broadcast. Many are known in the grid cells that their boxes cover; points look into the nine cells
    around, in rings that grow until each point has met an edge within the ring's reach.
    """
    d = edge_distance(F.col("x"), F.col("y"))
    n = edges.limit(few + 1).count()
    if n == 0:
        return points.withColumn(name, F.lit(None).cast("double"))
    if n <= few:
        return points.crossJoin(F.broadcast(edges)).groupBy("x", "y").agg(F.min(d).alias(name))
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    found, left = None, points
    while True:
        cell = lambda v, r=ring: F.floor(v / r)
        span = lambda p: F.explode(F.sequence(cell(F.least(f"{p}1", f"{p}2")), cell(F.greatest(f"{p}1", f"{p}2"))))  # noqa: E731, B023
        given = edges.withColumn("_cx", span("x")).withColumn("_cy", span("y"))
        asked = left.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
        asked = asked.withColumns({"_cx": cell(F.col("x")) + F.col("_dx"), "_cy": cell(F.col("y")) + F.col("_dy")})
        best = asked.join(given, ["_cx", "_cy"]).groupBy("x", "y").agg(F.min(d).alias(name)).filter(F.col(name) <= ring)
        found = best if found is None else found.unionByName(best)
        left = left.join(best.select("x", "y"), ["x", "y"], "left_anti")
        if left.isEmpty():
            return found
        ring *= 4


def polygon_distance(points: DataFrame, edges: DataFrame, cell: float, name: str) -> DataFrame:
    """Distinct points with the distance to the nearest polygon, 0 inside."""
    away = edge_distances(points.dropna(subset=["x", "y"]), edges, "_d")
    inside = point_in_polygon(points, edges, cell).select("x", "y").distinct().withColumn("_in", F.lit(True))
    out = points.join(away, ["x", "y"], "left").join(inside, ["x", "y"], "left")
    return out.withColumn(name, F.when(F.col("_in"), F.lit(0.0)).otherwise(F.col("_d"))).drop("_d", "_in")


def polygon_areas(edges: DataFrame, *by: str) -> DataFrame:
    """Areas by the shoelace sum (N37); rings are oriented, so holes count off."""
    return edges.groupBy(*by).agg(F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"))


def covered_area(points: DataFrame, edges: DataFrame, metres: float, step: float, name: str) -> DataFrame:
    """Hectares of the union of polygons within metres of each distinct point (x, y), on a grid of step metres.

    Polygons become distinct grid cells, which dissolves overlaps; a point counts cell centres in reach. The error is at
    most the ring of cells that the circle cuts.
    """
    box = edges.groupBy("poly_id").agg(*(f(F.floor(F.col(c) / step)).alias(n) for n, f, c in (("xa", F.min, "x1"), ("xb", F.max, "x1"), ("ya", F.min, "y1"), ("yb", F.max, "y1"))))
    grid = box.select("poly_id", F.explode(F.sequence("xa", "xb")).alias("gx"), "ya", "yb").select("poly_id", "gx", F.explode(F.sequence("ya", "yb")).alias("gy"))
    centres = grid.withColumns({"x": (F.col("gx") + 0.5) * step, "y": (F.col("gy") + 0.5) * step})
    held = centres.join(edges, "poly_id").groupBy("poly_id", "x", "y").agg(F.sum(crossings(F.col("x"), F.col("y")).cast("int")).alias("_n")).filter("_n % 2 = 1")
    cells = held.select(F.col("x").alias("_gx"), F.col("y").alias("_gy")).distinct()
    key = lambda c, d=0: F.floor(F.col(c) / metres) + d
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    asked = points.withColumn("_o", around).withColumns({"_cx": key("x") + F.col("_o.i"), "_cy": key("y") + F.col("_o.j")})
    met = asked.join(cells.withColumns({"_cx": key("_gx"), "_cy": key("_gy")}), ["_cx", "_cy"])
    met = met.filter(F.pow(F.col("x") - F.col("_gx"), 2) + F.pow(F.col("y") - F.col("_gy"), 2) <= metres * metres)
    found = met.groupBy("x", "y").agg((F.count("*") * step * step / 10_000).alias(name))
    return points.join(found, ["x", "y"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def distance_to_own(rows: DataFrame, edges: DataFrame, area: str, name: str) -> DataFrame:
    """rows (x, y, area) with the distance to the polygons of their own area (poly_id), 0 inside, null where it has none."""
    places = rows.select("x", "y", area).distinct()
    met = places.join(edges.select(F.col("poly_id").alias(area), "x1", "y1", "x2", "y2"), area)
    x, y = F.col("x"), F.col("y")
    per = met.groupBy("x", "y", area).agg(F.min(edge_distance(x, y)).alias("_d"), F.sum(crossings(x, y).cast("int")).alias("_n"))
    per = per.withColumn(name, F.when(F.col("_n") % 2 == 1, 0.0).otherwise(F.col("_d"))).drop("_d", "_n")
    return rows.join(per, ["x", "y", area], "left")

"""Coastline polygons: reading, closing, clipping to a box."""

from __future__ import annotations

import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require

Ring = list[tuple[float, float]]


def polygons(node: dict[str, Any]) -> list[list[Ring]]:
    """All polygons (rings, the outer first) of a GeoJSON object of any kind, in order."""
    kind = node.get("type")
    if kind == "FeatureCollection":
        return [p for f in node.get("features") or [] for p in polygons(f)]
    if kind == "Feature":
        return polygons(node["geometry"]) if node.get("geometry") else []
    if kind == "GeometryCollection":
        return [p for g in node.get("geometries") or [] for p in polygons(g)]
    if kind == "Polygon":
        return [[closed(r) for r in node["coordinates"]]]
    if kind == "MultiPolygon":
        return [[closed(r) for r in p] for p in node["coordinates"]]
    return []


def closed(points: list) -> Ring:
    """A valid ring whose last point is its first."""
    ring = [(float(p[0]), float(p[1])) for p in points]
    require(all(math.isfinite(x) and math.isfinite(y) and abs(x) <= 180 and abs(y) <= 90 for x, y in ring), "a ring leaves the globe")
    if ring and not (math.isclose(ring[0][0], ring[-1][0], rel_tol=1e-5, abs_tol=1e-8) and math.isclose(ring[0][1], ring[-1][1], rel_tol=1e-5, abs_tol=1e-8)):
        ring.append(ring[0])
    require(len(ring) >= 4, "a ring needs three points")
    return ring


def clip(ring: Ring, box: tuple[float, float, float, float]) -> Ring | None:
    """The ring within the box (lon_min, lon_max, lat_min, lat_max), closed; none if nothing is left. One half-plane after another."""
    out = ring[:-1] if ring and ring[0] == ring[-1] else list(ring)
    for axis, limit, keep_low in ((0, box[0], False), (0, box[1], True), (1, box[2], False), (1, box[3], True)):
        inside = (lambda p, a=axis, m=limit: p[a] <= m) if keep_low else (lambda p, a=axis, m=limit: p[a] >= m)
        kept: Ring = []
        for before, point in zip([out[-1], *out[:-1]] if out else [], out, strict=True):
            if inside(point) != inside(before):
                share = (limit - before[axis]) / (point[axis] - before[axis])
                cut = [before[0] + share * (point[0] - before[0]), before[1] + share * (point[1] - before[1])]
                cut[axis] = limit
                kept.append((cut[0], cut[1]))
            if inside(point):
                kept.append(point)
        out = kept
        if len(out) < 3:
            return None
    return [*out, out[0]]


def clip_all(shapes: list[list[Ring]], box: tuple[float, float, float, float]) -> list[list[Ring]]:
    """Polygons clipped ring by ring; those without an outer ring left go. Raises if none is left."""
    out = []
    for rings in shapes:
        xs, ys = zip(*rings[0], strict=True)
        if max(xs) < box[0] or min(xs) > box[1] or max(ys) < box[2] or min(ys) > box[3]:
            continue
        if outer := clip(rings[0], box):
            out.append([outer, *(h for r in rings[1:] if (h := clip(r, box)))])
    require(bool(out), "no land within the box")
    return out


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(polygon, ring, points): one row per ring, ring 0 the outer one. The files are coastlines of a region, read whole."""
    text = spark.read.text(path, wholetext=True).first()[0]
    rows = [(i, j, ring) for i, rings in enumerate(polygons(json.loads(text))) for j, ring in enumerate(rings)]
    return spark.createDataFrame(rows, "polygon int, ring int, points array<struct<lon:double,lat:double>>")


def clip_rings(rings: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rings (points) clipped to a box on the executors; rings outside of it go, before any Python runs where their extent shows it."""
    lon, lat = F.expr("transform(points, p -> p.lon)"), F.expr("transform(points, p -> p.lat)")
    near = rings.where((F.array_max(lon) >= box[0]) & (F.array_min(lon) <= box[1]) & (F.array_max(lat) >= box[2]) & (F.array_min(lat) <= box[3]))

    @F.pandas_udf("array<struct<lon:double,lat:double>>")
    def cut(points: pd.Series) -> pd.Series:
        return points.map(lambda ps: [{"lon": x, "lat": y} for x, y in done] if (done := clip([(p["lon"], p["lat"]) for p in ps], box)) else None)

    return near.withColumn("points", cut("points")).where("points is not null")


def ring_area(points: str = "points") -> Any:
    """Area of closed rings in square degrees, by the shoelace formula, within the JVM."""
    return F.expr(f"abs(aggregate(sequence(1, size({points}) - 1), 0D, (s, i) -> s + element_at({points}, i).lon * element_at({points}, i + 1).lat - element_at({points}, i + 1).lon * element_at({points}, i).lat)) / 2")


def extent(cells: DataFrame, box: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """The box cut down to the outer edges of the cells, half a median step beyond their centres."""
    steps = {}
    for name in ("lon", "lat"):
        axis = sorted(r[0] for r in cells.select(name).distinct().collect())
        diffs = sorted(b - a for a, b in zip(axis, axis[1:], strict=False))
        half = (diffs[len(diffs) // 2] if len(diffs) % 2 else (diffs[len(diffs) // 2 - 1] + diffs[len(diffs) // 2]) / 2) / 2 if diffs else 0.0
        steps[name] = (axis[0] - half, axis[-1] + half)
    return max(box[0], steps["lon"][0]), min(box[1], steps["lon"][1]), max(box[2], steps["lat"][0]), min(box[3], steps["lat"][1])

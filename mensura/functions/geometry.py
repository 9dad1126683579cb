"""Polygon and line measures over arrays of points (structs x, y), inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _next(points: Column, i: Column) -> Column:
    return F.get(points, (i + 1) % F.size(points))


def valid(points: Column, least: int, most: int = 500, reach: float = 1e7) -> Column:
    fine = F.forall(points, lambda p: F.coalesce((F.abs(p["x"]) <= reach) & (F.abs(p["y"]) <= reach), F.lit(False)))
    return F.coalesce(F.size(points).between(least, most) & fine, F.lit(False))


def shoelace(points: Column) -> Column:
    """The area inside a ring; null for fewer than three points."""
    cross = F.transform(points, lambda p, i: p["x"] * _next(points, i)["y"] - _next(points, i)["x"] * p["y"])
    return F.when(F.size(points) >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda a, b: a + b)) / 2)


def _steps(points: Column, closed: bool) -> Column:
    steps = F.transform(points, lambda p, i: F.sqrt(F.pow(_next(points, i)["x"] - p["x"], 2) + F.pow(_next(points, i)["y"] - p["y"], 2)))
    return steps if closed else F.slice(steps, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0)))


def perimeter(points: Column) -> Column:
    return F.when(F.size(points) >= 3, F.aggregate(_steps(points, True), F.lit(0.0), lambda a, b: a + b))


def polyline(points: Column) -> Column:
    return F.when(F.size(points) >= 2, F.aggregate(_steps(points, False), F.lit(0.0), lambda a, b: a + b))


def centroid(points: Column) -> Column:
    """The mean of the vertices."""
    mean = lambda c: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[c]) / F.size(points)
    return F.when(F.size(points) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def box(points: Column) -> Column:
    side = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return F.struct(
        side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1")
    )


def box_overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    size = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return F.coalesce(F.try_divide(w * h, size(a) + size(b) - w * h), F.lit(0.0))


def aspect(points: Column) -> Column:
    r = box(points)
    w, h = r["x1"] - r["x0"], r["y1"] - r["y0"]
    return F.try_divide(F.greatest(w, h), F.least(w, h))


def affine(points: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> Column:
    """Points under x' = ax + cy + e, y' = bx + dy + f."""
    return F.transform(points, lambda p: F.struct((p["x"] * a + p["y"] * c + e).alias("x"), (p["x"] * b + p["y"] * d + f).alias("y")))


def net_area(outer: Column, holes: Column) -> Column:
    """Area of a ring less that of holes that lie inside its box."""
    inside = F.filter(holes, lambda h: (F.size(h) >= 3) & (box(h)["x0"] >= box(outer)["x0"]) & (box(h)["x1"] <= box(outer)["x1"]))
    return shoelace(outer) - F.aggregate(F.transform(inside, shoelace), F.lit(0.0), lambda a, b: a + b)

"""Boxes (x, y, w, h) as column expressions; ``a`` and ``b`` are structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(a: Column) -> Column:
    return a["w"] * a["h"]


def center(a: Column) -> Column:
    return F.struct((a["x"] + a["w"] / 2).alias("x"), (a["y"] + a["h"] / 2).alias("y"))


def distance(a: Column, b: Column) -> Column:
    p, q = center(a), center(b)
    return F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))


def intersects(a: Column, b: Column) -> Column:
    """Touching edges count."""
    return ~((a["x"] + a["w"] < b["x"]) | (b["x"] + b["w"] < a["x"]) | (a["y"] + a["h"] < b["y"]) | (b["y"] + b["h"] < a["y"]))


def intersection(a: Column, b: Column) -> Column:
    width = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    height = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - intersection(a, b)
    return F.when(intersects(a, b) & (union > 0), intersection(a, b) / union).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Shared area by the smaller area; 0 for boxes without area."""
    return F.coalesce(F.try_divide(intersection(a, b), F.least(area(a), area(b))), F.lit(0.0))


def box_of_polygon(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    return F.when(F.size(points) >= 4, F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - x).alias("w"), (F.array_max(ys) - y).alias("h")))


def angle_bin(angle: Column, bins: int = 18, top: float = 180.0) -> Column:
    """Bin 0 to bins - 1 over [0, top]; the last is closed."""
    return F.least(F.floor(angle * bins / top), F.lit(bins - 1)).cast("int")

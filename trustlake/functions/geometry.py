"""Bounding boxes as column arithmetic. A box is a struct (x_min, y_min, x_max, y_max)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustlake.functions.numeric import clamp

_CORNERS = ("x_min", "y_min", "x_max", "y_max")


def corners(x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    """Clamped corner struct; null when inverted or when any part is missing."""
    parts = [clamp(p) for p in (x_min, y_min, x_max, y_max)]
    box = F.struct(*[p.alias(n) for p, n in zip(parts, _CORNERS)])
    usable = (parts[2] >= parts[0]) & (parts[3] >= parts[1])
    for raw in (x_min, y_min, x_max, y_max):
        usable = usable & raw.isNotNull()
    return F.when(usable, box)


def box_from_xywh(bbox: Column, width: Column, height: Column) -> Column:
    """Pixel box ``[x, y, w, h]`` to normalised corners."""
    x, y, w, h = (F.try_element_at(bbox, F.lit(i)) for i in (1, 2, 3, 4))
    box = corners(x / width, y / height, (x + w) / width, (y + h) / height)
    return F.when(F.size(bbox) == 4, box)


def box_from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """Normalised centre box to corners."""
    return corners(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def polygon_envelope(coords: Column) -> Column:
    """Corners around a flat x,y,x,y,... polygon of at least three points."""
    xs = F.filter(coords, lambda _, i: i % 2 == 0)
    ys = F.filter(coords, lambda _, i: i % 2 == 1)
    box = corners(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    return F.when((F.size(coords) >= 6) & (F.size(coords) % 2 == 0), box)


def valid_box(bbox: Column) -> Column:
    """Four coordinates in [0, 1.05] and not inverted, for an array-typed box."""
    c = [F.try_element_at(bbox, F.lit(i)) for i in (1, 2, 3, 4)]
    inside = c[0].between(0.0, 1.05)
    for part in c[1:]:
        inside = inside & part.between(0.0, 1.05)
    return F.coalesce((F.size(bbox) == 4) & inside & (c[2] >= c[0]) & (c[3] >= c[1]), F.lit(False))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two corner structs."""
    w = F.greatest(F.lit(0.0), F.least(a["x_max"], b["x_max"]) - F.greatest(a["x_min"], b["x_min"]))
    h = F.greatest(F.lit(0.0), F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"]))
    area_a = F.greatest(F.lit(0.0), a["x_max"] - a["x_min"]) * F.greatest(F.lit(0.0), a["y_max"] - a["y_min"])
    area_b = F.greatest(F.lit(0.0), b["x_max"] - b["x_min"]) * F.greatest(F.lit(0.0), b["y_max"] - b["y_min"])
    union = area_a + area_b - w * h
    return F.when(union <= 0, 0.0).otherwise(clamp(F.try_divide(w * h, union)))


def centre_size_delta(a: Column, b: Column) -> Column:
    """L1 distance of two boxes in (centre x, centre y, width, height)."""
    def axis(box: Column, low: str, high: str) -> tuple[Column, Column]:
        return (box[low] + box[high]) / 2, box[high] - box[low]

    total = F.lit(0.0)
    for low, high in (("x_min", "x_max"), ("y_min", "y_max")):
        centre_a, size_a = axis(a, low, high)
        centre_b, size_b = axis(b, low, high)
        total = total + F.abs(centre_a - centre_b) + F.abs(size_a - size_b)
    return total


def grid_cell(box: Column, side: int = 4) -> Column:
    """Row-major cell of the box centre on a side x side grid."""
    def slot(low: str, high: str) -> Column:
        at = F.floor((box[low] + box[high]) / 2 * side).cast("int")
        return F.greatest(F.lit(0), F.least(F.lit(side - 1), at))

    return slot("y_min", "y_max") * side + slot("x_min", "x_max")

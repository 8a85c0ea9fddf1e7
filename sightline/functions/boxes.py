"""Geometry of bounding boxes (x1, y1, x2, y2) as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_geometry(b: Column) -> Column:
    """struct(width, height, area, aspect, cx, cy)."""
    w, h = b[2] - b[0], b[3] - b[1]
    return F.struct(w.alias("width"), h.alias("height"), (w * h).alias("area"), F.when(h > 0, w / h).otherwise(0.0).alias("aspect"), ((b[0] + b[2]) / 2).alias("cx"), ((b[1] + b[3]) / 2).alias("cy"))


def absolute_box(inner: Column, outer: Column) -> Column:
    """A box within a crop in the coordinates of the frame."""
    return F.array(inner[0] + outer[0], inner[1] + outer[1], inner[2] + outer[0], inner[3] + outer[1])


def iou(a: Column | list[Column], b: Column | list[Column]) -> Column:
    """Intersection over union; 0 for disjoint boxes. A box is an array or its four columns."""
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    both = side(0, 2) * side(1, 3)
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    union = area(a) + area(b) - both
    return F.when((both <= 0) | (union <= 0), 0.0).otherwise(both / union)


def snapshot_quality(b: Column, frame_w: Column, frame_h: Column, lap_var: Column) -> Column:
    """0.35 area, 0.20 centrality, 0.45 sharpness (from a Laplacian variance), within [0, 1]."""
    g = box_geometry(b)
    dx, dy = g["cx"] / frame_w - 0.5, g["cy"] / frame_h - 0.5
    central = F.when((frame_w > 0) & (frame_h > 0), F.greatest(F.lit(0.0), 1 - F.sqrt(dx * dx + dy * dy) * F.sqrt(F.lit(2.0)))).otherwise(0.5)
    total = 0.35 * F.least(F.lit(1.0), g["area"] / 90000.0) + 0.20 * central + 0.45 * F.least(F.lit(1.0), F.coalesce(lap_var, F.lit(0.0)) / 250.0)
    return F.when(g["area"] <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))

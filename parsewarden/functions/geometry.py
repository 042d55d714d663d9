"""Boxes and image coverage. Boxes are [x0, y0, x1, y1] in the parser's own system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def points_to_bbox(points: Column) -> Column:
    """Box around points; null for none, or where a point lacks a coordinate."""
    x = F.transform(points, lambda p: F.try_element_at(p, F.lit(1)))
    y = F.transform(points, lambda p: F.try_element_at(p, F.lit(2)))
    broken = F.exists(x, lambda v: v.isNull()) | F.exists(y, lambda v: v.isNull())
    return F.when((F.size(points) > 0) & ~broken, F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)))


def xywh_to_bbox(box: Column) -> Column:
    """Box of a struct with x, y, w, h; null if any is missing."""
    x, y, w, h = (box.getField(k).cast("double") for k in "xywh")
    return F.when(x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull(), F.array(x, y, x + w, y + h))


def image_coverages(images: Column, width: Column, height: Column) -> Column:
    """Share of the page of each well-formed image; none if the page has no area."""
    area = width * height

    def share(i: Column) -> Column:
        w = F.greatest(i["x1"] - i["x0"], F.lit(0.0))
        h = F.greatest(i["bottom"] - i["top"], F.lit(0.0))
        whole = i["x0"].isNotNull() & i["x1"].isNotNull() & i["top"].isNotNull() & i["bottom"].isNotNull()
        return F.when(whole, F.least(F.greatest(w * h / area, F.lit(0.0)), F.lit(1.0)))

    none = F.array().cast("array<double>")
    return F.when(area > 0, F.filter(F.transform(F.coalesce(images, F.array().cast("array<struct<x0:double,x1:double,top:double,bottom:double>>")), share), lambda c: c.isNotNull())).otherwise(none)


def largest(coverages: Column) -> Column:
    return F.coalesce(F.array_max(coverages), F.lit(0.0))


def total(coverages: Column) -> Column:
    return F.least(F.aggregate(coverages, F.lit(0.0), lambda a, c: a + c), F.lit(1.0))

"""Column expressions for boxes, segments and points. Boxes are given by four columns x1, y1, x2, y2."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "", alias: str = "") -> Box:
        at = f"{alias}." if alias else ""
        return cls(*(F.col(f"{at}{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))

    @classmethod
    def field(cls, struct: Column) -> Box:
        return cls(*(struct[c] for c in ("x1", "y1", "x2", "y2")))

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) / F.lit(2.0)

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) / F.lit(2.0)


def intersection(a: Box, b: Box) -> Column:
    wide = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    high = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(F.lit(0), wide) * F.greatest(F.lit(0), high)


def union_area(a: Box, b: Box) -> Column:
    return a.area + b.area - intersection(a, b)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    return F.when(union_area(a, b) > 0, intersection(a, b) / union_area(a, b)).otherwise(F.lit(0.0))


def iou_at_least(a: Box, b: Box, percent: int) -> Column:
    """IoU >= percent / 100, in integers."""
    return (union_area(a, b) > 0) & (intersection(a, b) * 100 >= union_area(a, b) * percent)


def iou_above(a: Box, b: Box, percent: int) -> Column:
    return intersection(a, b) * 100 > union_area(a, b) * percent


def ioa(a: Box, b: Box, eps: float = 1e-7) -> Column:
    """Intersection over the second box's area."""
    return intersection(a, b) / (b.area + F.lit(eps))


def wh_iou(w1: Column, h1: Column, w2: Column, h2: Column, eps: float = 1e-7) -> Column:
    """IoU of two sizes with one centre."""
    inter = F.least(w1, w2) * F.least(h1, h2)
    return inter / (w1 * h1 + w2 * h2 - inter + F.lit(eps))


def generalised_iou(a: Box, b: Box, eps: float = 1e-7) -> dict[str, Column]:
    """IoU with eps, and its GIoU, DIoU and CIoU forms."""
    h1, h2 = a.height + F.lit(eps), b.height + F.lit(eps)
    inter = intersection(a, b)
    union = a.width * h1 + b.width * h2 - inter + F.lit(eps)
    plain = inter / union
    cw, ch = F.greatest(a.x2, b.x2) - F.least(a.x1, b.x1), F.greatest(a.y2, b.y2) - F.least(a.y1, b.y1)
    hull = cw * ch + F.lit(eps)
    diagonal = cw * cw + ch * ch + F.lit(eps)
    dx, dy = b.x1 + b.x2 - a.x1 - a.x2, b.y1 + b.y2 - a.y1 - a.y2
    apart = (dx * dx + dy * dy) / F.lit(4.0)
    v = F.lit(4 / math.pi**2) * F.pow(F.atan(b.width / h2) - F.atan(a.width / h1), 2)
    alpha = v / (v - plain + F.lit(1 + eps))
    return {"iou": plain, "giou": plain - (hull - union) / hull, "diou": plain - apart / diagonal, "ciou": plain - (apart / diagonal + v * alpha)}


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot((x1 - x2).cast("double"), (y1 - y2).cast("double"))


def squared(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def point_to_box(px: Column, py: Column, box: Box) -> Column:
    """Distance from a point to a box; 0 inside."""
    dx = F.greatest(box.x1 - px, F.lit(0), px - box.x2)
    dy = F.greatest(box.y1 - py, F.lit(0), py - box.y2)
    return F.hypot(dx.cast("double"), dy.cast("double"))


def angle_degrees(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.degrees(F.atan2((y2 - y1).cast("double"), (x2 - x1).cast("double")))


def is_axis_parallel(angle: Column, tolerance: float) -> Column:
    """Within tolerance of 0, 90 or 180 degrees, either way."""
    a = F.abs(angle)
    return (a <= tolerance) | (F.abs(a - 90) <= tolerance) | (F.abs(a - 180) <= tolerance)


def expanded(box: Box, by: int) -> Box:
    """Grown on all sides; the top left corner stays at 0 or more."""
    return Box(F.greatest(F.lit(0), box.x1 - by), F.greatest(F.lit(0), box.y1 - by), box.x2 + by, box.y2 + by)


def crop(box: Box, width: int, height: int, gain: float = 1.02, pad: int = 10, square: bool = False) -> Box:
    """The box scaled and padded about its centre, truncated and clipped to an image."""
    w, h = box.width.cast("double"), box.height.cast("double")
    if square:
        w = h = F.greatest(w, h)
    w, h = w * F.lit(gain) + pad, h * F.lit(gain) + pad
    clip = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(top))).cast("int")
    return Box(clip(box.cx - w / 2, width), clip(box.cy - h / 2, height), clip(box.cx + w / 2, width), clip(box.cy + h / 2, height))


def letterbox(width: Column, height: Column, target: int = 640) -> dict[str, Column]:
    """Gain, and padding at the left and the top, of an image fitted into a square."""
    gain = F.least(F.lit(float(target)) / height, F.lit(float(target)) / width)
    return {"gain": gain, "pad_x": (F.lit(float(target)) - F.round(width * gain)) / 2, "pad_y": (F.lit(float(target)) - F.round(height * gain)) / 2}


def normalised_xywh(box: Box, width: int, height: int) -> dict[str, Column]:
    """Centre and size as shares of the image."""
    return {"x": box.cx / width, "y": box.cy / height, "w": box.width / F.lit(float(width)), "h": box.height / F.lit(float(height))}


def line_type(length: Column, points: Column) -> Column:
    """A path's kind by its length in pixels."""
    return F.when(points < 2, "unknown").when(length < 40, "signal").when(length < 100, "instrument").otherwise("main_process")

"""Box algebra as column expressions. A box is four columns (left, top, right, bottom), y down, half-open by use."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# The overlap shares and slacks that results depend on.
CELL_TEXT_OVERLAP, OCR_TEXT_OVERLAP = 0.8, 0.6
CHUNK_TEXT_OVERLAP, CHUNK_IMAGE_OVERLAP = 0.7, 0.9
IOU_THRESHOLD, CONTAINMENT_SHARE, CONTAINMENT_SLACK = 0.8, 0.9, 2
BAND_OVERLAP = 2


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "", names: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> Box:
    """The columns ``prefix + name``; a prefix with a dot reads a struct or an alias."""
    return Box(*(F.col(prefix + n) for n in names))


def box_of(c: Column) -> Box:
    return Box(c["x1"], c["y1"], c["x2"], c["y2"])


def idiv(a: Column, b: Column | int) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def half_even(c: Column) -> Column:
    return F.bround(c.cast("double"), 0).cast("int")


def half_up(c: Column) -> Column:
    """For coordinates that aren't negative."""
    return (c + F.lit(0.5)).cast("int")


def width(b: Box) -> Column:
    return b.x2 - b.x1


def height(b: Box) -> Column:
    return b.y2 - b.y1


def area(b: Box) -> Column:
    return width(b).cast("long") * height(b)


def x_overlap(a: Box, b: Box) -> Column:
    return F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)


def y_overlap(a: Box, b: Box) -> Column:
    return F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)


def intersection(a: Box, b: Box) -> Column:
    return F.greatest(x_overlap(a, b), F.lit(0)).cast("long") * F.greatest(y_overlap(a, b), F.lit(0))


def overlaps(a: Box, b: Box) -> Column:
    return (x_overlap(a, b) > 0) & (y_overlap(a, b) > 0)


def share_inside(inner: Box, outer: Box, share: float) -> Column:
    """The part of ``inner`` in ``outer`` reaches ``share``; without division, so an empty box counts as inside."""
    return intersection(inner, outer) >= F.lit(share) * area(inner)


def text_inside(text: Box, cell: Box, share: float = CELL_TEXT_OVERLAP) -> Column:
    """A text box belongs to a cell: they meet, and it lies in it wholly or by ``share`` of its area."""
    meet = (x_overlap(text, cell) > 0) & (y_overlap(text, cell) > 0)
    return meet & (contains(cell, text) | (intersection(text, cell) >= F.lit(share) * area(text)))


def contains(outer: Box, inner: Box, slack: int = 0) -> Column:
    return (outer.x1 <= inner.x1 + slack) & (outer.y1 <= inner.y1 + slack) & (outer.x2 >= inner.x2 - slack) & (outer.y2 >= inner.y2 - slack)


def contained(inner: Box, outer: Box, slack: int = CONTAINMENT_SLACK, share: float = CONTAINMENT_SHARE) -> Column:
    """Inside within ``slack`` on every side, else by ``share`` of its (positive) area."""
    return contains(outer, inner, slack) | ((area(inner) > 0) & (intersection(inner, outer) >= F.lit(share) * area(inner)))


def iou_over(a: Box, b: Box, threshold: float = IOU_THRESHOLD) -> Column:
    """Intersection over union is above the threshold (strictly); an empty union never is."""
    both = intersection(a, b)
    return both.cast("double") > F.lit(threshold) * (area(a) + area(b) - both)


def centre_distance_squared(a: Box, b: Box) -> Column:
    """Of the doubled centres, so that it stays an integer; divide by four for pixels."""
    dx, dy = (a.x1 + a.x2 - b.x1 - b.x2).cast("long"), (a.y1 + a.y2 - b.y1 - b.y2).cast("long")
    return dx * dx + dy * dy


def same_band(a: Box, b: Box, more_than: int = BAND_OVERLAP) -> Column:
    return y_overlap(a, b) > more_than


def in_line(top: Column, bottom: Column, current: Column, gap: int) -> Column:
    """A box's top lies in a line's band, or at most ``gap`` below it."""
    return (current >= top) & (current <= bottom + gap)


def point_in(x: Column, y: Column, b: Box, dx: int = 4, dy: int = 2) -> Column:
    return (x >= b.x1 - dx) & (x <= b.x2 + dx) & (y >= b.y1 - dy) & (y <= b.y2 + dy)


def apart(left: Box, right: Box, least: int = 5) -> Column:
    return F.abs(right.x1 - left.x2) >= least


def grown(b: Box, by: int = 0, wide: int | None = None, high: int | None = None) -> Box:
    w, h = (by if wide is None else wide), (by if high is None else high)
    return Box(b.x1 - w, b.y1 - h, b.x2 + w, b.y2 + h)


def line_angle(b: Box) -> Column:
    return F.degrees(F.atan2((b.y2 - b.y1).cast("double"), (b.x2 - b.x1).cast("double")))


def line_length(b: Box) -> Column:
    return F.hypot((b.x2 - b.x1).cast("double"), (b.y2 - b.y1).cast("double"))


def is_horizontal(b: Box) -> Column:
    return (b.y1 == b.y2) & (b.x1 != b.x2)


def is_vertical(b: Box) -> Column:
    return (b.x1 == b.x2) & (b.y1 != b.y2)


def snapped(b: Box, degrees: int = 5) -> Box:
    """A line in order of its coordinates, made level or upright if within ``degrees`` of it."""
    x1, x2, y1, y2 = F.least(b.x1, b.x2), F.greatest(b.x1, b.x2), F.least(b.y1, b.y2), F.greatest(b.y1, b.y2)
    angle = F.degrees(F.atan2((y2 - y1).cast("double"), (x2 - x1).cast("double")))
    my, mx = half_even((y1 + y2) / 2), half_even((x1 + x2) / 2)
    flat, tall = angle <= degrees, angle >= 90 - degrees
    return Box(F.when(tall, mx).otherwise(x1), F.when(flat, my).otherwise(y1), F.when(tall, mx).otherwise(x2), F.when(flat, my).otherwise(y2))


def to_pixels(left: Column, bottom: Column, right: Column, top: Column, page_height: Column, dpi: float) -> Box:
    """Points with the origin at the bottom left to pixels with the origin at the top left."""
    ratio = F.lit(dpi / 72)
    return Box(half_even(left * ratio), half_even((page_height - top) * ratio), half_even(right * ratio), half_even((page_height - bottom) * ratio))


def padded_detection(b: Box, label: Column) -> Box:
    """A detector's box with its margin on the right and bottom: tables 12, others 8."""
    by = F.when(F.lower(label) == "table", F.lit(12)).otherwise(F.lit(8))
    return Box(b.x1, b.y1, b.x2 + by, b.y2 + by)


def clip_window(b: Box, page_width: Column | int, page_height: Column | int, extra: int = 4) -> Box:
    """A crop: floor of left and top, ceiling of right (with ``extra``) and bottom, inside the page."""
    w, h = (F.lit(v) if isinstance(v, int) else v for v in (page_width, page_height))
    keep = lambda c, most: F.least(F.greatest(c.cast("int"), F.lit(0)), most)
    return Box(keep(F.floor(b.x1), w), keep(F.floor(b.y1), h), keep(F.ceil(b.x2 + extra), w), keep(F.ceil(b.y2), h))

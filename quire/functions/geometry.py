"""Boxes and angles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamp01, fixed

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """x, y, w and h of a row."""
    return tuple(F.col(f"{prefix}{c}") for c in ("x", "y", "w", "h"))


def overlap(a: Box, b: Box) -> Column:
    """Shared area."""
    across = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    down = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    return across * down


def intersects(a: Box, b: Box) -> Column:
    return (a[0] < b[0] + b[2]) & (a[0] + a[2] > b[0]) & (a[1] < b[1] + b[3]) & (a[1] + a[3] > b[1])


def covered(word: Box, region: Box) -> Column:
    """Share of the word that the region covers."""
    return overlap(word, region) / F.greatest(F.lit(1.0), word[2] * word[3])


def holds_centre(word: Box, region: Box) -> Column:
    x, y = word[0] + word[2] / 2, word[1] + word[3] / 2
    return (x >= region[0]) & (x <= region[0] + region[2]) & (y >= region[1]) & (y <= region[1] + region[3])


def iou(a: Box, b: Box) -> Column:
    shared = overlap(a, b)
    return F.when(shared > 0, shared / (a[2] * a[3] + b[2] * b[3] - shared)).otherwise(F.lit(0.0))


def position_score(a: Box, b: Box) -> Column:
    """The larger of the overlap's share and 0.7 of the closeness of centres."""
    far = F.hypot(a[0] + a[2] / 2 - b[0] - b[2] / 2, a[1] + a[3] / 2 - b[1] - b[3] / 2)
    return F.greatest(iou(a, b), 0.7 * clamp01(1 - far / (2.5 * F.greatest(a[2], a[3], b[2], b[3], F.lit(1.0)))))


def rotation(dx: Column, dy: Column) -> Column:
    """Angle of an edge in (-180, 180], snapped to right angles within 3 degrees."""
    angle = F.degrees(F.atan2(dy, dx))
    angle = F.when(angle <= -180, angle + 360).otherwise(angle)
    snapped = fixed(angle, 2)
    for right in (0, 90, -90, 180, -180):
        snapped = F.when(F.abs(angle - right) <= 3, F.lit(180.0 if right == -180 else float(right))).otherwise(snapped)
    return F.when(F.hypot(dx, dy) < 0.01, F.lit(0.0)).otherwise(snapped)


def css_box(b: Box, angle: Column) -> Box:
    """Where a word that takes up b is placed, so that turning it by a right angle about its top left corner lays it over b."""
    side, half = F.abs(angle) == 90, F.abs(angle) == 180
    left = F.when((angle == 90) | half, b[0] + b[2]).otherwise(b[0])
    top = F.when((angle == -90) | half, b[1] + b[3]).otherwise(b[1])
    return left, top, F.when(side, b[3]).otherwise(b[2]), F.when(side, b[2]).otherwise(b[3])


def visual_box(b: Box, angle: Column) -> Box:
    """What a word placed at b takes up once it is turned about its top left corner; css_box() the other way round."""
    side, half = F.abs(angle) == 90, F.abs(angle) == 180
    x = F.when(angle == 90, b[0] - b[3]).when(half, b[0] - b[2]).otherwise(b[0])
    y = F.when(angle == -90, b[1] - b[2]).when(half, b[1] - b[3]).otherwise(b[1])
    return x, y, F.when(side, b[3]).otherwise(b[2]), F.when(side, b[2]).otherwise(b[3])


def clamped(b: Box, width: Column, height: Column, least: float = 4.0) -> Box:
    """The box moved and shrunk into a page."""
    w = F.least(F.greatest(b[2], F.lit(least)), width)
    h = F.least(F.greatest(b[3], F.lit(least)), height)
    return F.least(F.greatest(b[0], F.lit(0.0)), width - w), F.least(F.greatest(b[1], F.lit(0.0)), height - h), w, h


def crop(b: Box, width: Column, height: Column) -> Box:
    """Whole pixels of an image that the box takes up, at least one."""
    left = F.least(F.greatest(F.floor(b[0]), F.lit(0)), F.greatest(width - 1, F.lit(0)))
    top = F.least(F.greatest(F.floor(b[1]), F.lit(0)), F.greatest(height - 1, F.lit(0)))
    right = F.least(F.greatest(F.ceil(b[0] + b[2]), left + 1), F.greatest(width, F.lit(1)))
    bottom = F.least(F.greatest(F.ceil(b[1] + b[3]), top + 1), F.greatest(height, F.lit(1)))
    return left, top, right - left, bottom - top


def scale_for(dpi: Column, most: float = 150.0) -> Column:
    return F.least(F.lit(200.0), F.lit(most), F.greatest(F.lit(72.0), dpi)) / 72


def quad_box(quad: Column, scale: float, offset_x: float = 0.0, offset_y: float = 0.0) -> Box:
    """The box around four corners (array x, y, x, y, ...), scaled and moved; at least 0.1 wide and high."""
    xs, ys = (F.transform(F.sequence(F.lit(first), F.lit(first + 6), F.lit(2)), lambda i: F.element_at(quad, i)) for first in (1, 2))
    least = F.lit(0.1)
    return F.array_min(xs) * scale + offset_x, F.array_min(ys) * scale + offset_y, F.greatest(least, (F.array_max(xs) - F.array_min(xs)) * scale), F.greatest(least, (F.array_max(ys) - F.array_min(ys)) * scale)

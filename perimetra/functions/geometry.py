"""Plane geometry and angles as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Twice the signed area of a, b, p: positive left of the way from a to b."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def straddle(one: Column, other: Column, eps: float = EPSILON) -> Column:
    """Strictly on different sides."""
    return ((one > eps) & (other < -eps)) | ((one < -eps) & (other > eps))


#: An eighth of a turn and three eighths, each with what is missing in its last place.
EIGHTH, THREE_EIGHTHS = (math.pi / 4, 3.061616997868383e-17), (3 * math.pi / 4, 9.184850993605148e-17)


def angle(vx: Column, vy: Column) -> Column:
    """Radians in [-pi, pi]. By the diagonals, where headings change their names and libraries differ in the last place, it is
    the diagonal's angle and the small one from there, rounded once."""
    off = (F.abs(vy) - F.abs(vx)) / F.nullif(F.abs(vy) + F.abs(vx), F.lit(0.0))
    size = F.when(vx > 0, EIGHTH[0] + (EIGHTH[1] + off)).otherwise(THREE_EIGHTHS[0] + (THREE_EIGHTHS[1] - off))
    return F.when(F.abs(off) < 1e-8, F.when(vy > 0, size).otherwise(-size)).otherwise(F.atan2(vy, vx))


def heading(vx: Column, vy: Column) -> Column:
    """Degrees in [0, 360). Every angle is taken a turn ahead first, so that all are cut to the same places."""
    return (F.degrees(angle(vx, vy)) + 360.0) % 360.0


def angle_between(a: Column, b: Column) -> Column:
    """Smallest difference in degrees."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def flow_label(degrees: Column) -> Column:
    """Left to right, top to bottom, right to left or bottom to top, by quarter turns around the axes."""
    return F.when((degrees < 45) | (degrees >= 315), "ltr").when(degrees < 135, "ttb").when(degrees < 225, "rtl").otherwise("btt")


def compass(degrees: Column) -> Column:
    """Eight-way compass name of a bearing."""
    names = F.array(*[F.lit(n) for n in ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")])
    return names[F.pmod(F.floor((degrees + 22.5) / 45.0), F.lit(8)).cast("int")]


def area(box: tuple[Column, Column, Column, Column]) -> Column:
    x1, y1, x2, y2 = box
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def _common(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 for empty boxes."""
    common = _common(a, b)
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def ioa(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Share of the first box that the second covers."""
    return F.when(area(a) > 0, _common(a, b) / area(a)).otherwise(0.0)


def to_normalised(box: tuple[Column, ...], width: Column, height: Column) -> tuple[Column, Column, Column, Column, Column]:
    """cx, cy, w, h as shares of the frame, after clipping to it, and whether the box is usable (not degenerate)."""
    x1, x2 = (F.greatest(F.lit(0.0), F.least(v, width)) for v in (box[0], box[2]))
    y1, y2 = (F.greatest(F.lit(0.0), F.least(v, height)) for v in (box[1], box[3]))
    w, h = (x2 - x1) / width, (y2 - y1) / height
    return (x1 + x2) / 2 / width, (y1 + y2) / 2 / height, w, h, (w > 0.0005) & (h > 0.0005) & ((x2 - x1) * (y2 - y1) >= 16)


# Side of the detector's square input, width of the frames that motion is measured on, least height of those.
DETECTOR_SIDE, WORKING_WIDTH, LEAST_HEIGHT = 640, 640, 8


def letterbox(width: Column, height: Column, side: int = DETECTOR_SIDE) -> tuple[Column, Column, Column]:
    """Scale, left and top of a frame that is fitted into a square and centred there, whole pixels of padding left and above."""
    scale = F.least(side / height, side / width)
    left, top = (F.bround((side - F.bround(length * scale)) / 2.0 - 0.1) for length in (width, height))
    return scale, left, top


def into_letterbox(box: tuple[Column, ...], width: Column, height: Column, side: int = DETECTOR_SIDE) -> tuple[Column, ...]:
    """A frame's box in the detector's square."""
    scale, left, top = letterbox(width, height, side)
    return tuple(v * scale + pad for v, pad in zip(box, (left, top, left, top), strict=True))


def out_of_letterbox(box: tuple[Column, ...], width: Column, height: Column, side: int = DETECTOR_SIDE) -> tuple[Column, ...]:
    """A box of the detector's square in the frame, clipped to it."""
    scale, left, top = letterbox(width, height, side)
    limits = (width, height, width, height)
    return tuple(F.least(F.greatest((v - pad) / scale, F.lit(0.0)), most.cast("double")) for v, pad, most in zip(box, (left, top, left, top), limits, strict=True))


def working_size(width: Column, height: Column, most: int = WORKING_WIDTH) -> tuple[Column, Column]:
    """Size at which motion is measured: frames wider than `most` are made as wide as that."""
    narrow = width <= most
    return F.when(narrow, width).otherwise(most), F.when(narrow, height).otherwise(F.greatest(F.lit(LEAST_HEIGHT), F.bround(height * most / width).cast("int")))


def at_working_scale(box: tuple[Column, ...], width: Column, height: Column, most: int = WORKING_WIDTH) -> tuple[Column, ...]:
    """A frame's box at the size at which motion is measured."""
    w, h = working_size(width, height, most)
    return tuple(v / by for v, by in zip(box, (width / w, height / h, width / w, height / h), strict=True))


def detector_px(height_share: Column, width: Column, height: Column, side: int = DETECTOR_SIDE) -> Column:
    """Height in the detector's square of a box whose height is a share of its frame's."""
    return height_share * height * side / F.greatest(width, height, F.lit(1))


def apply_homography(matrix: tuple[float, ...], u: Column, v: Column) -> tuple[Column, Column]:
    """World x and y of a pixel by a 3x3 matrix given row by row."""
    a, b, c, d, e, f, g, h, i = matrix
    w = u * g + v * h + i
    return (u * a + v * b + c) / w, (u * d + v * e + f) / w

"""Box geometry on columns.

Sides are inclusive pixels, so a box is ``right - left + 1`` wide.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("left", "top", "right", "bottom")


@dataclass(frozen=True)
class Box:
    """Four side columns that travel together."""

    left: Column
    top: Column
    right: Column
    bottom: Column

    @classmethod
    def of(cls, prefix: str = "", names: Sequence[str] = SIDES) -> "Box":
        return cls(*(F.col(prefix + n) for n in names))

    @classmethod
    def from_struct(cls, column: Column) -> "Box":
        return cls(*(column.getField(n) for n in SIDES))

    @classmethod
    def from_array(cls, column: Column) -> "Box":
        return cls(*(F.element_at(column, i) for i in (1, 2, 3, 4)))

    @property
    def sides(self) -> tuple[Column, Column, Column, Column]:
        return (self.left, self.top, self.right, self.bottom)

    @property
    def width(self) -> Column:
        return self.right - self.left + 1

    @property
    def height(self) -> Column:
        return self.bottom - self.top + 1

    @property
    def area(self) -> Column:
        return F.greatest(F.lit(0), self.width) * F.greatest(F.lit(0), self.height)

    def struct(self) -> Column:
        return F.struct(*(c.alias(n) for c, n in zip(self.sides, SIDES)))

    def array(self) -> Column:
        return F.array(*self.sides)

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for c, n in zip(self.sides, SIDES)]

    def intersection(self, other: "Box") -> "Box":
        return Box(
            F.greatest(self.left, other.left),
            F.greatest(self.top, other.top),
            F.least(self.right, other.right),
            F.least(self.bottom, other.bottom),
        )

    def envelope(self, other: "Box") -> "Box":
        return Box(
            F.least(self.left, other.left),
            F.least(self.top, other.top),
            F.greatest(self.right, other.right),
            F.greatest(self.bottom, other.bottom),
        )


def spans_meet(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return ((start_a <= start_b) & (start_b <= end_a)) | ((start_b <= start_a) & (start_a <= end_b))


def overlap_1d(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    shared = F.least(end_a, end_b) - F.greatest(start_a, start_b) + 1
    return F.when(spans_meet(start_a, end_a, start_b, end_b), shared).otherwise(F.lit(0))


def union_1d(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Covered length; for disjoint spans the sum of both lengths."""
    joint = F.greatest(end_a, end_b) - F.least(start_a, start_b) + 1
    return F.when(spans_meet(start_a, end_a, start_b, end_b), joint).otherwise(
        (end_a - start_a + 1) + (end_b - start_b + 1)
    )


def iou_1d(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    span = union_1d(start_a, end_a, start_b, end_b)
    shared = overlap_1d(start_a, end_a, start_b, end_b)
    return F.when(span > 0, shared.cast("double") / span.cast("double")).otherwise(F.lit(0.0))


def v_iou(a: Box, b: Box) -> Column:
    return iou_1d(a.top, a.bottom, b.top, b.bottom)


def h_iou(a: Box, b: Box) -> Column:
    return iou_1d(a.left, a.right, b.left, b.right)


def inter_area(a: Box, b: Box) -> Column:
    return a.intersection(b).area


def iou(a: Box, b: Box) -> Column:
    shared = inter_area(a, b)
    whole = a.area + b.area - shared
    return F.when(whole == 0, F.lit(0.0)).otherwise(shared.cast("double") / whole.cast("double"))


def covers_share(outer: Box, inner: Box, share: float) -> Column:
    """True when at least ``share`` of the inner box's area lies in the outer one."""
    return inter_area(outer, inner) >= F.lit(share) * inner.area


def box_minus(outer: Box, inner: Box) -> Box:
    """What is left of a box beside an inner box; each axis keeps the part before
    the inner box if there is one, else the part after it."""
    before_x, before_y = inner.left > outer.left, inner.top > outer.top

    def part(before: Column, outer_low: Column, outer_high: Column, low: Column, high: Column) -> tuple[Column, Column]:
        return F.when(before, outer_low).otherwise(high + 1), F.when(before, low - 1).otherwise(outer_high)

    left, right = part(before_x, outer.left, outer.right, inner.left, inner.right)
    top, bottom = part(before_y, outer.top, outer.bottom, inner.top, inner.bottom)
    return Box(left, top, right, bottom)


def pad_clip(box: Box, pad: int, width: Column, height: Column) -> Box:
    return Box(
        F.greatest(box.left - pad, F.lit(0)),
        F.greatest(box.top - pad, F.lit(0)),
        F.least(box.right + pad, width - 1),
        F.least(box.bottom + pad, height - 1),
    )


def downscale_factor(width: Column, height: Column, limit: int) -> Column:
    """The power of two by which a page is halved until its longer side is under
    ``limit``: the bit length of ``longer div limit`` says how many halvings."""
    ratio = F.floor(F.greatest(width, height) / F.lit(limit)).cast("bigint")
    halvings = F.when(ratio > 0, F.length(F.bin(ratio))).otherwise(F.lit(0))
    return F.pow(F.lit(2.0), halvings).cast("bigint")


def scale_box(box: Box, factor: Column) -> Box:
    return Box(*(side * factor for side in box.sides))


def valid_box(box: Box, strict: bool = False) -> Column:
    """Positive extent; ``strict`` asks for two whole pixels beyond the first."""
    gap = 1 if strict else 0
    return (box.right - box.left > gap) & (box.bottom - box.top > gap)


def min_area(box: Box, area: int) -> Column:
    return box.area >= area


def min_side(box: Box, side: int) -> Column:
    return F.least(box.width, box.height) >= side


def in_viewport(box: Box, width: Column, height: Column, mode: str = "inside") -> Column:
    """``inside``: all sides within the window. ``touching``: on each axis at least
    one side within, the window's far edge included."""
    ordered = (box.left < box.right) & (box.top < box.bottom)
    if mode == "inside":
        return (
            ordered
            & (box.left >= 0) & (box.left < width) & (box.right >= 0) & (box.right < width)
            & (box.top >= 0) & (box.top < height) & (box.bottom >= 0) & (box.bottom < height)
        )
    if mode == "touching":
        across = box.left.between(F.lit(0), width) | box.right.between(F.lit(0), width)
        down = box.top.between(F.lit(0), height) | box.bottom.between(F.lit(0), height)
        return ordered & across & down
    raise ValueError(f"unknown viewport mode: {mode}")


def warp_box(box: Box, matrix: Sequence[Sequence[float]], width: Column, height: Column) -> Box:
    """Envelope of the four corners under a homography, clipped to the page and
    cut to whole pixels."""

    def project(x: Column, y: Column) -> tuple[Column, Column]:
        u, v, w = (F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) for r in matrix)
        return u / w, v / w

    corners = [project(x, y) for x in (box.left, box.right) for y in (box.top, box.bottom)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    zero = F.lit(0.0)
    return Box(
        F.greatest(F.least(*xs), zero).cast("bigint"),
        F.greatest(F.least(*ys), zero).cast("bigint"),
        F.least(F.greatest(*xs), (width - 1).cast("double")).cast("bigint"),
        F.least(F.greatest(*ys), (height - 1).cast("double")).cast("bigint"),
    )


def pyramid_side(value: Column, depth: int) -> Column:
    """Smallest side from ``value`` up that can be halved ``depth - 1`` times and
    still be more than one pixel."""
    step = 2 ** (depth - 1)
    return F.greatest(F.ceil(value / F.lit(step)) * F.lit(step), F.lit(2 * step)).cast("bigint")


def needs_split(width: Column, height: Column, max_height: int | str = "*", max_width: int | str = 150,
                ratio: float | str = 8) -> Column:
    """A word is cut in windows when it is too large and too wide for its height; one
    without height is not cut."""
    too_high = F.lit(False) if max_height == "*" else height > max_height
    too_wide = F.lit(False) if max_width == "*" else width > max_width
    slender = F.lit(False) if ratio == "*" else F.coalesce(F.try_divide(width.cast("double"), height.cast("double")) >= ratio, F.lit(False))
    return (too_high | too_wide) & slender


RESIZE_METHODS = ("without_ar", "ar", "comb", "dynamic_w", "ar_clip_w", "rosetta_training", "rosetta_inference")


def resize_plan(height: Column, width: Column, method: str, target: tuple[int, int] = (48, 150)) -> Column:
    """Size an image gets when fitted in ``target`` (height, width), with the padding
    added right and below. Returns struct(height, width, pad_right, pad_bottom)."""
    if method not in RESIZE_METHODS:
        raise ValueError(f"unknown resize method: {method}")
    th, tw = target

    def whole(value: Column) -> Column:
        return F.greatest(value.cast("bigint"), F.lit(1))

    def by_height(h: Column, w: Column) -> Column:
        return whole(F.lit(float(th)) / h * w)

    def by_width(h: Column, w: Column) -> Column:
        return whole(F.lit(float(tw)) / w * h)

    def grown(h: Column, w: Column) -> tuple[Column, Column]:
        small = (h < th) & (w < tw)
        tall = (h / F.lit(float(th))) > (w / F.lit(float(tw)))
        new_h = F.when(small, F.when(tall, F.lit(th)).otherwise(F.least(by_width(h, w), F.lit(th)))).otherwise(h)
        new_w = F.when(small, F.when(tall, F.least(by_height(h, w), F.lit(tw))).otherwise(F.lit(tw))).otherwise(w)
        return new_h, new_w

    fixed = (height == th) & (width == tw)
    if method == "without_ar":
        h, w = F.lit(th), F.lit(tw)
    elif method == "ar":
        h1 = F.when(height > th, F.lit(th)).otherwise(height)
        w1 = F.when(height > th, by_height(height, width)).otherwise(width)
        h2 = F.when(w1 > tw, by_width(h1, w1)).otherwise(h1)
        w2 = F.when(w1 > tw, F.lit(tw)).otherwise(w1)
        h, w = grown(h2, w2)
    elif method == "comb":
        h1, w1 = grown(height, width)
        over = (h1 > th) | (w1 > tw)
        h, w = F.when(over, F.lit(th)).otherwise(h1), F.when(over, F.lit(tw)).otherwise(w1)
    elif method in ("dynamic_w", "rosetta_inference"):
        h, w = F.lit(th), by_height(height, width)
    elif method == "ar_clip_w":
        h = F.when(height > th, F.lit(th)).otherwise(height)
        w = F.least(F.when(height > th, by_height(height, width)).otherwise(width), F.lit(tw))
    else:  # rosetta_training
        over = (height > th) | (width > tw)
        h, w = F.when(over, F.lit(th)).otherwise(height), F.when(over, F.lit(tw)).otherwise(width)

    h = F.when(fixed, height).otherwise(h).cast("bigint")
    w = F.when(fixed, width).otherwise(w).cast("bigint")
    if method == "dynamic_w":
        pad_right, pad_bottom = F.lit(0), F.lit(0)
    else:
        padded = ~fixed & ((h < th) | (w < tw))
        pad_right = F.when(padded, F.lit(tw) - w).otherwise(F.lit(0))
        pad_bottom = F.when(padded, F.lit(th) - h).otherwise(F.lit(0))
    return F.struct(h.alias("height"), w.alias("width"), pad_right.cast("bigint").alias("pad_right"),
                    pad_bottom.cast("bigint").alias("pad_bottom"))

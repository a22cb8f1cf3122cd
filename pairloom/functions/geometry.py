"""Box geometry. A box is four columns or a struct with fields x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def area_ratio(w: Column, h: Column, width: Column, height: Column) -> Column:
    """Share of the image a box covers; 0 for a missing or degenerate image."""
    ok = (width > 0) & (height > 0) & w.isNotNull() & h.isNotNull()
    return F.when(ok, F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)) / (width * height)).otherwise(F.lit(0.0))


def center_x(box: Column) -> Column:
    return box["x"] + box["w"] / 2.0


def center_y(box: Column) -> Column:
    return box["y"] + box["h"] / 2.0


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 when both boxes are degenerate."""

    def overlap(lo: str, extent: str) -> Column:
        far = F.least(a[lo] + F.greatest(a[extent], F.lit(0.0)), b[lo] + F.greatest(b[extent], F.lit(0.0)))
        return F.greatest(far - F.greatest(a[lo], b[lo]), F.lit(0.0))

    def area(box: Column) -> Column:
        return F.greatest(box["w"], F.lit(0.0)) * F.greatest(box["h"], F.lit(0.0))

    shared = overlap("x", "w") * overlap("y", "h")
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def norm_dx(a: Column, b: Column) -> Column:
    """Horizontal offset of b from a in mean widths; positive when a is left of b."""
    return (center_x(b) - center_x(a)) / F.greatest((a["w"] + b["w"]) / 2.0, F.lit(1e-6))


def norm_dy(a: Column, b: Column) -> Column:
    """Vertical offset of b from a in mean heights; positive when a is above b."""
    return (center_y(b) - center_y(a)) / F.greatest((a["h"] + b["h"]) / 2.0, F.lit(1e-6))


def relation_of_offsets(overlap: Column, ox: Column, oy: Column, dx: float = 0.75, dy: float = 1.0, max_iou: float = 0.1) -> Column:
    """Relation from the overlap and the offsets in mean box sizes.

    ``dx`` is the least offset along an axis, ``dy`` the largest across it, whichever axis that is.
    """
    return (
        F.when(overlap > max_iou, F.lit(None).cast("string"))
        .when((F.abs(ox) >= dx) & (F.abs(oy) <= dy), F.when(ox > 0, "left of").otherwise("right of"))
        .when((F.abs(oy) >= dx) & (F.abs(ox) <= dy), F.when(oy > 0, "above").otherwise("below"))
    )


def _deltas(a: Column, b: Column) -> tuple[Column, Column]:
    return center_x(a) - center_x(b), center_y(a) - center_y(b)


def relation_by_image_share(a: Column, b: Column, width: Column, height: Column) -> Column:
    """Dominant axis of at least a tenth of the image, boxes overlapping at most 0.20."""
    dx, dy = _deltas(a, b)
    need_x, need_y = F.greatest(width * 0.10, F.lit(1.0)), F.greatest(height * 0.10, F.lit(1.0))
    return (
        F.when(iou(a, b) > 0.20, F.lit(None).cast("string"))
        .when((F.abs(dx) >= F.abs(dy)) & (F.abs(dx) >= need_x), F.when(dx < 0, "left of").otherwise("right of"))
        .when((F.abs(dy) > F.abs(dx)) & (F.abs(dy) >= need_y), F.when(dy < 0, "above").otherwise("below"))
    )


def relation_high_confidence(a: Column, b: Column, width: Column, height: Column) -> Column:
    """A quarter of the image along one axis and twice the other one; else a skip reason ``~reason``."""
    dx, dy = _deltas(a, b)
    ax, ay = F.abs(dx), F.abs(dy)
    return (
        F.when(iou(a, b) > 0.05, "~overlap")
        .when((ax > width * 0.25) & (ax > ay * 2.0), F.when(dx < 0, "left_of").otherwise("right_of"))
        .when((ay > height * 0.25) & (ay > ax * 2.0), F.when(dy < 0, "above").otherwise("below"))
        .when(ax >= ay, "~ambiguous_horizontal")
        .otherwise("~ambiguous_vertical")
    )


def relation_by_offset(a: Column, b: Column, min_offset: float = 35.0, ratio: float = 1.5) -> Column:
    """Pixel offset and axis ratio, no overlap test."""
    dx, dy = _deltas(a, b)
    return F.when((F.abs(dx) >= min_offset) & (F.abs(dx) >= F.abs(dy) * ratio), F.when(dx > 0, "right of").otherwise("left of")).when(
        (F.abs(dy) >= min_offset) & (F.abs(dy) >= F.abs(dx) * ratio), F.when(dy > 0, "below").otherwise("above")
    )


def relation_by_margin(a: Column, b: Column, width: Column, height: Column, axis: str, margin: float = 0.15, ratio: float = 1.5) -> Column:
    """Image-normalised centre margin along one axis; null when not clear."""
    dx, dy = _deltas(a, b)
    dx, dy = dx / width, dy / height
    if axis == "horizontal":
        clear = (F.abs(dx) > margin) & (F.abs(dx) > F.abs(dy) * ratio)
        return F.when(clear, F.when(dx > 0, "right of").otherwise("left of"))
    clear = (F.abs(dy) > margin) & (F.abs(dy) > F.abs(dx) * ratio)
    return F.when(clear, F.when(dy > 0, "below").otherwise("above"))


def match_score(a: Column, b: Column, area_a: Column, area_b: Column) -> Column:
    """Annotation-to-segment score: 10 IoU + centre inside + similarity of areas."""
    cx, cy = center_x(a), center_y(a)
    inside = cx.between(b["x"], b["x"] + b["w"]) & cy.between(b["y"], b["y"] + b["h"])
    gap = F.abs(area_b - area_a) / F.greatest(area_a, area_b)
    similar = F.when((area_a > 0) & (area_b > 0), F.greatest(F.lit(0.0), 1.0 - gap)).otherwise(F.lit(0.0))
    return iou(a, b) * 10.0 + F.when(inside, 1.0).otherwise(0.0) + similar


def color_of(r: Column, g: Column, b: Column) -> Column:
    """Colour token of a mean RGB value; null when none is clear.

    Fixed values: the thresholds below decide which token a colour gets.
    """
    light = (r + g + b) / 3.0
    warm = (r > 150) & (g > 110) & (b < 120)
    return (
        F.when(light < 45, "black")
        .when((light > 225) & (F.greatest(r, g, b) - F.least(r, g, b) < 25), "white")
        .when(warm & (r > 185) & (g > 170), "yellow")
        .when(warm & (r > 165) & (g < 150), "orange")
        .when(warm, "brown")
        .when((r > 120) & (g > 70) & (b < 90) & (light < 170), "brown")
        .when((r > g + 35) & (r > b + 35), "red")
        .when((g > r + 25) & (g > b + 25), "green")
        .when((b > r + 25) & (b > g + 25), "blue")
        .when((r > 170) & (g > 150) & (b < 110), "yellow")
        .when((r > 175) & (g > 95) & (b < 90), "orange")
        .when(light < 95, "brown")
    )


def segment_to_rgb(segment: Column) -> Column:
    return F.struct((segment % 256).alias("r"), (F.floor(segment / 256) % 256).alias("g"), (F.floor(segment / 65536) % 256).alias("b"))


def rgb_to_segment(r: Column, g: Column, b: Column) -> Column:
    return r + g * 256 + b * 65536

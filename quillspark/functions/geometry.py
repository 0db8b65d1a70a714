"""Column functions on boxes; a box is a struct with x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Corners put in order, so that an inverted box keeps its width."""
    return F.struct(F.least(x1, x2).alias("x1"), F.least(y1, y2).alias("y1"), F.greatest(x1, x2).alias("x2"), F.greatest(y1, y2).alias("y2"))


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def common(a: Column, b: Column) -> Column:
    """The area that two boxes share."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    i = common(a, b)
    return i / F.greatest(area(a) + area(b) - i, F.lit(1))


def contains(outer: Column, inner: Column) -> Column:
    return (outer["x1"] <= inner["x1"]) & (outer["y1"] <= inner["y1"]) & (outer["x2"] >= inner["x2"]) & (outer["y2"] >= inner["y2"])


def center(b: Column) -> tuple[Column, Column]:
    return (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2


def distance(a: Column, b: Column, width: Column, height: Column) -> Column:
    """Between centres, in shares of the page."""
    (ax, ay), (bx, by) = center(a), center(b)
    return F.sqrt(F.pow((ax - bx) / width, F.lit(2)) + F.pow((ay - by) / height, F.lit(2)))


def expand(b: Column, pad: Column, width: Column, height: Column) -> Column:
    return F.struct(F.greatest(b["x1"] - pad, F.lit(0)).alias("x1"), F.greatest(b["y1"] - pad, F.lit(0)).alias("y1"), F.least(b["x2"] + pad, width).alias("x2"), F.least(b["y2"] + pad, height).alias("y2"))


def coco(b: Column) -> Column:
    return F.struct(b["x1"].alias("x"), b["y1"].alias("y"), (b["x2"] - b["x1"]).alias("w"), (b["y2"] - b["y1"]).alias("h"))


def to_pixels(b: Column, width: Column, height: Column, pad: float = 0.006) -> Column:
    """A normalised box in pixels, padded and clamped to the page."""
    return F.struct(
        F.greatest(F.floor((b["x1"] - pad) * width), F.lit(0)).alias("x1"),
        F.greatest(F.floor((b["y1"] - pad) * height), F.lit(0)).alias("y1"),
        F.least(F.floor((b["x2"] + pad) * width), width).alias("x2"),
        F.least(F.floor((b["y2"] + pad) * height), height).alias("y2"),
    )


def clip(b: Column, width: Column, height: Column) -> Column:
    """A box within its page, at least one pixel wide and high."""
    x1, y1 = F.greatest(F.lit(0), F.least(width - 1, b["x1"])), F.greatest(F.lit(0), F.least(height - 1, b["y1"]))
    return box(x1, y1, F.greatest(x1 + 1, F.least(width, b["x2"])), F.greatest(y1 + 1, F.least(height, b["y2"])))


def padded(b: Column, x: Column, above: Column, below: Column, width: Column, height: Column) -> Column:
    """A box with room at both sides, above and below, within its page."""
    return box(F.greatest(F.lit(0), b["x1"] - x), F.greatest(F.lit(0), b["y1"] - above), F.least(width, b["x2"] + x), F.least(height, b["y2"] + below))


def from_local(local: Column, search: Column, width: Column, height: Column) -> Column:
    """A box found inside a search box, on the page."""
    return clip(box(*(search[f"{c[0]}1"] + local[c].cast("int") for c in ("x1", "y1", "x2", "y2"))), width, height)


def quality(edge_var: Column, contrast: Column) -> Column:
    """A page's sharpness and contrast, half each, 100 at most; without metrics 50."""
    return F.when(edge_var.isNull() | contrast.isNull(), 50.0).otherwise(F.least(F.lit(100.0), edge_var / 100 * 50 + contrast / 128 * 50))


def is_ticked(ink: Column, pixels: Column) -> Column:
    """A box with over 5 % of ink; one without pixels is not ticked."""
    return F.coalesce(F.when(pixels > 0, ink / pixels).otherwise(0.0) > 0.05, F.lit(False))

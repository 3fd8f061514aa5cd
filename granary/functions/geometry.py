"""Boxes, letterboxes, severity: arithmetic over columns. A box is a struct x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the affected share of each severity.
SEVERITY = ((0.03, "LOW"), (0.10, "MODERATE"), (0.18, "HIGH"))
WORST = "CRITICAL"


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def area(b: Column) -> Column:
    """0 for a box turned inside out."""
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if the union is empty."""
    wide = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    high = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    union = area(a) + area(b) - wide * high
    return F.when(union > 0, wide * high / union).otherwise(0.0)


def letterbox(width: Column, height: Column, size: int = 640) -> Column:
    """Struct scale, new_w, new_h, pad_x, pad_y, left, top of a picture fitted into a square; halves round to even."""
    scale = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    new_w, new_h = F.rint(width * scale), F.rint(height * scale)
    pad_x, pad_y = (size - new_w) / 2, (size - new_h) / 2
    return F.struct(
        scale.alias("scale"), new_w.cast("int").alias("new_w"), new_h.cast("int").alias("new_h"), pad_x.alias("pad_x"), pad_y.alias("pad_y"),
        F.rint(pad_x - 0.1).cast("int").alias("left"), F.rint(pad_y - 0.1).cast("int").alias("top"),
    )


def unletterbox(b: Column, scale: Column, pad_x: Column, pad_y: Column, width: Column, height: Column) -> Column:
    """A box of the square back in the picture, clipped to it."""

    def within(x: Column, most: Column) -> Column:
        return F.least(F.greatest(x, F.lit(0.0)), most.cast("double"))

    return box(
        within((b["x1"] - pad_x) / scale, width), within((b["y1"] - pad_y) / scale, height),
        within((b["x2"] - pad_x) / scale, width), within((b["y2"] - pad_y) / scale, height),
    )


def severity(ratio: Column) -> Column:
    """Band of an affected share; bounds belong to the band above. Null stays null."""
    out = F.when(ratio.isNull(), F.lit(None).cast("string"))
    for bound, name in SEVERITY:
        out = out.when(ratio < bound, name)
    return out.otherwise(WORST)


def share(part: Column, whole: Column) -> Column:
    """part / whole, at most 1; 0 / 0 is 0."""
    return F.least(part / F.greatest(whole, F.lit(1)), F.lit(1.0))


def sure_of(score: Column, threshold: float = 0.5) -> Column:
    """Confidence in the class that the score falls in."""
    return F.when(score > threshold, score).otherwise(1 - score)


def uncertain(score: Column, threshold: float = 0.5, margin: float = 0.10) -> Column:
    return F.abs(score - threshold) < margin

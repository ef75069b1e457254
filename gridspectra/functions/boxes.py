"""Column functions over boxes (x1, y1, x2, y2), far sides excluded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-7
Box = tuple[Column, Column, Column, Column]


def columns(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{n}").cast("double") for n in ("x1", "y1", "x2", "y2"))  # type: ignore[return-value]


def from_center(x: Column, y: Column, w: Column, h: Column) -> Box:
    return x - w / 2, y - h / 2, x + w / 2, y + h / 2


def from_corner(x: Column, y: Column, w: Column, h: Column) -> Box:
    """Corner and size to whole sides, halves to even."""
    return tuple(F.bround(v).cast("int") for v in (x, y, x + w, y + h))  # type: ignore[return-value]


def iou(a: Box, b: Box, kind: str = "iou") -> Column:
    """Overlap over union; kind giou, diou or ciou adds its penalty. EPS stands in both heights and in the union."""
    wide = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    tall = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    w1, h1, w2, h2 = a[2] - a[0], a[3] - a[1] + EPS, b[2] - b[0], b[3] - b[1] + EPS
    inter = wide * tall
    union = w1 * h1 + w2 * h2 - inter + EPS
    plain = inter / union
    if kind == "iou":
        return plain
    cw, ch = F.greatest(a[2], b[2]) - F.least(a[0], b[0]), F.greatest(a[3], b[3]) - F.least(a[1], b[1])
    if kind == "giou":
        area = cw * ch + EPS
        return plain - (area - union) / area
    c2 = cw * cw + ch * ch + EPS
    dx, dy = b[0] + b[2] - a[0] - a[2], b[1] + b[3] - a[1] - a[3]
    rho2 = (dx * dx + dy * dy) / 4
    if kind == "diou":
        return plain - rho2 / c2
    if kind != "ciou":
        raise ValueError(f"no such overlap: {kind}")
    turn = F.atan(w2 / h2) - F.atan(w1 / h1)
    v = 4 / (F.pi() * F.pi()) * turn * turn
    alpha = v / (v - plain + (1 + EPS))
    return plain - (rho2 / c2 + v * alpha)

"""Functions for SQL users: expressions that the planner inlines, and table functions for lateral joins."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_BOX = "ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double"
_TALL = "ay2 - ay1 + 1e-7d", "by2 - by1 + 1e-7d"
_INTER = "greatest(least(ax2, bx2) - greatest(ax1, bx1), 0d) * greatest(least(ay2, by2) - greatest(ay1, by1), 0d)"
_V = "v array<double>"

#: name: (parameters, result, expression); box_iou is boxes.iou, the others are their namesakes in vectors and names.
FUNCTIONS = {
    "box_iou": (_BOX, "double", f"{_INTER} / ((ax2 - ax1) * ({_TALL[0]}) + (bx2 - bx1) * ({_TALL[1]}) - {_INTER} + 1e-7d)"),
    "vector_dot": (f"{_V}, u array<double>", "double", "aggregate(zip_with(v, u, (x, y) -> x * y), 0d, (s, x) -> s + x)"),
    "vector_norm": (_V, "double", "sqrt(aggregate(v, 0d, (s, x) -> s + x * x))"),
    "vector_argmax": (_V, "int", "cast(array_position(v, array_max(v)) as int) - 1"),
}


@udtf(returnType="r int, c int")
class GridCells:
    """Cells of the patches of p that an image of h x w holds whole; none for null sizes."""

    def eval(self, h: int, w: int, p: int):
        if h is not None and w is not None and p:
            for r in range(h // p):
                for c in range(w // p):
                    yield r, c


@udtf(returnType="k int, threshold double")
class CurveThresholds:
    """The n + 1 thresholds of a curve, from 0 to 1."""

    def eval(self, n: int):
        for k in range((n or 0) + 1 if n is not None else 0):
            yield k, k / n if n else 0.0


@udtf(returnType="dr int, dc int")
class WindowOffsets:
    """Steps to the cells of a window around a cell, itself included."""

    def eval(self, radius: int):
        for dr in range(-radius, radius + 1) if radius is not None else ():
            for dc in range(-radius, radius + 1):
                yield dr, dc


#: For lateral joins in SQL, whose arguments may be columns; SQL's own table functions may not read those in generators.
TABLES = {"grid_cells": GridCells, "curve_thresholds": CurveThresholds, "window_offsets": WindowOffsets}


def register_tables(spark: SparkSession) -> list[str]:
    """Make the table functions known to the session's SQL; returns their names."""
    for name, table in TABLES.items():
        spark.udtf.register(name, table)
    return sorted(TABLES)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; returns their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {body}")
    return sorted(FUNCTIONS)

"""Geometry of images as tables of cells (image_id, r, c, ..): sizes, crops, pads and resizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def image_sizes(images: DataFrame, downsample: int | None = None) -> DataFrame:
    """h_patch, w_patch, h_pad, w_pad of images (h, w, p): whole patches, the rest is cropped."""
    p = F.lit(downsample) if downsample else F.col("p")
    whole = lambda x: F.floor(F.col(x) / p).cast("int")
    return images.withColumns({"h_patch": whole("h"), "w_patch": whole("w")}).withColumns({"h_pad": F.col("h_patch") * p, "w_pad": F.col("w_patch") * p})


def crop(cells: DataFrame, h: Column | int, w: Column | int) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return cells.where((F.col("r") < as_col(h)) & (F.col("c") < as_col(w)))


def lattice(images: DataFrame, h: int, w: int) -> DataFrame:
    """Every cell of an h x w grid for each image."""
    rows = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("r"))
    return rows.select("image_id", "r", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("c"))


def pad(cells: DataFrame, value: str, h: int, w: int) -> DataFrame:
    """Cells up to h x w, new ones 0."""
    every = lattice(cells.select("image_id").distinct(), h, w)
    return every.join(cells.select("image_id", "r", "c", value), ["image_id", "r", "c"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def nearest_resize(cells: DataFrame, value: str, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Cells of a grid of `size` at `to`: target i takes source min(floor(i * n / m), n - 1)."""
    source = lambda i, n, m: F.least(F.floor(F.col(i) * (n / m)).cast("int"), F.lit(n - 1))
    every = lattice(cells.select("image_id").distinct(), *to).withColumns({"sr": source("r", size[0], to[0]), "sc": source("c", size[1], to[1])})
    own = cells.select("image_id", F.col("r").alias("sr"), F.col("c").alias("sc"), value)
    return every.join(own, ["image_id", "sr", "sc"]).select("image_id", "r", "c", value)


def hybrid_resize(cells: DataFrame, value: str, size: tuple[int, int], to: tuple[int, int], p: int) -> DataFrame:
    """Nearest to the full size, but exact p-fold cells where whole patches reach."""
    inner = (F.col("r") < size[0] * p) & (F.col("c") < size[1] * p)
    near = lambda i, n, m: F.least(F.floor(F.col(i) * (n / m)).cast("int"), F.lit(n - 1))
    at = {"sr": F.when(inner, F.floor(F.col("r") / p).cast("int")).otherwise(near("r", size[0], to[0])), "sc": F.when(inner, F.floor(F.col("c") / p).cast("int")).otherwise(near("c", size[1], to[1]))}
    own = cells.select("image_id", F.col("r").alias("sr"), F.col("c").alias("sc"), value)
    return lattice(cells.select("image_id").distinct(), *to).withColumns(at).join(own, ["image_id", "sr", "sc"]).select("image_id", "r", "c", value)


def bilinear_resize(cells: DataFrame, value: str, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Weighted sum of four neighbours; centre-aligned coordinates, not below 0."""
    every = lattice(cells.select("image_id").distinct(), *to)
    taps = []
    for axis, n, m in (("r", size[0], to[0]), ("c", size[1], to[1])):
        x = F.greatest((F.col(axis) + 0.5) * (n / m) - 0.5, F.lit(0.0))
        low = F.floor(x).cast("int")
        f = x - low
        taps.append(F.array(F.struct(low.alias("i"), (1 - f).alias("f")), F.struct(F.least(low + 1, F.lit(n - 1)).alias("i"), f.alias("f"))))
    each = every.withColumns({"tr": F.explode(taps[0])}).withColumn("tc", F.explode(taps[1]))
    own = cells.select("image_id", F.col("r").alias("sr"), F.col("c").alias("sc"), F.col(value).cast("double").alias("x"))
    met = each.select("image_id", "r", "c", F.col("tr.i").alias("sr"), F.col("tc.i").alias("sc"), (F.col("tr.f") * F.col("tc.f")).alias("f")).join(own, ["image_id", "sr", "sc"])
    return met.groupBy("image_id", "r", "c").agg(F.sum(F.col("x") * F.col("f")).alias(value))


def center_crop(cells: DataFrame, size: tuple[int, int]) -> DataFrame:
    """The middle square of the smaller side, from (0, 0) again; odd margins are halved to even."""
    s = min(size)
    top, left = (F.bround(F.lit((n - s) / 2.0)).cast("int") for n in size)
    kept = cells.where((F.col("r") >= top) & (F.col("r") < top + s) & (F.col("c") >= left) & (F.col("c") < left + s))
    return kept.withColumns({"r": F.col("r") - top, "c": F.col("c") - left})


def patch_grid(patches: DataFrame, w: Column | int) -> DataFrame:
    """Row and column of a row-major patch number."""
    width = w if isinstance(w, Column) else F.lit(w)
    return patches.withColumns({"r": F.floor(F.col("patch") / width).cast("int"), "c": (F.col("patch") % width).cast("int")})


def segmap_width(cells: Column, h: Column, w: Column) -> Column:
    """Width of a row-major label map of `cells` cells of an image of h x w patches: w, or 2 * w on the doubled grid; else an error."""
    return F.when(cells == h * w, w).when(cells == 4 * h * w, 2 * w).otherwise(F.raise_error(F.lit("a label map fits no patch grid")).cast("int"))


def infer_patch(length: Column, h: Column, w: Column) -> Column:
    """Patch size that fits a mask of `length` cells of an h x w image: 8, 16, 16 at double grid, 32 at fourfold grid; else an error."""
    cells = lambda p: F.floor(h / p) * F.floor(w / p)
    return F.when(length == cells(8), 8).when(length == cells(16), 16).when(length == 4 * cells(16), 8).when(length == 16 * cells(32), 8).otherwise(F.raise_error(F.lit("no patch size fits")).cast("int"))


def channel_normalize(x: Column, mean: float, std: float) -> Column:
    return (x / 255.0 - mean) / std


def channel_restore(x: Column, mean: float, std: float) -> Column:
    return F.greatest(F.least(x * std + mean, F.lit(1.0)), F.lit(0.0))

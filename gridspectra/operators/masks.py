"""Label maps and masks as tables of cells (image_id, r, c, label)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import infer_patch

BACKGROUND = 0


def border_fraction(cells: DataFrame, h: int | Column, w: int | Column) -> DataFrame:
    """Share of the border that each label of an image holds; corners count twice, labels off the border 0. h and w may be columns, the same in all cells of an image."""
    flags = sum((F.col(a) == b).cast("int") for a, b in (("c", 0), ("c", w - 1), ("r", 0), ("r", h - 1)))
    return cells.groupBy("image_id", "label").agg((F.sum(flags) / F.max(F.lit(2.0) * (h + w))).alias("fraction"))


def background_label(fractions: DataFrame) -> DataFrame:
    order = Window.partitionBy("image_id").orderBy(F.desc("fraction"), "label")
    return fractions.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("image_id", F.col("label").alias("background"))


def with_side(rows: DataFrame, side: int, grids: DataFrame | None) -> DataFrame:
    """Rows with `side`, the patches in a row of their image: `w` of `grids` (image_id, w), one row an image; where that has none, the given number."""
    if grids is None:
        return rows.withColumn("side", F.lit(side))
    known = grids.select("image_id", F.col("w").cast("int").alias("known_side"))
    return rows.join(known, "image_id", "left").withColumn("side", F.coalesce("known_side", F.lit(side))).drop("known_side")


def background_first(cells: DataFrame, h: int | Column | None = None, w: int | Column | None = None) -> DataFrame:
    """Labels with the image's most frequent border label and 0 exchanged. Without h and w each image's own last row and column are borders."""
    if h is None or w is None:
        every = Window.partitionBy("image_id")
        sized = cells.withColumns({"h": F.max("r").over(every) + 1, "w": F.max("c").over(every) + 1})
        return background_first(sized, F.col("h"), F.col("w")).drop("h", "w")
    b = background_label(border_fraction(cells, h, w))
    swap = F.when(F.col("label") == F.col("background"), 0).when(F.col("label") == 0, F.col("background")).otherwise(F.col("label"))
    return cells.join(b, "image_id").withColumn("label", swap).drop("background")


def binarize_255(cells: DataFrame, rule: str = "subset") -> DataFrame:
    """255 to 1 in images whose labels are a subset of {0, 255}, are both of them ("equal"), or in all ("always")."""
    every = Window.partitionBy("image_id")
    only = F.count_if(~F.col("label").isin(0, 255)).over(every) == 0
    both = (F.count_if(F.col("label") == 0).over(every) > 0) & (F.count_if(F.col("label") == 255).over(every) > 0)
    applies = {"subset": only, "equal": only & both, "always": F.lit(True)}[rule]
    return cells.withColumn("label", F.when(applies & (F.col("label") == 255), 1).otherwise(F.col("label")))


def relabel(cells: DataFrame, mapping: DataFrame, offset: int = 0) -> DataFrame:
    """Segments to clusters by (image_id, label, cluster); 0 stays 0, other labels without a cluster are an error."""
    met = cells.join(mapping, ["image_id", "label"], "left")
    missing = F.raise_error(F.concat(F.lit("no cluster for label "), F.col("label").cast("string"))).cast("int")
    return met.withColumn("label", F.when(F.col("label") == 0, 0).otherwise(F.coalesce(F.col("cluster") + offset, missing))).drop("cluster")


def segment_boxes(cells: DataFrame, scale: int = 1, skip_background: bool = True) -> DataFrame:
    """Box of each label, far sides excluded."""
    own = cells.where(F.col("label") != BACKGROUND) if skip_background else cells
    side = lambda f, c, k: ((f(c) + k) * scale).cast("int")
    return own.groupBy("image_id", "label").agg(side(F.min, "c", 0).alias("xmin"), side(F.min, "r", 0).alias("ymin"), side(F.max, "c", 1).alias("xmax"), side(F.max, "r", 1).alias("ymax"))


def _step(cells: DataFrame, erode: bool) -> DataFrame:
    rows, cols = (Window.partitionBy("image_id", "label", a).orderBy(b) for a, b in (("r", "c"), ("c", "r")))
    outside = F.lit(1 if erode else 0)
    # a cell that is missing is outside: the next cell of the table counts only where it lies beside
    beside = lambda f, w, at, by: F.when(f(at).over(w) == F.col(at) + by, f("x").over(w))
    near = [F.coalesce(beside(f, w, at, by), outside) for w, at in ((rows, "c"), (cols, "r")) for f, by in ((F.lag, -1), (F.lead, 1))]
    new = (F.least if erode else F.greatest)("x", *near)
    stepped = cells.withColumn("y", new)
    any_left = F.max("y").over(Window.partitionBy("image_id", "label")) > 0
    return stepped.withColumn("x", F.when(any_left, F.col("y")).otherwise(F.col("x"))).drop("y")


def masks_of(cells: DataFrame, skip_background: bool = True) -> DataFrame:
    """A 0/1 mask x over all cells of the image for each of its labels. Labels of an image are few; their masks share its cells."""
    labels = cells.groupBy("image_id").agg(F.collect_set("label").alias("labels"))
    each = cells.join(labels, "image_id").select("image_id", "r", "c", F.col("label").alias("own"), F.explode("labels").alias("label"))
    each = each.withColumn("x", (F.col("own") == F.col("label")).cast("int")).drop("own")
    return each.where(F.col("label") != BACKGROUND) if skip_background else each


def erode(masks: DataFrame, times: int = 1) -> DataFrame:
    """Cells (image_id, label, r, c, x) whose four neighbours are set too; an iteration that empties a mask is not taken."""
    for _ in range(times):
        masks = _step(masks, True)
    return masks


def dilate(masks: DataFrame, times: int = 1) -> DataFrame:
    for _ in range(times):
        masks = _step(masks, False)
    return masks


def _beside(x: np.ndarray, outside: bool) -> list[np.ndarray]:
    """The four neighbours of every cell; beyond the edge all are `outside`."""
    wide = np.pad(x, 1, constant_values=outside)
    return [wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]]


def boxes(cells: DataFrame, n_erode: int = 2, n_dilate: int = 3, scale: int = 1, skip_background: bool = True) -> DataFrame:
    """Boxes of the labels after erosion and dilation of each label's mask, as `erode` and `dilate` have it.

    An image is one group and its masks stay in its kernel: one exchange, whatever the number of steps.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(pdf["r"].min()), int(pdf["c"].min())
        at = (pdf["r"].to_numpy() - top, pdf["c"].to_numpy() - left)
        there = np.zeros((at[0].max() + 1, at[1].max() + 1), bool)
        label = np.zeros(there.shape, np.int64)
        there[at], label[at] = True, pdf["label"].to_numpy()
        found = []
        for own in np.unique(label[there]):
            if own == BACKGROUND and skip_background:
                continue
            x = there & (label == own)
            for _ in range(n_erode):
                y = np.logical_and.reduce([x, *_beside(x | ~there, True)])
                x = y if y.any() else x
            for _ in range(n_dilate):
                x = there & np.logical_or.reduce([x, *_beside(x, False)])
            r, c = np.nonzero(x)
            found.append((pdf["image_id"].iloc[0], own, (left + c.min()) * scale, (top + r.min()) * scale, (left + c.max() + 1) * scale, (top + r.max() + 1) * scale))
        return pd.DataFrame(found, columns=["image_id", "label", "xmin", "ymin", "xmax", "ymax"])

    kind = cells.schema["image_id"].dataType.simpleString()
    label = cells.schema["label"].dataType.simpleString()
    whole = cells.select("image_id", "r", "c", "label").where("label is not null")
    return whole.groupBy("image_id").applyInPandas(run, f"image_id {kind}, label {label}, xmin int, ymin int, xmax int, ymax int")


def to_image(boxes: DataFrame, images: DataFrame, cells: str | None = None, scale: int = 16) -> DataFrame:
    """Boxes (image_id, x1, y1, x2, y2) in patches as pixels, far sides clipped to the image (image_id, h, w).

    With `cells`, the column that counts a mask's cells, the patch size is inferred from it, else it is `scale`.
    """
    p = infer_patch(F.col(cells), F.col("h"), F.col("w")) if cells else F.lit(scale)
    met = boxes.join(images.select("image_id", "h", "w"), "image_id").withColumn("p", p)
    near = [(F.col(c) * F.col("p")).cast("int").alias(c) for c in ("x1", "y1")]
    far = [F.least(F.col(c) * F.col("p"), F.col(side)).cast("int").alias(c) for c, side in (("x2", "w"), ("y2", "h"))]
    return met.select("image_id", *near, *far)


def with_class(cells: DataFrame, label: int) -> DataFrame:
    """All cells of the images whose map holds the label."""
    return cells.join(cells.where(F.col("label") == label).select("image_id").distinct(), "image_id", "left_semi")


def first_channel_mask(red: Column) -> Column:
    """A mask file's cells from the first channel's bytes: above one half of 255."""
    return red / F.lit(255.0) > 0.5


def label_components(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Components of the equal, non-negative cells of a label array: the smallest linear index of each, -1 elsewhere.

    A row's stretches of equal cells are runs. Runs of neighbouring rows that touch are joined: trees of runs are hooked, larger roots to smaller, and
    flattened until no joined runs differ. The work grows with the runs, not with the length of a path.
    """
    h, w = mask.shape
    if not mask.size:
        return np.full((h, w), -1)
    flat = mask.ravel()
    new = np.ones(h * w, bool)
    new[1:] = flat[1:] != flat[:-1]
    new[::w] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], h * w) - 1
    used = flat[start] >= 0
    run = np.cumsum(new) - 1
    row, reach = start // w, int(diagonal)
    # places with a gap between rows, so that what reaches beyond a row meets nothing
    first, last = row * (w + 2) + start % w, row * (w + 2) + end % w
    low = np.searchsorted(last, first + (w + 2) - reach)
    count = np.maximum(np.searchsorted(first, last + (w + 2) + reach, side="right") - low, 0)
    count[~used] = 0
    i = np.repeat(np.arange(len(start)), count)
    j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    same = flat[start[i]] == flat[start[j]]
    i, j, root = i[same], j[same], np.arange(len(start))
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return np.where(used, start[root], -1)[run].reshape(h, w)


def connected_components(cells: DataFrame, diagonal: bool = False, label: str = "label") -> DataFrame:
    """Cells with component: the smallest r * width + c of the connected cells of equal label. One image is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["r"].max()) + 1, int(pdf["c"].max()) + 1
        grid = np.full((h, w), -1, np.int64)
        grid[pdf["r"], pdf["c"]] = pdf[label]
        pdf["component"] = label_components(grid, diagonal)[pdf["r"], pdf["c"]].astype(np.int32)
        return pdf[["image_id", "r", "c", label, "component"]]

    return cells.select("image_id", "r", "c", F.col(label).cast("int").alias(label)).groupBy("image_id").applyInPandas(run, f"image_id int, r int, c int, {label} int, component int")


def largest_component(components: DataFrame) -> DataFrame:
    """Cells of each image's largest component, the first in raster order among equals."""
    n = components.groupBy("image_id", "component").agg(F.count("*").alias("n"))
    order = Window.partitionBy("image_id").orderBy(F.desc("n"), "component")
    best = n.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("image_id", "component")
    return components.join(best, ["image_id", "component"], "left_semi")


def majority_flip(x: Column, keys: list[str]) -> Column:
    """Mask or vector signs turned where more than half, but not all, is positive."""
    share = F.avg((x > 0).cast("double")).over(Window.partitionBy(*keys))
    return (share > 0.5) & (share < 1.0)

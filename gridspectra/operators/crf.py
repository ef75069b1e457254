"""Dense conditional random field over the pixels of an image: label maps sharpened along colors.

Every two pixels are tied by two Gaussian kernels, one over place and color, one over place. Mean-field steps need the two filters only;
they are carried out on a permutohedral lattice (time in proportion to the pixels) or, for small images and as a check, over all pairs.
One image is one group; its lattices are made once and serve all steps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the all-pairs filter handled at once.
ROWS = 256


class Lattice:
    """Gaussian filter of unit width over points of d dimensions: values are splat to the corners of the simplices around the points, blurred along
    the d + 1 axes of the lattice, and sliced at the points again. Approximate; with normalization its constant does not matter.
    """

    def __init__(self, points: np.ndarray):
        n, d = points.shape
        # onto the plane of coordinate sum 0 in d + 1 dimensions; the blur's variance of 2/3 (d + 1)^2 becomes 1
        steps = points * (np.sqrt(2.0 / 3.0) * (d + 1) / np.sqrt(np.arange(1, d + 1) * np.arange(2, d + 2)))
        lifted = np.zeros((n, d + 1))
        lifted[:, :d] = np.cumsum(steps[:, ::-1], axis=1)[:, ::-1]
        lifted[:, 1:] -= np.arange(1, d + 1) * steps
        # nearest point of the coarse lattice, and the order of what is left
        base = np.rint(lifted / (d + 1)).astype(np.int64) * (d + 1)
        rest = lifted - base
        rank = np.empty_like(base)
        np.put_along_axis(rank, np.argsort(-rest, axis=1, kind="stable"), np.arange(d + 1)[None], axis=1)
        rank += base.sum(axis=1, keepdims=True) // (d + 1)
        wrap = np.where(rank < 0, d + 1, np.where(rank > d, -(d + 1), 0))
        rank, base = rank + wrap, base + wrap
        share = (lifted - base) / (d + 1)
        by_rank = np.empty_like(share)
        np.put_along_axis(by_rank, rank, share, axis=1)
        # weight of corner r: the step between the shares of neighbouring ranks
        self.weight = np.empty((n, d + 1))
        self.weight[:, 1:] = by_rank[:, d - 1 :: -1] - by_rank[:, :0:-1] if d > 1 else by_rank[:, :1] - by_rank[:, 1:]
        self.weight[:, 0] = 1 - self.weight[:, 1:].sum(axis=1)
        corner = np.empty((n, d + 1, d), np.int64)
        for r in range(d + 1):
            corner[:, r] = base[:, :d] + np.where(rank[:, :d] <= d - r, r, r - (d + 1))
        flat = corner.reshape(-1, d)
        low = flat.min(axis=0) - d - 1
        span = [int(x) for x in flat.max(axis=0) + d + 2 - low]
        scale = [1]
        for s in span[:-1]:
            scale.append(scale[-1] * s)
        if scale[-1] * span[-1] >= 1 << 63:
            raise ValueError("the points spread over too many cells for their widths")
        scale = np.array(scale, np.int64)
        self.key, place = np.unique((flat - low) @ scale, return_inverse=True)
        self.place, self.n = place.reshape(n, d + 1), n
        self.near = []
        for axis in range(d + 1):
            shift = np.full(d, -1, np.int64)
            if axis < d:
                shift[axis] = d
            step = int(shift @ scale)
            self.near.append([self._find(self.key + step), self._find(self.key - step)])

    def _find(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, len(self.key))  # the last cell is empty

    def __call__(self, values: np.ndarray) -> np.ndarray:
        cells = np.zeros((len(self.key) + 1, values.shape[1]))
        for r in range(self.place.shape[1]):
            for c in range(values.shape[1]):
                cells[:, c] += np.bincount(self.place[:, r], self.weight[:, r] * values[:, c], minlength=len(cells))
        for up, down in self.near:
            blurred = np.zeros_like(cells)
            blurred[:-1] = 0.5 * cells[:-1] + 0.25 * (cells[up] + cells[down])
            cells = blurred
        out = np.zeros((self.n, values.shape[1]))
        for r in range(self.place.shape[1]):
            out += self.weight[:, r, None] * cells[self.place[:, r]]
        return out


class Pairs:
    """The same filter, exact, over all pairs, some rows at a time."""

    def __init__(self, points: np.ndarray):
        self.points = points

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(values.shape)
        for a in range(0, len(values), ROWS):
            d = ((self.points[a : a + ROWS, None] - self.points[None]) ** 2).sum(axis=2)
            out[a : a + ROWS] = np.exp(-0.5 * d) @ values
        return out


FILTERS: dict[str, Callable] = {"lattice": Lattice, "pairs": Pairs}


def mean_field(labels: np.ndarray, places: np.ndarray, colors: np.ndarray, n: int, w1: float, alpha: float, beta: float, w2: float, gamma: float, steps: int, sure: float, kind: str) -> np.ndarray:
    """Probabilities (pixels x labels) after `steps` updates; see `refine`."""
    start = np.full((len(labels), n), (1 - sure) / max(n - 1, 1))
    start[np.arange(len(labels)), labels] = sure if n > 1 else 1.0
    unary = np.log(start)
    kernels = []
    for weight, points in ((w1, np.hstack((places / alpha, colors / beta))), (w2, places / gamma)):
        if weight:
            run = FILTERS[kind](points)
            norm = 1 / np.sqrt(run(np.ones((len(labels), 1))) + 1e-20)
            kernels.append((weight, run, norm))
    q = start
    for _ in range(steps):
        energy = unary + sum(weight * norm * run(norm * q) for weight, run, norm in kernels)
        q = np.exp(energy - energy.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
    return q


def probabilities(pixels: DataFrame, n: int, w1: float = 10.0, alpha: float = 80.0, beta: float = 13.0, w2: float = 3.0, gamma: float = 3.0, steps: int = 5, sure: float = 0.9, kind: str = "lattice") -> DataFrame:
    """image_id, r, c, label, q: the probability of every label at every pixel after `steps` mean-field updates; arguments as of `refine`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q = _field(pdf, n, w1, alpha, beta, w2, gamma, steps, sure, kind)
        size = len(pdf)
        return pd.DataFrame({"image_id": np.repeat(pdf["image_id"].to_numpy(), n), "r": np.repeat(pdf["r"].to_numpy(), n), "c": np.repeat(pdf["c"].to_numpy(), n), "label": np.tile(np.arange(n), size), "q": q.ravel()})

    own = pixels.select("image_id", "r", "c", "label", "red", "green", "blue")
    return own.groupBy("image_id").applyInPandas(run, f"image_id {_kind(own)}, r int, c int, label int, q double")


def refine(pixels: DataFrame, n: int, w1: float = 10.0, alpha: float = 80.0, beta: float = 13.0, w2: float = 3.0, gamma: float = 3.0, steps: int = 5, sure: float = 0.9, kind: str = "lattice") -> DataFrame:
    """image_id, r, c, label: the likeliest label of every pixel of `pixels` (image_id, r, c, label, red, green, blue), ties to the smaller.

    A pixel starts with probability `sure` for its label; two pixels of one label gain w1 exp(-|place|^2 / 2 alpha^2 - |color|^2 / 2 beta^2) +
    w2 exp(-|place|^2 / 2 gamma^2), each kernel normalized symmetrically. Labels are 0 .. n - 1, others an error; so is a pixel without a color.
    An image is one group and holds its pixels once for each label and corner of a simplex.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q = _field(pdf, n, w1, alpha, beta, w2, gamma, steps, sure, kind)
        return pd.DataFrame({"image_id": pdf["image_id"], "r": pdf["r"], "c": pdf["c"], "label": q.argmax(axis=1)})

    own = pixels.select("image_id", "r", "c", "label", "red", "green", "blue")
    return own.groupBy("image_id").applyInPandas(run, f"image_id {_kind(own)}, r int, c int, label int")


def _kind(df: DataFrame) -> str:
    return df.schema["image_id"].dataType.simpleString()


def _field(pdf: pd.DataFrame, n: int, w1, alpha, beta, w2, gamma, steps, sure, kind) -> np.ndarray:
    if not pdf["label"].between(0, n - 1).all():
        raise ValueError(f"labels of image {pdf['image_id'].iloc[0]} are not all in 0 .. {n - 1}")
    colors = pdf[["red", "green", "blue"]].to_numpy(np.float64)
    if not np.isfinite(colors).all():
        raise ValueError(f"image {pdf['image_id'].iloc[0]} has pixels without a color")
    return mean_field(pdf["label"].to_numpy(np.int64), pdf[["r", "c"]].to_numpy(np.float64), colors, n, w1, alpha, beta, w2, gamma, steps, sure, kind)


def at_pixels(cells: DataFrame, colors: DataFrame, sizes: DataFrame, scale: int = 16) -> DataFrame:
    """Labels of patches (image_id, r, c, label) at the pixels of `colors` (image_id, r, c, red, green, blue), for `refine`.

    A patch covers scale x scale pixels; the rest of an image of `sizes` (image_id, h, w), right and below, takes the nearest patch of the map stretched
    over the image. Maps of 0 and 255 alone become 0 and 1. Joined by patch, so a pixel is one row; pixels without a patch are left out.
    """
    seen = cells.groupBy("image_id").agg(F.bool_and(F.col("label").isin(0, 255)).alias("binary"), F.max(F.col("label") == 255).alias("some"), F.min("label").alias("least"))
    two = F.col("binary") & F.col("some") & (F.col("least") == 0)
    small = cells.join(seen, "image_id").select("image_id", F.col("r").alias("pr"), F.col("c").alias("pc"), F.when(two & (F.col("label") == 255), 1).otherwise(F.col("label")).alias("label"))
    grid = sizes.select("image_id", "h", "w", F.floor(F.col("h") / scale).alias("hp"), F.floor(F.col("w") / scale).alias("wp"))
    whole = colors.join(grid, "image_id")
    inside = (F.col("r") < F.col("hp") * scale) & (F.col("c") < F.col("wp") * scale)
    pr = F.when(inside, F.floor(F.col("r") / scale)).otherwise(F.floor(F.col("r") * F.col("hp") / F.col("h")))
    pc = F.when(inside, F.floor(F.col("c") / scale)).otherwise(F.floor(F.col("c") * F.col("wp") / F.col("w")))
    return whole.withColumns({"pr": pr.cast("int"), "pc": pc.cast("int")}).join(small, ["image_id", "pr", "pc"]).select("image_id", "r", "c", "label", "red", "green", "blue")

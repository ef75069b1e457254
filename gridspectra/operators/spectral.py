"""Spectral operators: one image is one group. Up to DENSE patches its matrix lives inside the kernel (N x N doubles); from there on eigenpairs
come from products with it (`lanczos`), in memory in proportion to patches times vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, lanczos, masks

#: Patches up to which the dense solver is used, unless told otherwise.
DENSE = 1024
EIGEN = "image_id int, k int, eigenvalue double, eigenvector array<double>, residual double"


def pin_sign(v: np.ndarray) -> np.ndarray:
    """Columns turned so that at most half of their entries are positive; at exactly half, or all, the largest entry is positive."""
    out = v.copy()
    for i in range(v.shape[1]):
        share = (v[:, i] > 0).mean()
        if share > 0.5 and share < 1.0:
            out[:, i] = -v[:, i]
        elif share in (0.0, 0.5, 1.0) and v[np.abs(v[:, i]).argmax(), i] < 0:
            out[:, i] = -v[:, i]
    return out


def turned(eigens: DataFrame, vector: str = "eigenvector") -> DataFrame:
    """The rule of `pin_sign` over a table of vectors, one to a row."""
    v = F.col(vector)
    share = F.size(F.filter(v, lambda x: x > 0)) / F.size(v)
    far = F.array_max(F.transform(v, lambda x: F.abs(x)))
    largest = F.element_at(F.filter(v, lambda x: F.abs(x) == far), 1)
    turn = ((share > 0.5) & (share < 1.0)) | (share.isin(0.0, 0.5, 1.0) & (largest < 0))
    return eigens.withColumn(vector, F.when(turn, F.transform(v, lambda x: -x)).otherwise(v))


def _taps(n: int, m: int) -> np.ndarray:
    """Bilinear weights (m x n) of n cells for m; centre-aligned, not below the first or beyond the last."""
    x = np.maximum((np.arange(m) + 0.5) * (n / m) - 0.5, 0.0)
    low = np.floor(x).astype(int)
    out = np.zeros((m, n))
    np.add.at(out, (np.arange(m), np.minimum(low, n - 1)), 1 - (x - low))
    np.add.at(out, (np.arange(m), np.minimum(low + 1, n - 1)), x - low)
    return out


def upsampled(f: np.ndarray, size: tuple[int, int], to: tuple[int, int]) -> np.ndarray:
    """Row-major features of a grid of `size` at `to`, bilinear."""
    if len(f) != size[0] * size[1]:
        raise ValueError(f"{len(f)} patches are no grid of {size[0]} x {size[1]}")
    if size == to:
        return f
    return np.einsum("ar,bc,rcd->abd", _taps(size[0], to[0]), _taps(size[1], to[1]), f.reshape(*size, -1), optimize=True).reshape(to[0] * to[1], -1)


def laplacian_eigen(f: np.ndarray, k: int, normalize: bool = True, lapnorm: bool = True, extra: np.ndarray | None = None, color: float = 0.0, size: tuple[int, int] | None = None, to: tuple[int, int] | None = None, clip: bool = True, dense: int | None = None):
    """Smallest k of (D - W) v = l D v (or of D - W): W the scaled Gram matrix, clipped at 0 unless told otherwise, and `color` times another affinity.

    With `to`, normalized features are first brought from a grid of `size` to one of `to`. `extra` is a matrix or a `lanczos.Edges`. Beyond `dense` patches
    (DENSE by default) the pairs are found by restarted block Lanczos, unless all are asked for.
    """
    if normalize:
        f = f / np.maximum(np.linalg.norm(f, axis=1, keepdims=True), 1e-12)
    if to is not None:
        f = upsampled(f, size, to)
    if len(f) > (DENSE if dense is None else dense) and 4 * k < len(f):
        value, v, rest = lanczos.laplacian(lanczos.Affinity(f, clip, extra, color), k, lapnorm)
        return value, pin_sign(v), rest
    w = f @ f.T
    if clip:
        w = np.maximum(w, 0.0)
    w /= max(float(w.max()), 1e-300)
    if extra is not None and color > 0:
        w = w + color * (extra.matrix() if isinstance(extra, lanczos.Edges) else extra)
    d = w.sum(axis=1)
    d[d < 1e-12] = 1.0
    lap = np.diag(d) - w
    if lapnorm:
        s = 1 / np.sqrt(d)
        value, u = np.linalg.eigh(s[:, None] * lap * s[None, :])
        v = s[:, None] * u
        rest = np.abs(lap @ v - d[:, None] * v * value).max(axis=0)
    else:
        value, v = np.linalg.eigh(lap)
        rest = np.abs(lap @ v - v * value).max(axis=0)
    return value[:k], pin_sign(v[:, :k]), rest[:k]


def affinity_eigen(f: np.ndarray, k: int, normalize: bool = True, dense: int | None = None):
    """Largest k by magnitude of the clipped Gram matrix, values and vectors in the same falling order; beyond `dense` patches by Lanczos."""
    if normalize:
        f = f / np.maximum(np.linalg.norm(f, axis=1, keepdims=True), 1e-12)
    if len(f) > (DENSE if dense is None else dense) and 4 * k < len(f):
        product = lanczos.Affinity(f)
        value, v = lanczos.by_size(product, len(f), k)
        value = value / product.scale
        return value, pin_sign(v), np.abs(product(v) / product.scale - v * value).max(axis=0)
    w = np.maximum(f @ f.T, 0.0)
    value, v = np.linalg.eigh(w)
    order = np.argsort(-np.abs(value), kind="stable")[:k]
    value, v = value[order], v[:, order]
    return value, pin_sign(v), np.abs(w @ v - v * value).max(axis=0)


def affinity_svd(f: np.ndarray, k: int, normalize: bool = True):
    if normalize:
        f = f / np.maximum(np.linalg.norm(f, axis=1, keepdims=True), 1e-12)
    u, s, vt = np.linalg.svd(f, full_matrices=False)
    return s[:k], pin_sign(u[:, :k]), np.full(min(k, len(s)), np.abs(u * s @ vt - f).max())


def eigen(features: DataFrame, which: str = "laplacian", k: int = 20, **options) -> DataFrame:
    """EIGEN rows from patch features (image_id, patch, k). `which`: laplacian (also matting_laplacian), affinity (affinity_torch), affinity_svd."""
    kernels: dict[str, Callable] = {"laplacian": laplacian_eigen, "matting_laplacian": laplacian_eigen, "affinity": affinity_eigen, "affinity_torch": affinity_eigen, "affinity_svd": affinity_svd}
    kernel = kernels[which]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("patch")
        value, v, rest = kernel(np.stack(pdf["k"].to_list()).astype(np.float64), k, **options)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "k": np.arange(len(value), dtype=np.int32), "eigenvalue": value, "eigenvector": list(v.T), "residual": rest})

    return features.select("image_id", "patch", "k").groupBy("image_id").applyInPandas(run, EIGEN)


def with_color(features: DataFrame, color: DataFrame, weight: float, k: int = 20, lapnorm: bool = True, size: tuple[int, int] | None = None, to: tuple[int, int] | None = None, clip: bool = True, dense: int | None = None) -> DataFrame:
    """Laplacian eigenvectors of feature affinity plus `weight` times a color affinity (image_id, i, j, w).

    With `to`, features are brought from a grid of `size` to one of `to`, whose cells the color affinity is between. The color affinity stays a list of edges
    beyond `dense` patches.
    """

    def run(own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("patch")
        extra = lanczos.Edges(to[0] * to[1] if to else len(own), edges["i"].to_numpy(), edges["j"].to_numpy(), edges["w"].to_numpy(np.float64))
        value, v, rest = laplacian_eigen(np.stack(own["k"].to_list()).astype(np.float64), k, True, lapnorm, extra, weight, size, to, clip, dense)
        return pd.DataFrame({"image_id": own["image_id"].iloc[0], "k": np.arange(len(value), dtype=np.int32), "eigenvalue": value, "eigenvector": list(v.T), "residual": rest})

    edges = color.select(F.col("image_id").alias("edge_image"), "i", "j", "w")
    return features.select("image_id", "patch", "k").groupBy("image_id").cogroup(edges.groupBy("edge_image")).applyInPandas(run, EIGEN)


def single_region(eigens: DataFrame, threshold: float = 0.0, k: int = 1, side: int = 10, grids: DataFrame | None = None) -> DataFrame:
    """Cells of eigenvector k above the threshold: image_id, r, c, label (0 or 1). `grids` as in `masks.with_side`."""
    cells = masks.with_side(eigens.where(F.col("k") == k).select("image_id", "eigenvector"), side, grids).select("image_id", "side", F.posexplode("eigenvector").alias("patch", "v"))
    return cells.select("image_id", F.floor(F.col("patch") / F.col("side")).cast("int").alias("r"), (F.col("patch") % F.col("side")).alias("c"), (F.col("v") > threshold).cast("int").alias("label"))


def _component_box(pdf_to_mask: Callable, scale: int, diagonal: bool) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask, seed = pdf_to_mask(pdf)
        comp = masks.label_components(np.where(mask, 1, -1), diagonal)
        ids, n = np.unique(comp[comp >= 0], return_counts=True)
        chosen = comp[seed] if seed is not None else (ids[n.argmax()] if len(ids) else -2)
        r, c = np.nonzero(comp == chosen)
        box = (c.min() * scale, r.min() * scale, (c.max() + 1) * scale, (r.max() + 1) * scale) if len(r) else (None,) * 4
        return pd.DataFrame([[pdf["image_id"].iloc[0], *box]], columns=["image_id", "x1", "y1", "x2", "y2"])

    return run


BOX = "image_id int, x1 int, y1 int, x2 int, y2 int"


def mask_box(cells: DataFrame, scale: int = 16, images: DataFrame | None = None) -> DataFrame:
    """Box of the largest 8-connected part of each mask (image_id, r, c, label); an empty mask is full, one of more than half is turned.

    With `images` (image_id, h, w), the patch size is inferred from the number of cells and boxes are clipped to the image.
    """

    def mask(pdf):
        m = np.zeros((pdf["r"].max() + 1, pdf["c"].max() + 1), bool)
        m[pdf["r"], pdf["c"]] = pdf["label"] > 0
        if not m.any():
            m[:] = True
        if 0.5 < m.mean() < 1.0:
            m = ~m
        return m, None

    found = cells.groupBy("image_id").applyInPandas(_component_box(mask, scale if images is None else 1, True), BOX)
    if images is None:
        return found
    return masks.to_image(found.join(cells.groupBy("image_id").agg(F.count("*").alias("cells")), "image_id"), images, "cells")


def lost_box(features: DataFrame, k: int = 100, scale: int = 16, side: int = 10, images: DataFrame | None = None, grids: DataFrame | None = None) -> DataFrame:
    """Box of the 4-connected part around the seed of the patches whose summed affinity with its similar ones is positive.

    Patches may be missing: no part holds them. A seed that is not among the positive ones (its features are all 0) is a part of its own.
    An image's products stay in its kernel. With `images` (image_id, h, w), boxes are clipped to them. `grids` as in `masks.with_side`.
    """

    def mask(pdf):
        side = int(pdf["side"].iloc[0])
        pdf.sort_values("patch", inplace=True)
        f = np.stack(pdf["k"].to_list()).astype(np.float64)
        place = pdf["patch"].to_numpy()
        a = f @ f.T
        alike = (a > 0).sum(axis=1) - (np.diag(a) > 0)
        potentials = np.argsort(alike, kind="stable")[:k]
        seed = int(potentials[0])
        similar = potentials[a[seed, potentials] > 0]
        m = np.zeros((int(place[-1]) // side + 1, side), bool)
        at = divmod(int(place[seed]), side)
        on = place[a[similar].sum(axis=0) > 0]
        m[on // side, on % side] = True
        if not m[at]:
            m[:] = False
            m[at] = True
        return m, at

    run = _component_box(mask, 1 if images is not None else scale, False)
    found = masks.with_side(features.select("image_id", "patch", "k"), side, grids).groupBy("image_id").applyInPandas(run, BOX)
    return found if images is None else masks.to_image(found, images, scale=scale)


def attention_box(attention: DataFrame, keep: float = 0.6, scale: int = 16, compat: bool = False) -> DataFrame:
    """Box of the largest 4-connected part of the patches that hold most attention.

    `compat` leaves the last part (in raster order) out of the choice, and takes the cells outside all parts where there is but one.
    """

    def mask(pdf):
        m = np.zeros((pdf["r"].max() + 1, pdf["c"].max() + 1), bool)
        m[pdf["r"], pdf["c"]] = pdf["on"]
        if compat:
            comp = masks.label_components(np.where(m, 1, -1), False)
            ids, n = np.unique(comp[comp >= 0], return_counts=True)
            m = comp == ids[n[:-1].argmax()] if len(ids) > 1 else ~m
        return m, None

    # what lies outside all parts is one box, connected or not
    box = _cells_box(mask, scale) if compat else _component_box(mask, scale, False)
    return graph.attention_mask(attention, keep).groupBy("image_id").applyInPandas(box, BOX)


def _cells_box(pdf_to_mask: Callable, scale: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = np.nonzero(pdf_to_mask(pdf)[0])
        box = (c.min() * scale, r.min() * scale, (c.max() + 1) * scale, (r.max() + 1) * scale) if len(r) else (None,) * 4
        return pd.DataFrame([[pdf["image_id"].iloc[0], *box]], columns=["image_id", "x1", "y1", "x2", "y2"])

    return run

"""Gram matrices of patches as tables of dense tiles, and what is computed on them: no row per pair.

A block is up to `size` patches of one image, its features one packed row; a tile holds the products of two blocks. Tiles of block pairs with bi <= bj are
kept, the others follow by symmetry. Degrees, maxima, scores and sums leave a tile as one array; only `edges` makes rows of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE = 256


def _kind(df: DataFrame) -> str:
    return df.schema["image_id"].dataType.simpleString()


def _matrix(x: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(x, np.float64).reshape(rows, -1)


def blocks(features: DataFrame, size: int = SIZE) -> DataFrame:
    """image_id, b, n, patches, f: patches (image_id, patch, k) by size to a row, in order of patch; patch numbers and features, end to end."""
    own = features.select("image_id", F.floor(F.col("patch") / size).cast("long").alias("b"), F.struct(F.col("patch").cast("long").alias("patch"), F.transform("k", lambda x: x.cast("double")).alias("k")).alias("p"))
    sorted_ = own.groupBy("image_id", "b").agg(F.array_sort(F.collect_list("p")).alias("p"))  # at most `size` patches
    return sorted_.select("image_id", "b", F.size("p").cast("long").alias("n"), F.col("p.patch").alias("patches"), F.flatten("p.k").alias("f"))


def gram(features: DataFrame, size: int = SIZE) -> DataFrame:
    """Tiles: image_id, bi, bj (bi <= bj), n, m, pi, pj (packed patch numbers), w (n x m products, packed)."""
    own = blocks(features, size)
    a = own.select("image_id", F.col("b").alias("bi"), "n", F.col("patches").alias("pi"), F.col("f").alias("x"))
    b = own.select(F.col("image_id").alias("other"), F.col("b").alias("bj"), F.col("n").alias("m"), F.col("patches").alias("pj"), F.col("f").alias("y"))
    met = a.join(b, (F.col("image_id") == F.col("other")) & (F.col("bi") <= F.col("bj"))).drop("other")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            w = [(x.reshape(n, -1) @ y.reshape(m, -1).T).tobytes() for x, y, n, m in zip(pdf["x"], pdf["y"], pdf["n"], pdf["m"])]
            pi, pj = ([np.asarray(p, np.int64).tobytes() for p in pdf[c]] for c in ("pi", "pj"))
            yield pdf[["image_id", "bi", "bj", "n", "m"]].assign(pi=pi, pj=pj, w=w)

    return met.mapInPandas(run, f"image_id {_kind(features)}, bi long, bj long, n long, m long, pi binary, pj binary, w binary")


def threshold(tiles: DataFrame) -> DataFrame:
    """Products below 0 become 0."""

    def run(frames):
        for pdf in frames:
            yield pdf.assign(w=[np.maximum(np.frombuffer(x, np.float64), 0.0).tobytes() for x in pdf["w"]])

    return tiles.mapInPandas(run, tiles.schema)


def scale_by_max(tiles: DataFrame) -> DataFrame:
    """Products over the image's largest: each tile gives its maximum, and takes its image's."""

    def most(frames):
        for pdf in frames:
            yield pd.DataFrame({"image_id": pdf["image_id"], "top": [np.frombuffer(x, np.float64).max() for x in pdf["w"]]})

    top = tiles.select("image_id", "w").mapInPandas(most, f"image_id {_kind(tiles)}, top double").groupBy("image_id").agg(F.max("top").alias("top"))

    def run(frames):
        for pdf in frames:
            yield pdf.assign(w=[(np.frombuffer(x, np.float64) / t).tobytes() for x, t in zip(pdf["w"], pdf["top"])]).drop(columns="top")

    return tiles.join(top, "image_id").mapInPandas(run, tiles.schema)


def _sides(make: Callable) -> Callable:
    """A function of frames of tiles that gives, for each frame, one frame of what `make` yields: dicts of arrays, for each tile's row, products and patch
    numbers of rows and columns, and for the mirrored ones unless the tile lies on the diagonal. A frame is bounded by Arrow's batch of tiles.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found: list[dict] = []
            for row in pdf.itertuples(index=False):
                w, pi, pj = _matrix(row.w, row.n), np.frombuffer(row.pi, np.int64), np.frombuffer(row.pj, np.int64)
                for m, i, j in ((w, pi, pj),) if row.bi == row.bj else ((w, pi, pj), (w.T, pj, pi)):
                    for columns in make(row, m, i, j):
                        size = len(next(iter(columns.values())))
                        found.append({"image_id": np.full(size, row.image_id)} | columns)
                if sum(len(f["image_id"]) for f in found) > 1 << 18:
                    yield pd.DataFrame({c: np.concatenate([f[c] for f in found]) for c in found[0]})
                    found = []
            if found:
                yield pd.DataFrame({c: np.concatenate([f[c] for f in found]) for c in found[0]})

    return run


def _by_patch(tiles: DataFrame, measure: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """image_id, i, x: a number for each patch and tile, of the rows of tiles and of their mirrored ones; `measure` takes a tile and its patch numbers."""

    def own(_, w, i, j):
        yield {"i": i, "x": measure(w, i, j).astype(np.float64)}

    return tiles.mapInPandas(_sides(own), f"image_id {_kind(tiles)}, i long, x double")


def degree(tiles: DataFrame, least: float = 1e-12) -> DataFrame:
    """image_id, i, degree: the sum of each patch's row, 1 where it is below `least`."""
    d = F.sum("x")
    return _by_patch(tiles, lambda w, pi, pj: w.sum(axis=1)).groupBy("image_id", "i").agg(F.when(d < least, 1.0).otherwise(d).alias("degree"))


def patch_scoring(tiles: DataFrame) -> DataFrame:
    """Minus the number of other patches a patch is similar to."""
    count = _by_patch(tiles, lambda w, pi, pj: ((w > 0) & (pi[:, None] != pj[None])).sum(axis=1))
    return count.groupBy("image_id", "i").agg((-F.sum("x")).cast("long").alias("score"))


def similarity_sum(tiles: DataFrame, k: int = 100) -> DataFrame:
    """Sum, for each patch j, of its products with the patches that are similar to the seed: image_id, j, m.

    The seed is the patch of fewest similar ones; of the k patches of fewest similar ones those with a positive product with it count.
    Scores are a row a patch; the seed's row and the similar patches (k at most) travel to the image's tiles.
    """
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), "i")
    ranked = patch_scoring(tiles).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    chosen = ranked.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "i"))), lambda s: s["i"]).alias("potentials"))
    kind = _kind(tiles)

    def seed_row(row, w, i, j):
        at = np.flatnonzero(i == row.potentials[0])
        if len(at):
            yield {"i": j[(w[at[0]] > 0) & np.isin(j, row.potentials)]}

    similar = tiles.join(chosen, "image_id").mapInPandas(_sides(seed_row), f"image_id {kind}, i long")
    similar = similar.groupBy("image_id").agg(F.array_sort(F.collect_list("i")).alias("similar"))

    def sums(row, w, i, j):
        own = np.isin(i, row.similar)
        if own.any():
            yield {"j": j, "x": w[own].sum(axis=0)}

    return tiles.join(similar, "image_id").mapInPandas(_sides(sums), f"image_id {kind}, j long, x double").groupBy("image_id", "j").agg(F.sum("x").alias("m"))


def edges(tiles: DataFrame) -> DataFrame:
    """image_id, i, j, w of every pair, both directions: a row a pair, for those who ask for it."""

    def pairs(_, w, i, j):
        yield {"i": np.repeat(i, len(j)), "j": np.tile(j, len(i)), "w": w.ravel()}

    return tiles.mapInPandas(_sides(pairs), f"image_id {_kind(tiles)}, i long, j long, w double")

"""Patch affinity graphs by image, as edge tables (image_id, i, j, w)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspectra.functions.vectors import dot

from . import neighbours


def gram(features: DataFrame) -> DataFrame:
    """Inner products of all patch pairs of an image. Half is computed; pairs of patches stay within their image."""
    a = features.select("image_id", F.col("patch").alias("i"), F.col("k").alias("x"))
    b = features.select(F.col("image_id").alias("other"), F.col("patch").alias("j"), F.col("k").alias("y"))
    half = a.join(b, (F.col("image_id") == F.col("other")) & (F.col("i") <= F.col("j"))).select("image_id", "i", "j", dot("x", "y").alias("w"))
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return half.select("image_id", F.explode(both).alias("e"), "w").select("image_id", "e.i", "e.j", "w")


def threshold(edges: DataFrame) -> DataFrame:
    return edges.withColumn("w", F.greatest("w", F.lit(0.0)))


def scale_by_max(edges: DataFrame) -> DataFrame:
    top = F.max("w").over(Window.partitionBy("image_id"))
    return edges.withColumn("w", F.col("w") / top)


def degree(edges: DataFrame, least: float = 1e-12) -> DataFrame:
    d = F.sum("w")
    return edges.groupBy("image_id", "i").agg(F.when(d < least, 1.0).otherwise(d).alias("degree"))


def knn_edges(patches: DataFrame, k: int = 20, weight: float = 2.0, colors: tuple[str, ...] = ("e1", "e2", "e3"), side: int = 10) -> DataFrame:
    """Directed edges to the k nearest patches by color and weighted place in [0, 1], itself included; ties go to the smaller patch.

    An image is one group, searched by a k-d tree; nothing of the size of its pairs is made.
    """
    place = [(weight * F.col(a) / float(side - 1)) for a in ("c", "r")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x, name = np.stack(pdf["x"].to_list()), pdf["i"].to_numpy()
        near = neighbours.nearest(x, k)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "i": np.repeat(name, near.shape[1]), "j": name[near.ravel()]})

    own = patches.select("image_id", F.col("patch").alias("i"), F.array(*colors, *place).alias("x"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    return own.groupBy("image_id").applyInPandas(run, f"image_id {kinds['image_id']}, i {kinds['i']}, j {kinds['i']}")


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions as a bag: w counts how often an edge occurs."""
    return edges.select("image_id", "i", "j").unionAll(edges.select("image_id", F.col("j").alias("i"), F.col("i").alias("j"))).groupBy("image_id", "i", "j").agg(F.count("*").alias("w"))


def knn_affinity(patches: DataFrame, passes: tuple[tuple[int, float], ...] = ((20, 2.0), (10, 0.1))) -> DataFrame:
    edges = None
    for k, weight in passes:
        one = knn_edges(patches, k, weight)
        edges = one if edges is None else edges.unionAll(one)
    return symmetrize(edges)


def window_affinity(patches: DataFrame, sigma: float = 0.033, radius: int = 1) -> DataFrame:
    """exp(-|color difference|^2 / sigma^2) between cells at most `radius` apart, themselves included.

    A cell names its neighbours' places, so the join is by place: (2 * radius + 1)^2 rows a cell, not all pairs of an image.
    """
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    a = patches.select("image_id", F.col("patch").alias("i"), "r", "c", F.array("e1", "e2", "e3").alias("x"))
    near = a.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps)).select("image_id", "i", "x", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"))
    d = F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return near.join(a.select("image_id", F.col("i").alias("j"), "r", "c", F.col("x").alias("y")), ["image_id", "r", "c"]).select("image_id", "i", "j", F.exp(-d / (sigma * sigma)).alias("w"))


def patch_scoring(edges: DataFrame) -> DataFrame:
    """Minus the number of other patches a patch is similar to."""
    return edges.groupBy("image_id", "i").agg((-F.count_if((F.col("w") > 0) & (F.col("i") != F.col("j")))).alias("score"))


def seed_and_similar(edges: DataFrame, k: int = 100) -> DataFrame:
    """image_id, i, rank, seed of the patches of fewest similar ones that are similar to the first of them."""
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), "i")
    ranked = patch_scoring(edges).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    seeds = ranked.where("rank = 1").select(F.col("image_id").alias("seed_image"), F.col("i").alias("seed"))
    at_seed = (F.col("image_id") == F.col("seed_image")) & (F.col("i") == F.col("seed"))
    like = edges.where("w > 0").join(seeds, at_seed).select("image_id", F.col("j").alias("i"), "seed")
    return ranked.join(like, ["image_id", "i"]).select("image_id", "i", "rank", "seed")


def similarity_sum(edges: DataFrame, k: int = 100) -> DataFrame:
    """Sum, for each patch, of its affinity with the seed's similar patches."""
    similar = seed_and_similar(edges, k).select("image_id", "i")
    return edges.join(similar, ["image_id", "i"], "left_semi").groupBy("image_id", "j").agg(F.sum("w").alias("m"))


def attention_mask(attention: DataFrame, keep: float = 0.6) -> DataFrame:
    """Patches that hold the upper `keep` of an image's attention mass."""
    every = Window.partitionBy("image_id")
    upto = every.orderBy("w", "patch").rowsBetween(Window.unboundedPreceding, 0)
    return attention.withColumn("on", F.sum("w").over(upto) / F.sum("w").over(every) > 1 - keep)


def eigengap_clusters(eigen: DataFrame) -> DataFrame:
    """One more than the place of the largest gap of consecutive eigenvalues, the first gap left out."""
    order = Window.partitionBy("image_id").orderBy("k")
    gaps = eigen.select("image_id", "k", (F.lead("eigenvalue").over(order) - F.col("eigenvalue")).alias("gap")).where("k > 0 and gap is not null")
    first = Window.partitionBy("image_id").orderBy(F.desc("gap"), "k")
    return gaps.withColumn("rank", F.row_number().over(first)).where("rank = 1").select("image_id", (F.col("k") + 1).alias("n_clusters"))

"""Whole runs as one call each: extraction, localization, and the two evaluations. Each is one plan over tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import astuple, dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspectra.functions import boxes as B
from gridspectra.operators import cluster, masks, metrics, spectral
from gridspectra.sources.tables import discard, stored


def extract(features: DataFrame, n_vectors: int = 5, n_regions: int = 4, n_clusters: int = 20, n_erode: int = 2, n_dilate: int = 3, side: int = 10, offset: int = 1, baseline: bool = False, adaptive: bool = False) -> dict[str, DataFrame]:
    """Patch features (image_id, patch, r, c, k) to eigenvectors, regions, boxes (in patches), box features, clusters and semantic maps, by name."""
    eigens = spectral.eigen(features, "laplacian", n_vectors)
    regions = cluster.baseline_regions(features, n_regions, side) if baseline else cluster.multi_region(eigens, n_regions, adaptive, side=side)
    found = masks.boxes(regions, n_erode, n_dilate)
    inside = cluster.box_features(found, features)
    clusters = cluster.box_clusters(inside, n_clusters)
    # a region whose box holds no patch has no cluster and counts as background
    known = regions.select("image_id", "label").distinct().where("label <> 0").join(clusters, ["image_id", "label"], "left").fillna(-offset, ["cluster"])
    return {"eigens": eigens, "regions": regions, "boxes": found, "features": inside, "clusters": clusters, "maps": cluster.semantic_maps(regions, known, offset)}


@dataclass(frozen=True)
class Extraction:
    """What `extract_to` computes; a table made under other values is not taken up."""

    n_vectors: int = 5
    n_regions: int = 4
    n_clusters: int = 20
    n_erode: int = 2
    n_dilate: int = 3
    side: int = 10
    offset: int = 1
    baseline: bool = False
    adaptive: bool = False

    def name(self) -> str:
        return sha256(repr(astuple(self)).encode()).hexdigest()[:16]


class Stages:
    """Tables of stages below a folder, an image at a time: each has a manifest of (image_id, run), which is written after the rows of the run.

    Rows of a run that its manifest does not name, of a job that was lost, are never read. So a stage holds each image once whatever was interrupted.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def done(self, name: str, keys: DataFrame) -> DataFrame:
        """image_id, run of the images that the stage holds; if a job wrote an image twice, its first run counts."""
        path = f"{self.path}/{name}/manifest"
        if not self._exists(path):
            return keys.select("image_id", F.lit("").alias("run")).limit(0)
        return self.spark.read.parquet(path).groupBy("image_id").agg(F.min("run").alias("run"))

    def add(self, name: str, keys: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Rows of the stage for `keys` (image_id): `make` is called with those the stage does not hold, if there are any, and its rows are kept.

        An image without rows is held too.
        """
        missing = keys.join(self.done(name, keys), "image_id", "left_anti")
        if missing.limit(1).count():
            run = uuid.uuid4().hex
            missing = stored(missing)
            make(missing).withColumn("run", F.lit(run)).write.mode("append").parquet(f"{self.path}/{name}/rows")
            missing.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{self.path}/{name}/manifest")
            discard(missing)
        held = self.done(name, keys).join(keys, "image_id", "left_semi")
        return self.spark.read.parquet(f"{self.path}/{name}/rows").join(held, ["image_id", "run"], "left_semi").drop("run")


def extract_to(features: DataFrame, path: str, config: Extraction | None = None) -> dict[str, DataFrame]:
    """`extract`, stage by stage into tables below `path`: eigens, regions, boxes, features, clusters and maps, by name.

    A second call, after a lost job or with more images, computes for each stage only the images that it does not hold, so an image's eigenvectors are
    found once. Boxes are clustered over all images, so clusters (and maps) are kept for one set of images and found anew for another. An empty table of features gives an error.
    """
    config = config or Extraction()
    spark = features.sparkSession
    keys = stored(features.select("image_id").distinct())
    if not keys.limit(1).count():
        raise ValueError("no images to extract")
    stages = Stages(spark, f"{path.rstrip('/')}/{config.name()}")
    of = lambda table, missing: table.join(missing, "image_id", "left_semi")
    eigens = stages.add("eigens", keys, lambda m: spectral.eigen(of(features, m), "laplacian", config.n_vectors))

    def regions_of(m):
        if config.baseline:
            return cluster.baseline_regions(of(features, m), config.n_regions, config.side)
        return cluster.multi_region(of(eigens, m), config.n_regions, config.adaptive, side=config.side)

    regions = stages.add("regions", keys, regions_of)
    found = stages.add("boxes", keys, lambda m: masks.boxes(of(regions, m), config.n_erode, config.n_dilate))
    inside = stages.add("features", keys, lambda m: cluster.box_features(of(found, m), of(features, m)))
    # one number for the set of images: a sum does not ask for an order
    several = keys.agg(F.count("*").alias("n"), F.sum(F.xxhash64("image_id").cast("decimal(38,0)")).alias("h")).first()
    together = f"clusters-{several['n']}-{several['h']}"
    clusters = stages.add(together, keys, lambda m: cluster.box_clusters(of(inside, keys), config.n_clusters))
    known = regions.select("image_id", "label").distinct().where("label <> 0").join(clusters, ["image_id", "label"], "left").fillna(-config.offset, ["cluster"])
    maps = stages.add(f"maps-{together}", keys, lambda m: of(cluster.semantic_maps(regions, known, config.offset), m))
    return {"eigens": eigens, "regions": regions, "boxes": found, "features": inside, "clusters": clusters, "maps": maps}


#: Which eigenvector of a matrix tells the object from the ground, counted from 0.
OBJECT_VECTOR = {"laplacian": 1, "matting_laplacian": 1, "affinity": 0}


def localize(features: DataFrame | None, truth: DataFrame, images: DataFrame, method: str = "lost", k: int = 100, side: int = 10, scale: int = 16, which: str = "laplacian", eigens: DataFrame | None = None, attention: DataFrame | None = None, keep: float = 0.6, no_hard: bool = True, grids: DataFrame | None = None) -> DataFrame:
    """One box an image against its true boxes (image_id, x1, y1, x2, y2): image_id, x1, y1, x2, y2, iou (the best), hit.

    method: lost; eigen (the cells above 0 of the vector of `which` in OBJECT_VECTOR, taken from the stored table `eigens` where that is given, found from `features`
    otherwise); or attention (the cells that hold most of `attention`, image_id, patch, r, c, w). Boxes are clipped to `images` (image_id, h, w);
    `grids` (image_id, w) gives the patches in a row of images that have not `side`.
    Images without true boxes are left out with `no_hard`; otherwise they count as misses of overlap 0.
    """
    if method == "lost":
        found = spectral.lost_box(features, k, scale, side, images, grids)
    elif method == "eigen":
        if which not in OBJECT_VECTOR:
            raise ValueError(f"no such matrix: {which}")
        at = OBJECT_VECTOR[which]
        cells = spectral.single_region(spectral.eigen(features, which, at + 1) if eigens is None else eigens, k=at, side=side, grids=grids)
        found = masks.to_image(spectral.mask_box(cells, 1), images, scale=scale)
    elif method == "attention":
        if attention is None:
            raise ValueError("the method attention needs a table of attention")
        found = masks.to_image(spectral.attention_box(attention, keep, 1), images, scale=scale)
    else:
        raise ValueError(f"no such method: {method}")
    true = truth.select("image_id", *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    each = found.join(true, "image_id", "inner" if no_hard else "left").withColumn("overlap", B.iou(B.columns(), B.columns("g_")))
    best = each.groupBy("image_id", "x1", "y1", "x2", "y2").agg(F.coalesce(F.max("overlap"), F.lit(0.0)).alias("iou"))
    return best.withColumn("hit", F.col("iou") >= 0.5)


def corloc(located: DataFrame) -> DataFrame:
    """Percent of images that are hit, and their number."""
    return located.agg((100 * F.avg(F.col("hit").cast("double"))).alias("corloc"), F.count("*").alias("images"))


def evaluate_objects(preds: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Mean accuracy and IoU over the images of each data set, from binary maps (keys, image_id, r, c, pred) and (keys, image_id, r, c, target).

    Predictions may be 0 and 1 or 0 and 255; other values are an error. Cells without a prediction count as background.
    """
    value = F.when(F.col("pred").isin(1, 255), True).when(F.coalesce(F.col("pred"), F.lit(0)) == 0, False).otherwise(F.raise_error(F.lit("a prediction is neither 0, 1 nor 255")).cast("boolean"))
    met = targets.join(preds, [*keys, "image_id", "r", "c"], "left").select(*keys, "image_id", value.alias("pred"), F.col("target").cast("boolean").alias("target"))
    same = F.avg((F.col("pred") == F.col("target")).cast("double"))
    each = met.groupBy(*keys, "image_id").agg(same.alias("acc"), metrics.ratio(F.count_if(F.col("pred") & F.col("target")), F.count_if(F.col("pred") | F.col("target"))).alias("iou"))
    return each.groupBy(*keys).agg(F.avg("acc").alias("acc"), F.avg("iou").alias("iou"), F.count("*").alias("images"))


def evaluate_semantic(preds: DataFrame, targets: DataFrame, n: int, match: str | None = "majority") -> DataFrame:
    """Per class tp, fp, fn, jaccard and, on every row, their mean miou, from label maps (image_id, r, c, pred) and (image_id, r, c, target).

    match: majority, hungarian, or None where predictions are classes already. Pixels are joined once and then only counted.
    """
    counts = metrics.contingency(metrics.valid(targets.join(preds, ["image_id", "r", "c"])))
    if match:
        ious = metrics.pair_iou(counts, n, n)
        matching = metrics.majority_match(ious) if match == "majority" else metrics.hungarian_match(ious, n)
        counts = metrics.remap(counts, matching).groupBy("pred", "target").agg(F.sum("n").alias("n"))
    each = metrics.class_jaccard(counts, n)
    return each.join(each.agg(F.avg("jaccard").alias("miou")), F.lit(True))


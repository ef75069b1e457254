"""Clustering: eigenvectors within an image, boxes over the data set."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspectra.functions.vectors import normalize
from gridspectra.sources.tables import discard, stored

from . import masks


#: Starts of k-means beside the farthest-point one; rows of a batch of mini-batch k-means; steps between looks for starved centres; batches that a task holds.
RESTARTS, BATCH, LOOK, SPAN = 9, 4096, 10, 16


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances (points x centres), without an array over the dimensions."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ centers.T) + (centers * centers).sum(axis=1)[None], 0.0)


def farthest(x: np.ndarray, k: int) -> np.ndarray:
    """Places of k seeds: the point of largest norm, then always the one farthest from those chosen."""
    seeds = [int((x * x).sum(axis=1).argmax())]
    far = ((x - x[seeds[0]]) ** 2).sum(axis=1)
    while len(seeds) < k:
        seeds.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[seeds[-1]]) ** 2).sum(axis=1))
    return np.array(seeds)


def drawn(x: np.ndarray, k: int, turn: np.random.Generator) -> np.ndarray:
    """Places of k seeds drawn by k-means++: each with a probability in proportion to its squared distance from those before."""
    seeds = [int(turn.integers(len(x)))]
    far = ((x - x[seeds[0]]) ** 2).sum(axis=1)
    while len(seeds) < k:
        total = far.sum()
        seeds.append(int(np.searchsorted(np.cumsum(far), turn.random() * total, side="right").clip(0, len(x) - 1)) if total > 0 else int(turn.integers(len(x))))
        far = np.minimum(far, ((x - x[seeds[-1]]) ** 2).sum(axis=1))
    return np.array(seeds)


def descend(x: np.ndarray, centers: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Labels and inertia where Lloyd's steps from `centers` end; a centre without points stays where it is."""
    label = np.full(len(x), -1)
    for _ in range(rounds):
        new = distances(x, centers).argmin(axis=1)
        if (new == label).all():
            break
        label = new
        count = np.bincount(label, minlength=len(centers))
        sums = np.stack([np.bincount(label, x[:, d], minlength=len(centers)) for d in range(x.shape[1])], axis=1)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return label, float(((x - centers[label]) ** 2).sum())


def lloyd(x: np.ndarray, k: int, rounds: int = 300, restarts: int = RESTARTS, seed: int = 0) -> np.ndarray:
    """Labels of k-means: the least inertia of one farthest-point start and `restarts` drawn by k-means++ from `seed`; ties go to the earlier start."""
    k = min(k, len(x))
    turn = np.random.default_rng(seed)
    starts = [farthest(x, k)] + [drawn(x, k, turn) for _ in range(restarts)]
    return min((descend(x, x[s].copy(), rounds) for s in starts), key=lambda found: found[1])[0]


def multi_region(eigens: DataFrame, n: int = 4, adaptive: bool = False, vectors: int | None = None, side: int = 10, infer_background: bool = True, grids: DataFrame | None = None) -> DataFrame:
    """Label map of k-means over the eigenvectors after the first; `adaptive` takes n from the largest eigengap. `grids` as in `masks.with_side`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        m = n
        if adaptive:
            if len(pdf) < 3:
                raise ValueError("an eigengap needs three eigenvalues")
            m = int(np.diff(pdf["eigenvalue"])[1:].argmax()) + 2
        v = np.stack(pdf["eigenvector"].to_list()[1:][:vectors]).T
        label = lloyd(v, m)
        i, side = np.arange(len(label)), int(pdf["side"].iloc[0])
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "r": (i // side).astype(np.int32), "c": (i % side).astype(np.int32), "label": label.astype(np.int32)})

    cells = masks.with_side(eigens.select("image_id", "k", "eigenvalue", "eigenvector"), side, grids).groupBy("image_id").applyInPandas(run, "image_id int, r int, c int, label int")
    return masks.background_first(cells) if infer_background else cells


def baseline_regions(features: DataFrame, n: int = 4, side: int = 10, infer_background: bool = True, grids: DataFrame | None = None) -> DataFrame:
    """Label map of k-means over the patch features themselves, in place of eigenvectors. `grids` as in `masks.with_side`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("patch")
        label = lloyd(np.stack(pdf["k"].to_list()), n)
        i, side = np.arange(len(label)), int(pdf["side"].iloc[0])
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "r": (i // side).astype(np.int32), "c": (i % side).astype(np.int32), "label": label.astype(np.int32)})

    cells = masks.with_side(features.select("image_id", "patch", "k"), side, grids).groupBy("image_id").applyInPandas(run, "image_id int, r int, c int, label int")
    return masks.background_first(cells) if infer_background else cells


def box_features(boxes: DataFrame, patches: DataFrame) -> DataFrame:
    """Mean patch feature inside each box (in patch units): stands in for running a model on crops."""
    inside = (F.col("c") >= F.col("xmin")) & (F.col("c") < F.col("xmax")) & (F.col("r") >= F.col("ymin")) & (F.col("r") < F.col("ymax"))
    met = boxes.join(patches.select("image_id", "r", "c", "k"), "image_id").where(inside)  # vectors are taken apart after the join
    means = met.select("image_id", "label", F.posexplode("k").alias("d", "x")).groupBy("image_id", "label", "d").agg(F.avg("x").alias("x"))
    return means.groupBy("image_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("features"))


def pca(features: DataFrame, k: int) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = features.withColumn("v", array_to_vector("features"))
    return PCA(k=k, inputCol="v", outputCol="p").fit(v).transform(v).withColumn("features", vector_to_array("p")).drop("v", "p")


def absorb(centers: np.ndarray, seen: np.ndarray, count: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and how many points they have seen after a batch of which `count` points with `sums` were theirs: each moves by its share of all it has seen."""
    after = seen + count
    rate = np.where(count > 0, count / np.maximum(after, 1), 0.0)[:, None]
    return centers + rate * (sums / np.maximum(count, 1)[:, None] - centers), after


def starved(seen: np.ndarray, ratio: float) -> np.ndarray:
    """Places of centres that have seen less than `ratio` of what the busiest has, at most half of all, the least first."""
    order = np.argsort(seen, kind="stable")
    return order[: len(seen) // 2][seen[order[: len(seen) // 2]] < ratio * seen.max()]


@dataclass
class Descent:
    """Where mini-batch k-means stands: centres, how many points each has seen, steps done, and what tells its end."""

    centers: np.ndarray
    seen: np.ndarray
    step: int = 0
    smooth: float | None = None
    best: float = np.inf
    stale: int = 0

    def take(self, x: np.ndarray, share: float, ratio: float) -> None:
        """A step over the rows of a batch; `share` is what its inertia counts in the smoothed one. Without rows only the step is counted."""
        self.step += 1
        if not len(x):
            return
        n = len(self.centers)
        d = distances(x, self.centers)
        label = d.argmin(axis=1)
        gap = d[np.arange(len(x)), label]
        self.centers, self.seen = absorb(self.centers, self.seen, np.bincount(label, minlength=n), (label[None] == np.arange(n)[:, None]).astype(np.float64) @ x)
        if self.step % LOOK == 0:
            poor = starved(self.seen, ratio)
            for c, p in zip(poor, outermost(x, gap, len(poor))):
                self.centers[c] = p
                self.seen[c] = self.seen[np.setdiff1d(np.arange(n), poor)].min()
        inertia = float(gap.mean())
        self.smooth = inertia if self.smooth is None else self.smooth * (1 - share) + inertia * share
        self.best, self.stale = (self.smooth, 0) if self.smooth < self.best - 1e-12 else (self.best, self.stale + 1)


def outermost(x: np.ndarray, gap: np.ndarray, k: int) -> list[list[float]]:
    """The k points of largest gap, equal gaps in order of the points."""
    if not k:
        return []
    at = np.flatnonzero(gap >= np.partition(gap, -min(k, len(gap)))[-min(k, len(gap))])
    return [p for _, p in sorted(zip((-gap[at]).tolist(), x[at].tolist()))[:k]]


def minibatch(points: DataFrame, key: list[str], n: int, seed: int = 0, batch: int = BATCH, steps: int = 5000, patience: int = 10, ratio: float = 0.01) -> np.ndarray:
    """Centres of mini-batch k-means over `points` (key columns, features).

    Rows are dealt to batches of about `batch` by a hash of key and seed, and stored by batch. Each step needs the centres of the one before, so steps follow one another:
    a task reads the batches of the next SPAN steps, no more, and takes these steps; where the table has no more batches than that, it goes on to the end. So a table
    costs a job for SPAN steps, and one job if it is small. The seeds are drawn by k-means++ from the first batch (a bounded sample). Every LOOK steps starved
    centres move to the points of the batch that are farthest from any. Ends after `steps`, or when the smoothed inertia of a point has not fallen for `patience`
    steps after one pass. Without rows there are no centres.
    """
    count = points.count()
    if not count:
        return np.zeros((0, 0))
    batches = -(-count // batch)
    number = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(batches)).cast("int")
    dealt = stored(points.select(*key, "features", number.alias("batch")).repartition("batch").sortWithinPartitions("batch", *key), "batch")
    first = dealt.where(F.col("batch") == dealt.agg(F.min("batch")).first()[0]).orderBy(*key).limit(4 * batch).select("features").collect()  # a batch
    x = np.array([r["features"] for r in first], np.float64)
    n = min(n, len(x))
    now = Descent(x[drawn(x, n, np.random.default_rng(seed))].copy(), np.zeros(n))
    share = min(1.0, 2 * batch / (count + 1))
    ended = lambda at: at.step >= steps or (at.step >= batches and at.stale >= patience)
    while not ended(now):
        span = [(now.step + i) % batches for i in range(min(SPAN, batches, steps - now.step))]
        few = dealt.where(F.col("batch").isin(span)).select("batch", "features").coalesce(1)  # SPAN batches at most
        got = few.mapInPandas(_descended(now, span, len(span) == batches, share, ratio, ended), "centers array<array<double>>, seen array<double>, step int, smooth double, best double, stale int").first()
        now = Descent(np.array(got["centers"]), np.array(got["seen"]), *(got[c] for c in ("step", "smooth", "best", "stale")))
    discard(dealt)
    return now.centers


def _descended(now: Descent, span: list[int], whole: bool, share: float, ratio: float, ended: Callable[[Descent], bool]):
    """From rows (batch, features) of the batches `span`: where the steps over them lead, a row; if they are the `whole` table, the steps to the end."""

    def run(frames):
        held: dict[int, list] = {b: [] for b in span}
        for pdf in frames:
            for b, own in pdf.groupby("batch"):
                held[int(b)].append(np.stack(own["features"].to_list()).astype(np.float64))
        rows = {b: np.concatenate(parts) if parts else np.zeros((0, now.centers.shape[1])) for b, parts in held.items()}
        at = replace(now)
        last = at.step + len(span)
        while not ended(at) and (whole or at.step < last):
            at.take(rows[span[(at.step - now.step) % len(span)]], share, ratio)
        yield pd.DataFrame({"centers": [at.centers.tolist()], "seen": [at.seen.tolist()], "step": [at.step], "smooth": [at.smooth], "best": [at.best], "stale": [at.stale]})

    return run


def nearest(points: DataFrame, centers: np.ndarray, key: list[str]) -> DataFrame:
    """Key columns and cluster, the nearest centre of each row of `points` (key columns, features), ties to the first."""

    def run(frames):
        for pdf in frames:
            x = np.stack(pdf["features"].to_list()).astype(np.float64) if len(pdf) else np.zeros((0, centers.shape[1]))
            yield pdf[key].assign(cluster=distances(x, centers).argmin(axis=1).astype(np.int32) if len(pdf) else np.zeros(0, np.int32))

    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in key)
    return points.select(*key, "features").mapInPandas(run, f"{kinds}, cluster int")


def box_clusters(features: DataFrame, n: int = 20, seed: int = 0, pca_dim: int = 0, batch: int = BATCH) -> DataFrame:
    """image_id, label, cluster of each box, by mini-batch k-means over normalized features (after PCA to `pca_dim` dimensions, if given).

    The centres are found where this is called, for the rows that `features` has then; these are stored once. No boxes give no rows.
    """
    own = features.select("image_id", "label", normalize("features").alias("features"))
    own = stored(pca(own, pca_dim).select("image_id", "label", "features") if pca_dim else own)
    return nearest(own, minibatch(own, ["image_id", "label"], n, seed, batch), ["image_id", "label"])


def semantic_maps(cells: DataFrame, clusters: DataFrame, offset: int = 0) -> DataFrame:
    """Segment labels replaced by their boxes' clusters; the background stays 0 (cluster 0 merges with it unless offset = 1)."""
    return masks.relabel(masks.binarize_255(cells), clusters, offset)


def class_order(names: DataFrame) -> DataFrame:
    """Distinct names in the order of their first place."""
    first = names.groupBy("name").agg(F.min("place").alias("place"))
    return first.select("name", (F.row_number().over(Window.orderBy("place")) - 1).alias("class_id"))

"""Quality classifier: Naive Bayes support vectors.

Texts become indicators of hashed n-grams: words and word pairs, the shapes of words (kinds of first
and last characters) and pairs of shapes, and the share of repeated 3-word windows. Indicators are scaled by the log ratio
of their smoothed frequencies in the two classes, a linear hinge-loss model is fitted to them by dual
coordinate descent, and a logistic curve over rows left out of the fit turns margins into scores.

The model is fitted on the FIT_DOCS labelled documents of smallest hashed id, or as many of them as have FIT_FOUND indicators together,
a documented bound; every whole text is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ragged import LOWER, M1, M2, M3, buffers, mix, slices, word_hashes, words
from .shared import fresh, released, table, written

FIT_DOCS, FIT_FOUND, BITS, SMOOTHING, COST, EPOCHS, SEED = 8192, 1 << 25, 19, 1.0, 1.0, 12, 5
THRESHOLD, HELD_OUT = 0.3, 5

_KIND = np.arange(256, dtype=np.uint64)
_KIND[[*range(0x61, 0x7B)]] = 1
_KIND[[*range(0x41, 0x5B)]] = 2
_KIND[[*range(0x30, 0x3A)]] = 3
_KIND[0x80:] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashed indicators of a batch of texts, distinct and sorted by row; each row has at least one."""
    n = len(offsets) - 1
    starts, lengths, first = words(data, offsets)
    row = np.repeat(np.arange(n), np.diff(first))
    h = word_hashes(LOWER[data], starts, lengths)
    shape = mix(_KIND[data[starts]] * M2 + _KIND[data[starts + lengths - 1]] * M3 + M1)
    found = [(row, h), (row, shape)]
    for x in (h, shape):
        same = row[1:] == row[:-1]
        found.append((row[1:][same], mix(x[:-1] * M3 + x[1:])[same]))
    same = row[2:] == row[:-2]
    windows, at = mix(mix(h[:-2] * M3 + h[1:-1]) * M3 + h[2:])[same], row[2:][same]
    order = np.lexsort((windows, at))
    again = np.zeros(len(order), bool)
    if len(order):
        again[1:] = (windows[order][1:] == windows[order][:-1]) & (at[order][1:] == at[order][:-1])
    share = np.bincount(at[order], again, minlength=n) / np.maximum(1, np.bincount(at, minlength=n))
    found.append((np.arange(n), mix(np.ceil(share * 10).astype(np.uint64) + M2)))
    keys = np.concatenate([(r.astype(np.uint64) << np.uint64(BITS)) | (x >> np.uint64(64 - BITS)) for r, x in found])
    keys.sort()
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """weight: ratio times fitted weight of each indicator; square: its ratio squared; then the margin's bias and the curve."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, rows: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
        total = np.bincount(rows, self.weight[found], minlength=n)
        return total / np.sqrt(np.maximum(np.bincount(rows, self.square[found], minlength=n), 1e-12)) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss support vector machine; the bias is a constant feature. Rows are visited in a seeded order."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    norm = np.array([v @ v + 1 for v in values])
    turn = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in turn.permutation(len(y)):
            slope = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), COST)
            if (step := (new - alpha[i]) * y[i]) != 0.0:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve by Newton steps, with targets drawn in from 0 and 1 by the class sizes."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack((margins, np.ones_like(margins)), axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        at -= np.clip(np.linalg.solve(hess, x.T @ (p - target) + 1e-3 * (at - [1.0, 0.0])), -2, 2)
    return float(max(at[0], 1e-3)), float(at[1])


def fit(rows: list[np.ndarray], label: np.ndarray) -> Model:
    """From indicator lists and 0/1 labels; every fifth row of either class draws the curve, or all rows where a class has fewer than five. Without rows, all scores are one half."""
    size = 1 << BITS
    y = np.where(label > 0, 1.0, -1.0)
    if not len(y) or (y > 0).all() or (y < 0).all():
        share = 0.5 if not len(y) else float((y > 0).mean())
        return Model(np.zeros(size, np.float32), np.ones(size, np.float32), 0.0, 0.0, 3.0 * (2 * share - 1))
    curve = np.zeros(len(y), bool)
    for side in (-1.0, 1.0):  # of either class, however rare
        curve[np.flatnonzero(y == side)[4::5]] = True
    if len(np.unique(y[curve])) < 2:
        curve[:] = False
    seen = np.full((2, size), SMOOTHING)
    for r, c in zip((rows[i] for i in np.flatnonzero(~curve)), (y[~curve] > 0).astype(int)):
        seen[c, r] += 1
    ratio = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())
    ratio[(seen == SMOOTHING).all(axis=0)] = 0.0
    own = [rows[i] for i in np.flatnonzero(~curve)]
    values = [ratio[r] / max(1e-6, float(np.linalg.norm(ratio[r]))) for r in own]
    w, bias = dual_descent(own, values, y[~curve], size)
    model = Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, 1.0, 0.0)
    left = [rows[i] for i in np.flatnonzero(curve)] or own
    at = np.repeat(np.arange(len(left)), [len(r) for r in left])
    margins = model.margins(at, np.concatenate(left), len(left))
    slope, shift = logistic(margins, y[curve] if curve.any() else y)
    return Model(model.weight, model.square, bias, slope, shift)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> Model:
    """A model from the labelled texts that are not held out. Null labels are skipped; of several labels of an id the largest counts."""
    known = labels.where(~held_out() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            out = []
            for i, j in slices(offsets):
                rows, found = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out += np.split(found, np.searchsorted(rows, np.arange(1, j - i)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "quality", "digest")), pa.array([x.astype(np.int32) for x in out], pa.list_(pa.int32()))], names=["doc_id", "quality", "digest", "found"])

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # of the texts of a repeated id the one of smallest digest; then no more than the driver can hold, however long texts are
    one = joined.withColumn("digest", F.sha2("text", 256)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "digest", "text")
    found = written(one.mapInArrow(released(run), "doc_id long, quality int, digest string, found array<int>"))
    first = found.groupBy("doc_id").agg(F.min(F.coalesce("digest", F.lit(""))).alias("least"), F.min_by(F.size("found"), F.coalesce("digest", F.lit(""))).alias("size"))
    total = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    kept = first.withColumn("total", total).where(F.col("total") <= FIT_FOUND).select("doc_id", "least")
    got = found.join(F.broadcast(kept), "doc_id").where(F.coalesce("digest", F.lit("")) == F.col("least")).dropDuplicates(["doc_id"]).select("doc_id", "quality", "found").toArrow()
    got = got.sort_by("doc_id")
    lists = got.column("found").combine_chunks()
    flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    flat_rows = np.split(flat, at[1:-1] - at[0]) if len(lists) else []
    return fit(flat_rows, got.column("quality").to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of `docs` with score, named by `fresh`. Null texts score as empty ones."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names, name = docs.columns, fresh(docs.columns, "score")

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            out = np.zeros(len(batch))
            for i, j in slices(offsets):
                rows, found = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out[i:j] = held.value.scores(held.value.margins(rows, found, j - i))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(released(run), schema)


def classify(docs: DataFrame, labels: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`; the model is fitted on `texts`, by default `docs` itself."""
    model = train(docs if texts is None else texts, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

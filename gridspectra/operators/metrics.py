"""Evaluation operators over pixel, box and score tables. All are single aggregations and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORE = 255


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def valid(pixels: DataFrame, ignore: int = IGNORE) -> DataFrame:
    return pixels.where(F.col("target") != ignore)


def contingency(pixels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts of (pred, target): the one pass over pixels that all matched metrics need."""
    return pixels.groupBy(*keys, "pred", "target").agg(F.count("*").alias("n"))


def _domain(df: DataFrame, name: str, n: int) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias(name))


def pair_iou(counts: DataFrame, n_pred: int, n_target: int) -> DataFrame:
    """IoU of every cluster with every class, zero where they never meet; two small domains."""
    p = counts.groupBy("pred").agg(F.sum("n").alias("np"))
    t = counts.groupBy("target").agg(F.sum("n").alias("nt"))
    every = _domain(counts, "pred", n_pred).join(F.broadcast(_domain(counts, "target", n_target)), F.lit(True))
    full = every.join(counts, ["pred", "target"], "left").join(p, "pred", "left").join(t, "target", "left").fillna(0, ["n", "np", "nt"])
    union = (F.col("np") + F.col("nt") - F.col("n")).cast("double")
    return full.select("pred", "target", (F.col("n") / F.greatest(union, F.lit(1e-8))).alias("iou"))


def majority_match(ious: DataFrame) -> DataFrame:
    """Each cluster's class of highest IoU, the smaller class among equals; many clusters may share one."""
    first = Window.partitionBy("pred").orderBy(F.desc("iou"), "target")
    return ious.withColumn("rank", F.row_number().over(first)).where("rank = 1").select("pred", "target", "iou")


def assign(gain: list[list[float]]) -> list[int]:
    """Column of each row in the assignment of largest total gain of a square table: shortest augmenting paths, n^3."""
    n = len(gain)
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = owner[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    cost = -gain[i0 - 1][j - 1] - u[i0] - v[j]
                    if cost < least[j]:
                        least[j], way[j] = cost, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[owner[j] - 1] = j - 1
    return out


def hungarian_match(ious: DataFrame, n: int) -> DataFrame:
    """One-to-one matching of largest total IoU. The n x n table, bounded by the numbers of classes, is solved on the driver."""
    table = [[0.0] * n for _ in range(n)]
    for r in ious.collect():
        table[r.pred][r.target] = r.iou
    return ious.sparkSession.createDataFrame([(i, j, table[i][j]) for i, j in enumerate(assign(table))], "pred int, target int, iou double")


def remap(pixels: DataFrame, matching: DataFrame) -> DataFrame:
    """Predictions replaced by their matched class; unmatched ones become 0. `matching` has a row per cluster."""
    m = matching.select(F.col("pred").alias("from"), F.col("target").alias("to"))
    return pixels.join(m, F.col("pred") == F.col("from"), "left").withColumn("pred", F.coalesce("to", F.lit(0))).drop("from", "to")


def class_jaccard(counts: DataFrame, n: int) -> DataFrame:
    """tp, fp, fn and Jaccard of every class, 0 for those that never occur."""
    side = lambda c: counts.groupBy(F.col(c).alias("cls")).agg(F.sum("n").alias(f"n_{c}"), F.sum(F.when(F.col("pred") == F.col("target"), F.col("n")).otherwise(0)).alias(f"tp_{c}"))
    full = _domain(counts, "cls", n).join(side("pred"), "cls", "left").join(side("target"), "cls", "left").fillna(0)
    tp, fp, fn = F.col("tp_pred"), F.col("n_pred") - F.col("tp_pred"), F.col("n_target") - F.col("tp_pred")
    return full.select("cls", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), ratio(tp, tp + fp + fn).alias("jaccard"))


def miou(pixels: DataFrame, n: int, match: str = "majority") -> DataFrame:
    """Mean Jaccard over all classes after matching clusters to classes. Pixels are read once: remapping is done on counts."""
    counts = contingency(valid(pixels))
    ious = pair_iou(counts, n, n)
    matching = majority_match(ious) if match == "majority" else hungarian_match(ious, n)
    matched = remap(counts, matching).groupBy("pred", "target").agg(F.sum("n").alias("n"))
    return class_jaccard(matched, n).agg(F.avg("jaccard").alias("miou"))


# ---- binary masks


def pixel_accuracy(pixels: DataFrame, *keys: str) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.avg((F.col("pred") == F.col("target")).cast("double")).alias("acc"))


def binary_iou(pixels: DataFrame, *keys: str) -> DataFrame:
    both, either = F.count_if(F.col("pred") & F.col("target")), F.count_if(F.col("pred") | F.col("target"))
    return pixels.groupBy(*keys).agg(ratio(both, either).alias("iou"))


def precision_recall(pixels: DataFrame, *keys: str) -> DataFrame:
    tp = F.count_if(F.col("pred") & F.col("target"))
    return pixels.groupBy(*keys).agg(ratio(tp, F.count_if("pred"), 1.0).alias("precision"), ratio(tp, F.count_if("target"), 1.0).alias("recall"))


def pr_curve(pixels: DataFrame, bins: int = 255) -> DataFrame:
    """Precision and recall of soft > i / bins for i = 1 .. bins - 1, by image.

    A pixel passes the thresholds below its value: one histogram by image and a sum from above, in place of a pass per threshold.
    """
    passes = F.least(F.greatest(F.ceil(F.col("soft") * bins) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    exact = F.col("soft") > passes / F.lit(float(bins))
    above = F.col("soft") > (passes + 1) / F.lit(float(bins))
    top = F.when(above & (passes < bins - 1), passes + 1).when(exact, passes).otherwise(passes - 1)
    hist = pixels.groupBy("image_id", top.alias("i")).agg(F.count("*").alias("n"), F.count_if("target").alias("t"))
    area = pixels.groupBy("image_id").agg(F.count_if("target").alias("area"))
    every = area.select("image_id", "area", F.explode(F.sequence(F.lit(1), F.lit(bins - 1))).alias("i"))
    high = hist.select("image_id", F.greatest(F.col("i"), F.lit(0)).alias("i"), "n", "t")
    full = every.join(high.groupBy("image_id", "i").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), ["image_id", "i"], "left").fillna(0)
    down = Window.partitionBy("image_id").orderBy(F.desc("i"))
    n, t = F.sum("n").over(down), F.sum("t").over(down)
    return full.select("image_id", "i", ratio(t, n, 1.0).alias("precision"), ratio(t, F.col("area"), 1.0).alias("recall"))


def f_beta(precision: Column, recall: Column, beta2: float = 0.3) -> Column:
    return ratio((1 + beta2) * precision * recall, beta2 * precision + recall)


def f_max(pixels: DataFrame, bins: int = 255) -> DataFrame:
    """Largest, over thresholds, of the mean F over images."""
    return pr_curve(pixels, bins).groupBy("i").agg(F.avg(f_beta(F.col("precision"), F.col("recall"))).alias("f")).agg(F.max("f").alias("f_max"))


# ---- scores and meters


def topk_accuracy(scores: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Percent of rows whose label is among the k highest scores; smaller classes first among equals."""
    order = Window.partitionBy("vec_id").orderBy(F.desc("score"), "class")
    hit = scores.withColumn("rank", F.row_number().over(order)).where(F.col("class") == F.col("label"))
    n = scores.agg(F.count_distinct("vec_id").alias("n"))
    return hit.agg(*[F.count_if(F.col("rank") <= k).alias(f"k{k}") for k in ks]).join(n, F.lit(True)).select(*[(100 * ratio(F.col(f"k{k}"), F.col("n"))).alias(f"top{k}") for k in ks])


def rolling(meter: DataFrame, size: int = 20) -> DataFrame:
    """Over the last `size` values of a series: lower median, mean, maximum, last value; and the mean of all so far."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = order.rowsBetween(-(size - 1), 0)
    values = F.array_sort(F.collect_list("value").over(last))
    return meter.select("user_id", "event_id", "value", F.avg("value").over(last).alias("mean"), F.max("value").over(last).alias("max"), F.avg("value").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("global_mean"), values.alias("v")).select("user_id", "event_id", F.element_at("v", F.floor((F.size("v") + 1) / 2).cast("int")).alias("median"), "mean", "max", "value", "global_mean")


def weighted_mean(df: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"))

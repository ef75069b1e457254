"""Exact top-k inner-product search by distributed histogram selection.

Every candidate is scored against every query. A first histogram of the scores, summed over the
whole table, shows in which bin a query's kth value lies; that bin is divided again until bins
are one integer wide. A last pass keeps what reaches the kth value, smaller ids first among ties.

Queries are taken in groups of bounded size, so the histograms and group vectors that pass
through the driver are bounded too (GROUP * BINS counts), however large the table is; each group's rows are written before the next begins.

Products are exact: float64 while they fit 53 bits, then int64, then Python integers for the rows that need them. In histograms scores
beyond CLAMP count as CLAMP; what reaches the kth value is compared in full. Only a score that is among the best and beyond 64 bits raises an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

#: Queries in a group (about; groups are dealt by hash), bins of a histogram, candidates scored at once.
GROUP, BINS, ROWS = 1024, 256, 1024
#: Steps to a unit; size from which a row's components are Python integers; largest score that histograms tell from larger ones.
SCALE, SMALL, CLAMP = 256, 2.0**12, 2**61


def sound(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the components as doubles. Null ids, null vectors and those with null or non-finite components are left out."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    there = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    finite = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    return vectors.where(there).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and floor(SCALE * x) by dimension, at most ROWS rows each; small components as float64, rows with larger ones apart as Python integers."""
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    x = batch.column("x")
    flat, at = x.flatten().to_numpy(zero_copy_only=False), x.offsets.to_numpy() - x.offsets[0].as_py()
    width = np.diff(at)
    for d in np.unique(width):
        own = np.flatnonzero(width == d)
        for i in range(0, len(own), ROWS):
            k = own[i : i + ROWS]
            m = flat[at[k][:, None] + np.arange(d)]
            large = (np.abs(m) >= SMALL).any(axis=1) if d else np.zeros(len(k), bool)
            if not large.all():
                yield ids[k[~large]], np.floor(m[~large] * SCALE)
            if large.any():
                exact = [[int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(v * SCALE) for v in row] for row in m[large].tolist()]
                yield ids[k[large]], np.array(exact, dtype=object).reshape(len(exact), d)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products, as int64 or, where sums may pass 63 bits, as Python integers."""
    most = (int(np.abs(a).max(initial=0)) + 1) * (int(np.abs(b).max(initial=0)) + 1) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda m: m if m.dtype == object else m.astype(np.int64).astype(object)
    return whole(a) @ whole(b).T


def _clamped(s: np.ndarray) -> np.ndarray:
    return np.clip(s, -CLAMP, CLAMP).astype(np.int64)


def _meetings(group, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, numbers and products of the group's queries with the candidates `m` of their length."""
    for own_ids, q, at in group.value.get(m.shape[1], ()):
        yield own_ids, at, _products(q, m)


def _histograms(group, n, lo, width, step):
    """Counts of the scores in [lo, lo + width) by bins of `step`."""

    def run(batches):
        sums = np.zeros((n, BINS), dtype=np.int64)
        for batch in batches:
            for ids, m in _matrices(batch):
                for own_ids, at, s in _meetings(group, m):
                    s = _clamped(s) - lo[at, None]
                    b = s // step
                    b[(s < 0) | (s >= width) | (own_ids[:, None] == ids[None, :])] = BINS
                    flat = np.bincount((b + np.arange(len(at))[:, None] * (BINS + 1)).ravel(), minlength=len(at) * (BINS + 1))
                    sums[at] += flat.reshape(len(at), BINS + 1)[:, :BINS]
        used = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_pydict({"query": pa.array(used, pa.int64()), "counts": pa.array(list(sums[used]), pa.list_(pa.int64()))})

    return run


def _reaching(group, first, kth, k):
    """What reaches the kth value, by number of query; the group's numbers start at `first`."""

    def run(batches):
        best: dict[int, list[tuple[int, int]]] = {}  # by number: an id may have several queries
        names: dict[int, int] = {}
        for batch in batches:
            for ids, m in _matrices(batch):
                for own_ids, at, s in _meetings(group, m):
                    hit = (_clamped(s) >= kth[at, None]) & (own_ids[:, None] != ids[None, :])
                    for i in np.flatnonzero(hit.any(axis=1)):
                        j = np.flatnonzero(hit[i])
                        if s.dtype != object and len(j) > k:  # of many ties only the first can stay
                            j = j[np.lexsort((ids[j], -s[i, j]))[:k]]
                        found = best.get(at[i], []) + [(-int(x), int(v)) for x, v in zip(s[i, j], ids[j])]
                        best[at[i]], names[at[i]] = sorted(found)[:k], own_ids[i]
        rows = [(int(q), v, -s) for q, found in best.items() for s, v in found]
        # no long holds it; a very negative one is only kept where a query has few candidates in this task
        rows = [(q, v, s if s < 2**63 else None) for q, v, s in rows]
        yield pa.RecordBatch.from_pydict({"query": pa.array([first + r[0] for r in rows], pa.int64()), "query_id": pa.array([names[r[0]] for r in rows], pa.int64()), "vec_id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([None if r[2] is None else max(r[2], -(2**63)) for r in rows], pa.int64()), "beyond": pa.array([r[2] is None or r[2] < -(2**63) for r in rows], pa.bool_())})

    return run


def _kth(spark: SparkSession, candidates: DataFrame, group, bound: int, n: int, k: int) -> np.ndarray:
    """Each query's kth largest score, up to CLAMP; where there are fewer than k candidates, a value below all scores."""
    lo, need = np.full(n, -bound, dtype=np.int64), np.full(n, k, dtype=np.int64)
    few = np.zeros(n, dtype=bool)
    width, first = 2 * bound + 1, True
    while True:
        step = -(-width // BINS)
        counts = np.zeros((n, BINS), dtype=np.int64)
        sums = candidates.mapInArrow(_histograms(group, n, lo, width, step), "query long, counts array<long>")
        totals = sums.select("query", F.posexplode("counts").alias("bin", "n")).where("n > 0").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        got = totals.toPandas()
        counts[got["query"], got["bin"]] = got["n"]
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]  # scores in this bin or higher ones
        if first:
            few, first = above[:, 0] < k, False
        bins = np.maximum((above >= need[:, None]).sum(axis=1) - 1, 0)
        higher = np.where(bins + 1 < BINS, above[np.arange(n), np.minimum(bins + 1, BINS - 1)], 0)
        lo, need = lo + bins * step, need - higher
        if step == 1:
            return np.where(few, -bound - 1, lo)
        width = step


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = 5) -> DataFrame:
    """The k best candidates of every query: query_id, rank, vec_id, score.

    `vectors` has vec_id and embedding; `queries` are rows of the same kind, by default those whose
    vec_id is divisible by 50. Only vectors of equal length meet; a row with the query's id is the query's own.
    Equal scores go to smaller ids; repeated ids count as rows of their own: several vectors of one id are as many
    queries, each with its own list under that id (equal rows are one query). Without candidates a query has no rows.
    Components may be of any finite size; a score among the best that no long holds raises an error.
    """
    spark = vectors.sparkSession
    candidates = written(sound(vectors))
    asked = candidates.where(F.pmod("vec_id", F.lit(50)) == 0).distinct() if queries is None else written(sound(queries).distinct())
    largest, size = candidates.agg(F.max(F.coalesce(F.array_max(F.transform("x", lambda v: F.abs(v))), F.lit(0.0))), F.max(F.size("x"))).first()
    scaled = lambda x: (int(x) + 1) * SCALE
    n_groups = -(-asked.count() // GROUP)
    parts = [spark.createDataFrame([], "query long, query_id long, vec_id long, score long, beyond boolean")]
    asked_before = 0
    for g in range(n_groups):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_groups)) == g).toArrow()
        if not part.num_rows:
            continue
        by_size, n = {}, 0
        for batch in part.combine_chunks().to_batches():
            for ids, m in _matrices(batch):
                by_size.setdefault(m.shape[1], []).append((ids, m, np.arange(n, n + len(ids))))
                n += len(ids)
        most = max(int(np.abs(q).max(initial=0)) for blocks in by_size.values() for _, q, _ in blocks)
        bound = min(CLAMP, max(1, most * scaled(largest or 0.0) * max(1, size or 1)))
        group = spark.sparkContext.broadcast(by_size)
        kth = _kth(spark, candidates, group, bound, n, k)
        parts.append(written(candidates.mapInArrow(_reaching(group, asked_before, kth, k), parts[0].schema)))
        asked_before += n
        group.unpersist()
    out = reduce(DataFrame.union, parts)
    order = Window.partitionBy("query").orderBy(F.desc_nulls_first("score"), "vec_id")
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    held = F.when(F.col("beyond"), F.raise_error(F.lit("a score among the best is beyond 64 bits")).cast("long")).otherwise(F.col("score"))
    return best.select("query_id", "rank", "vec_id", held.alias("score"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=5)


SQL = """
with q as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
  from q a, q b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""

"""N-gram Jaccard join with count-vector R-trees.

A text is the set of its distinct shingle hashes; equal sets are one class. Two classes link when their
sets' Jaccard similarity reaches 3/4. The join is exact:

1. Blocks. Each set is ordered by a global order, rare shingles first (frequencies from a count sketch of fixed
   size; the order needs no exactness). Sets that link share a shingle within their first n - ceil(3n/4) + 1, so
   the classes that hold a shingle there are a block. Entries without a partner of fitting size and place in their block go at once.
2. Trees. Shingles are hashed into GROUPS; a set's counts per group are a point. In a block the points are
   indexed by an R-tree. Two sets, or all sets of two nodes, share at most the sum of the coordinate minima
   (of the nodes' upper corners), which prunes pairs of nodes and of points. What survives ties classes to clusters of candidates.
3. Links. One text of a class is sent, to its cluster. There its set is made again, a tree over the cluster's points finds the pairs and
   they are verified on the sets. Pairs of classes that are in one component already are skipped, so a large group of near
   copies costs a number of pairs in proportion to its size and no table of pairs grows with the square of a group.

Blocks of more than TILE entries and clusters of more than TILE_SHINGLES are cut into parts by hash, and every two parts meet in a task.
A single tree over all points would prune next to nothing at 3/4: the counts of unrelated texts differ by less
than linked ones may, unless groups are about as many as shingles. Hence the blocks.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .ragged import buffers, mix, packed, shingle_sets, slices, unpacked
from .shared import discard, fresh, release, released, table, written

WIDTH, GROUPS, LEAF = 5, 64, 64
#: Sizes that do not grow with the input: log2 of the counters of the sketch, of the bits of bitmaps, and their segments.
SKETCH_BITS, MAP_BITS, SEGMENTS = 22, 26, 256
#: Entries to a packed bucket, about; entries of a block, and shingles of a cluster, that one task takes whole.
BUCKET, TILE, TILE_SHINGLES = 1 << 18, 1 << 12, 1 << 21
#: From so many entries of one block in a task they are thinned out before they are sent.
CROWD = 16
#: The similarity as a fraction.
OVER, UNDER = 3, 4


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least intersection of linked sets of n and m members."""
    return -(-OVER * (n + m) // (OVER + UNDER))


def _sets(batch: pa.RecordBatch):
    data, offsets = buffers(batch.column("text"))
    for i, j in slices(offsets):
        yield from shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WIDTH)


def _class(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


# ---- order of shingles


def sketch(docs: DataFrame) -> np.ndarray:
    """The number of texts by the shingle's bucket, one byte each: 64 stands for a bucket's average, 255 for all from four times it.

    The scale is fine, for a shingle of a few texts must come after those of one in spite of what else their buckets hold.
    """
    size, part = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SEGMENTS

    def run(batches):
        counts = np.zeros(size, np.int32)
        for batch in batches:
            held, n = [], 0
            for s in _sets(batch):
                held.append(s)
                n += len(s)
                if n > 1 << 20:
                    counts += np.bincount(np.concatenate(held) >> np.uint64(64 - SKETCH_BITS), minlength=size).astype(np.int32)
                    held, n = [], 0
            if held:
                counts += np.bincount(np.concatenate(held) >> np.uint64(64 - SKETCH_BITS), minlength=size).astype(np.int32)
        for k in range(SEGMENTS):
            own = counts[k * part : (k + 1) * part]
            if own.any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "counts": [zlib.compress(own.tobytes(), 1)]})

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(part, np.int64)
        for x in t.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.int32)
        return pa.table({"segment": t.column("segment").slice(0, 1), "total": pa.array([int(total.sum())], pa.int64()), "counts": [total.tobytes()]})

    summed = written(docs.select("text").mapInArrow(released(run), "segment int, counts binary").groupBy("segment").applyInArrow(add, "segment int, total long, counts binary"))
    unit = max(1.0, (summed.agg(F.sum("total")).first()[0] or 0) / size / 64)

    def scale(batches):
        for batch in batches:
            levels = [np.minimum(np.frombuffer(x.as_py(), np.int64) / unit, 255).astype(np.uint8).tobytes() for x in batch.column("counts")]
            yield pa.RecordBatch.from_arrays([batch.column("segment"), pa.array(levels, pa.binary())], names=["segment", "levels"])

    out = np.zeros(size, np.uint8)
    got = summed.select("segment", "counts").mapInArrow(scale, "segment int, levels binary").toArrow()
    for k, x in zip(got.column("segment").to_pylist(), got.column("levels").to_pylist()):
        out[k * part : (k + 1) * part] = np.frombuffer(x, np.uint8)
    return out


def packed_counts(s: np.ndarray) -> bytes:
    """A set's shingles by group: one byte each, or four if one is above 255."""
    counts = np.bincount((mix(s) >> np.uint64(32)).astype(np.int64) % GROUPS, minlength=GROUPS)
    return counts.astype(np.uint8 if counts.max() < 256 else np.int32).tobytes()


def unpacked_counts(column) -> np.ndarray:
    """Points from a column of packed counts."""
    out = np.zeros((len(column), GROUPS), np.int32)
    for i, x in enumerate(column.to_pylist()):
        out[i] = np.frombuffer(x, np.uint8 if len(x) == GROUPS else np.int32)
    return out


def classed(docs: DataFrame, levels) -> DataFrame:
    """doc_id, v (class), n; and, for the first text of a class in a task, its number u, its prefix and its counts per group.

    A class that several tasks meet has several numbers; their sets are equal, so they meet in all their blocks.
    """

    def run(batches):
        seen: set[bytes] = set()
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            v, n, u, prefix, counts = [], [], [], [], []
            for s in _sets(batch):
                v.append(c := _class(s))
                n.append(len(s))
                if c in seen or not len(s):
                    for column in (u, prefix, counts):
                        column.append(None)
                    continue
                if len(seen) < 1 << 17:
                    seen.add(c)
                k = len(s) - -(-OVER * len(s) // UNDER) + 1
                key = levels.value[s >> np.uint64(64 - SKETCH_BITS)]
                first = np.lexsort((s, key))[:k]
                u.append(number)
                number += 1
                prefix.append(s[first].tobytes())
                counts.append(packed_counts(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(v, pa.binary()), pa.array(n, pa.int64()), pa.array(u, pa.int64()), pa.array(prefix, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "v", "n", "u", "prefix", "counts"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {id_type}, v binary, n long, u long, prefix binary, counts binary")


# ---- bitmaps


def bitmap(bits: DataFrame, size: int = MAP_BITS) -> np.ndarray:
    """2^size bits as bytes, from a table of bit numbers; what each segment gathers is bounded by its bits."""
    part = (1 << size) // SEGMENTS

    def pack(t: pa.Table) -> pa.Table:
        own = np.zeros(part, bool)
        own[t.column("bit").to_numpy() % part] = True
        return pa.table({"segment": t.column("segment").slice(0, 1), "bits": [np.packbits(own).tobytes()]})

    out = np.zeros((1 << size) // 8, np.uint8)
    got = bits.distinct().withColumn("segment", F.floor(F.col("bit") / part).cast("int")).groupBy("segment").applyInArrow(pack, "segment int, bits binary").toArrow()
    for k, x in zip(got.column("segment").to_pylist(), got.column("bits").to_pylist()):
        out[k * part // 8 : (k + 1) * part // 8] = np.frombuffer(x, np.uint8)
    return out


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = at.astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


# ---- blocks

#: kind: 0 for an entry as it is, 1 for one that only speaks for others in its task, 2 for one that needs no partner any more.
ENTRY = np.dtype([("h", "<u8"), ("u", "<i8"), ("n", "<i4"), ("at", "<i4"), ("kind", "u1")])


def _packed(e: np.ndarray) -> bytes:
    """Entries in order of u: numbers of classes as steps, which are small."""
    e = e[np.argsort(e["u"], kind="stable")]
    return packed(e["h"], np.diff(e["u"], prepend=0), e["n"], e["at"], e["kind"])


def _unpacked(x: bytes) -> np.ndarray:
    columns = unpacked(x)
    out = np.empty(len(columns[0]), ENTRY)
    for name, c in zip(ENTRY.names, columns):
        out[name] = c
    out["u"] = np.cumsum(out["u"])
    return out


def _fit(e: np.ndarray) -> np.ndarray:
    """Which entries (by h, then n) have a partner in their block whose size may fit.

    Neighbours in size decide. 9/16 stands for 3/4, for one of a thinned-out block's entries may speak for all within 3/4 of it; in a block
    of just two that is whole, size and place are asked exactly.
    """
    if not len(e):
        return np.zeros(0, bool)
    same = e["h"][1:] == e["h"][:-1]
    near = same & (OVER**2 * e["n"][1:].astype(np.int64) <= UNDER**2 * e["n"][:-1].astype(np.int64))
    n = e["n"].astype(np.int64)
    least = needed(n[1:], n[:-1])
    exact = (n[:-1] >= least) & (np.minimum(n[1:] - e["at"][1:], n[:-1] - e["at"][:-1]) >= least)
    two = same & ~np.concatenate(([False], same[:-1])) & ~np.concatenate((same[1:], [False])) & (e["kind"][1:] == 0) & (e["kind"][:-1] == 0)
    near[two] &= exact[two]
    return np.concatenate((near, [False])) | np.concatenate(([False], near))


def _thinned(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries that are settled here since their block is crowded, and those to send: the rest, and one for each step of sizes of the settled."""
    edge = np.flatnonzero(np.concatenate(([True], e["h"][1:] != e["h"][:-1], [True])))
    crowded = np.repeat(np.diff(edge) >= CROWD, np.diff(edge))
    if not crowded.any():
        return e[:0], e
    settled = crowded & _fit(e)
    step = np.floor(np.log(np.maximum(e["n"], 1)) / np.log(UNDER / OVER))
    new = np.concatenate(([True], (e["h"][1:] != e["h"][:-1]) | (step[1:] != step[:-1]) | ~settled[:-1]))
    send = ~settled | new
    out = e[send]
    out["kind"] = settled[send]
    done = e[settled]
    done["kind"] = 2
    return done, out


def posts(members: DataFrame, buckets: int) -> DataFrame:
    """h, u, n, at (place of h in the order) of every class in a block that has a partner of fitting size and place."""

    def dealt(e: np.ndarray, to: np.ndarray):
        order = np.argsort(to, kind="stable")
        used, at = np.unique(to[order], return_index=True)
        cut = [*at, len(order)]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([_packed(e[order[a:b]]) for a, b in zip(cut, cut[1:])], pa.binary())], names=["bucket", "entries"])

    def run(batches):
        def flush():
            e = np.zeros(count, ENTRY)
            lengths = [len(x[0]) for x in held]
            e["h"] = np.concatenate([x[0] for x in held])
            e["at"] = np.concatenate([np.arange(k) for k in lengths])
            e["u"], e["n"] = (np.repeat([x[k] for x in held], lengths) for k in (1, 2))
            done, e = _thinned(e[np.lexsort((e["n"], e["h"]))])
            yield dealt(e, (mix(e["h"]) % np.uint64(buckets)).astype(np.int64))
            if len(done):
                yield dealt(done, buckets + (mix(done["u"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64))

        held, count = [], 0
        for batch in batches:
            for u, n, p in zip(batch.column("u").to_pylist(), batch.column("n").to_pylist(), batch.column("prefix")):
                held.append((np.frombuffer(p.as_py(), np.uint64), u, n))
                count += len(held[-1][0])
                if count > 1 << 20:
                    yield from flush()
                    held, count = [], 0
        if held:
            yield from flush()

    def met(t: pa.Table) -> pa.Table:
        e = np.concatenate([_unpacked(x.as_py()) for x in t.column("entries")])
        e = e[np.lexsort((e["n"], e["h"]))]
        e = e[(_fit(e) & (e["kind"] == 0)) | (e["kind"] == 2)]
        return pa.table({"h": pa.array(np.ascontiguousarray(e["h"]).view(np.int64)), **{x: pa.array(e[x].astype(np.int64)) for x in ("u", "n", "at")}})

    return members.where("u is not null").select("u", "n", "prefix").mapInArrow(released(run), "bucket long, entries binary").groupBy("bucket").applyInArrow(met, "h long, u long, n long, at long")


class Tree:
    """An R-tree over the points of a block, packed by halving along the widest coordinate."""

    __slots__ = ("rows", "upper", "small", "large", "kids")

    def __init__(self, rows, points, sizes):
        self.rows = rows
        own = points[rows]
        self.upper = own.max(axis=0)
        self.small, self.large = int(sizes[rows].min()), int(sizes[rows].max())
        self.kids = ()
        if len(rows) > LEAF:
            spread = self.upper - own.min(axis=0)
            order = rows[np.argsort(own[:, int(spread.argmax())], kind="stable")]
            half = len(order) // 2
            self.kids = tuple(Tree(x, points, sizes) for x in (order[:half], order[half:]))


def tree_join(points: np.ndarray, sizes: np.ndarray, at: np.ndarray, labels: np.ndarray, side: np.ndarray | None = None):
    """Pairs (i, j) of rows with different labels that size, place and summed minima allow to link; with `side`, of rows of different sides.

    `labels` may be changed between yields: what has become one component is not asked for again.
    """
    if side is None:
        root = Tree(np.arange(len(sizes)), points, sizes)
        todo = [(root, root)]
    else:
        todo = [tuple(Tree(np.flatnonzero(side == k), points, sizes) for k in (False, True))] if side.any() and not side.all() else []
    while todo:
        a, b = todo.pop()
        if UNDER * a.large < OVER * b.small or UNDER * b.large < OVER * a.small or np.minimum(a.upper, b.upper).sum() < -(-OVER * (a.small + b.small) // (OVER + UNDER)):
            continue
        first = labels[a.rows[0]]
        if (labels[a.rows] == first).all() and (a is b or (labels[b.rows] == first).all()):
            continue
        if a.kids or b.kids:
            left, right = a.kids or (a,), b.kids or (b,)
            todo += [(x, y) for i, x in enumerate(left) for j, y in enumerate(right) if a is not b or j >= i][::-1]
            continue
        i, j = (x.ravel() for x in np.meshgrid(a.rows, b.rows, indexing="ij"))
        if a is b:
            i, j = i[i < j], j[i < j]
        apart = labels[i] != labels[j]
        i, j = i[apart], j[apart]
        ok = may_link(points, sizes, at, i, j)
        yield i[ok], j[ok]


def may_link(points, sizes, at, i, j):
    """The size, place and count bounds of pairs of rows."""
    least = needed(sizes[i], sizes[j])
    ok = (np.minimum(sizes[i], sizes[j]) >= least) & (np.minimum(sizes[i] - at[i], sizes[j] - at[j]) >= least)
    ok[ok] = np.minimum(points[i[ok]], points[j[ok]]).sum(axis=1) >= least[ok]
    return ok


def unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the components of rows i and j one label, the smaller, in place."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        to = np.arange(len(labels))
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        labels[:] = to[labels]


def candidates(t: pa.Table) -> pa.Table:
    """The classes of a bucket of blocks, tied by the pairs that their trees leave: u and the smallest number it is tied to."""
    h, u = t.column("h").to_numpy(), t.column("u").to_numpy()
    part = t.column("part").to_numpy()
    order = np.lexsort((u, part, h))
    h, u, part = h[order], u[order], part[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (u[1:] != u[:-1]) | (part[1:] != part[:-1])))
    order, h, u, part = order[new], h[new], u[new], part[new]
    points = unpacked_counts(t.column("counts"))[order]
    sizes, at, side, cross = (t.column(x).to_numpy(zero_copy_only=False)[order] for x in ("n", "at", "side", "cross"))
    edge = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (part[1:] != part[:-1]), [True])))
    width = np.diff(edge)
    vertex, number = np.unique(u, return_inverse=True)
    labels = np.arange(len(vertex))
    # a block of one leaf needs no tree above it: all such blocks are one call
    for w in np.unique(width[(width > 1) & (width <= LEAF)]):
        starts = edge[:-1][width == w]
        x, y = np.triu_indices(w, 1)
        for k in range(0, len(starts), max(1, (1 << 19) // len(x))):
            own = starts[k : k + max(1, (1 << 19) // len(x))]
            i, j = (own[:, None] + x).ravel(), (own[:, None] + y).ravel()
            apart = (labels[number[i]] != labels[number[j]]) & (~cross[i] | (side[i] != side[j]))
            i, j = i[apart], j[apart]
            ok = may_link(points, sizes, at, i, j)
            unite(labels, number[i[ok]], number[j[ok]])
    for a, b in zip(edge[:-1][width > LEAF], edge[1:][width > LEAF]):
        own = slice(a, b)
        _, local = np.unique(labels[number[own]], return_inverse=True)
        for i, j in tree_join(points[own], sizes[own], at[own], local, side[own] if cross[a] else None):
            unite(local, i, j)
        first = np.full(len(local), b - a)
        np.minimum.at(first, local, np.arange(b - a))
        unite(labels, number[own], number[a + first[local]])
    tied = np.flatnonzero(labels != np.arange(len(vertex)))
    del points
    release()
    return pa.table({"a": vertex[tied], "b": vertex[labels[tied]]})


def parted(df: DataFrame, key: str, size, most: int, by: str) -> DataFrame:
    """`df` with part, cross and side: rows of a key whose summed `size` is above `most` are cut into parts by a hash of `by`, and every two parts meet.

    A part meets itself (cross is false) or another (cross is true, side tells the two apart).
    """
    whole = df.withColumns({"part": F.lit(0).cast("long"), "cross": F.lit(False), "side": F.lit(False)})
    large = df.groupBy(key).agg(F.sum(size).alias("size")).where(F.col("size") > most).select(key, F.ceil(F.col("size") / most).alias("parts"))
    large = written(large)
    if not large.limit(1).count():
        return whole
    small = whole.join(large.select(key), key, "left_anti")
    cut = df.join(large, key).withColumn("own", F.pmod(F.xxhash64(F.lit(7), by), F.col("parts")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    cut = cut.withColumns({"part": low * F.col("parts") + high, "cross": F.col("own") != F.col("other"), "side": F.col("own") > F.col("other")})
    return small.unionByName(cut.drop("own", "other", "parts"))


# ---- links


def _bit(v: bytes, doc_id) -> int:
    return int.from_bytes(hashlib.blake2b(v + str(doc_id).encode(), digest_size=8).digest(), "little") >> (64 - MAP_BITS)


def whole_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """v, n_bytes and the compressed text of every class in `wanted` (v, doc_id: one text of the class); texts are half the size of their sets.

    The texts are read again and a bitmap says which to send, so no other text is moved; a row too many does no harm.
    """

    def number(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bit": pa.array([_bit(v, i) for v, i in zip(batch.column("v").to_pylist(), batch.column("doc_id").to_pylist())], pa.int64())})

    held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select("v", "doc_id").mapInArrow(number, "bit long")))

    def run(batches):
        for batch in batches:
            v, size, texts = [], [], []
            for i, text, s in zip(batch.column("doc_id").to_pylist(), batch.column("text"), _sets(batch)):
                c = _class(s)
                if len(s) and has(held.value, np.array([_bit(c, i)]))[0]:
                    v.append(c)
                    raw = text.as_buffer()
                    size.append(raw.size)
                    texts.append(pa.compress(raw, "zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()), pa.array(size, pa.int64()), pa.array(texts, pa.binary())], names=["v", "n_bytes", "packed"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "v binary, n_bytes long, packed binary")


def _sets_of(texts: list[bytes]) -> list[np.ndarray]:
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return list(shingle_sets(np.frombuffer(b"".join(texts), np.uint8), offsets, WIDTH))


def shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j, pair by pair; the pairs are of few rows, for their incidence matrices are multiplied."""
    left, right = np.unique(i), np.unique(j)
    x, y = np.concatenate([sets[k] for k in left]), np.concatenate([sets[k] for k in right])
    both = np.intersect1d(x, y)
    total = np.zeros((len(left), len(right)), np.int64)

    def places(rows, flat):
        owner = np.repeat(np.arange(len(rows)), [len(sets[k]) for k in rows])
        at = np.minimum(np.searchsorted(both, flat), max(len(both) - 1, 0))
        held = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        return owner[held], at[held]

    (xr, xc), (yr, yc) = places(left, x), places(right, y)
    step = 1 << 14
    for c in range(0, len(both), step):
        a, b = np.zeros((len(left), min(step, len(both) - c)), np.float32), np.zeros((len(right), min(step, len(both) - c)), np.float32)
        for m, r, q in ((a, xr, xc), (b, yr, yc)):
            own = (q >= c) & (q < c + step)
            m[r[own], q[own] - c] = 1
        total += np.rint(a @ b.T).astype(np.int64)
    return total[np.searchsorted(left, i), np.searchsorted(right, j)]


def cluster_links(t: pa.Table, every: bool = False) -> pa.Table:
    """Links between the classes of a bucket of clusters: pairs (a, b), b the smallest class of a's component; with `every`, all."""
    names = np.array([x.hex() for x in t.column("v").to_pylist()], dtype=object)
    key = t.column("label").to_numpy()
    part = t.column("part").to_numpy()
    order = np.lexsort((names, part, key))
    out: tuple[list, list] = ([], [])
    edge = np.flatnonzero(np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (part[order][1:] != part[order][:-1]), [True])))
    for x, y in zip(edge, edge[1:]):
        rows = order[x:y]
        v = t.column("v").take(rows).to_pylist()
        sets = [s for k in range(0, len(rows), 256) for s in _sets_of([pa.decompress(q, n, "zstd", asbytes=True) for q, n in zip(*(t.column(c).take(rows[k : k + 256]).to_pylist() for c in ("packed", "n_bytes")))])]
        points = np.stack([np.bincount((mix(s) >> np.uint64(32)).astype(np.int64) % GROUPS, minlength=GROUPS) for s in sets]).astype(np.int32)
        sizes = np.array([len(s) for s in sets])
        cross, side = (np.array(t.column(c).take(rows).to_pylist(), bool) for c in ("cross", "side"))
        labels = np.arange(len(rows))
        for i, j in tree_join(points, sizes, np.zeros(len(rows), np.int64), labels, side if cross[0] else None):
            if not len(i):
                continue
            both = shared(sets, i, j)
            ok = 100 * both >= 75 * (sizes[i] + sizes[j] - both)
            if every:
                for a, b in zip(i[ok], j[ok]):
                    out[0].append(max(v[a], v[b]))
                    out[1].append(min(v[a], v[b]))  # a set may be there twice; such pairs go below
            else:
                unite(labels, i[ok], j[ok])
        for a in np.flatnonzero(labels != np.arange(len(rows))):
            out[0].append(v[a])
            out[1].append(v[labels[a]])
    return pa.table({"a": pa.array(out[0], pa.binary()), "b": pa.array(out[1], pa.binary())})


def linked(docs: DataFrame, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, v, n) and links between classes (a, b) that connect all classes of a component; with `every`, all links."""
    members, links, _ = _joined(docs, every)
    return members.select("doc_id", "v", "n"), links


def _joined(docs: DataFrame, every: bool) -> tuple[DataFrame, DataFrame, bool]:
    """`linked`, and whether every component's links are a star around its smallest class."""
    spark = docs.sparkSession
    levels = spark.sparkContext.broadcast(sketch(docs))
    members = written(classed(docs, levels))
    entries = members.agg(F.sum(F.length("prefix"))).first()[0] or 0
    held = written(posts(members, max(SEGMENTS // 4, -(-entries // 8 // BUCKET))))
    counts = members.where("u is not null").select("u", "counts")
    crowded = parted(held, "h", F.lit(1), TILE, "u").join(counts, "u")
    bucket = F.pmod(F.xxhash64("h", "part"), F.lit(max(24, -(-held.count() * 4 // BUCKET))))
    ties = written(crowded.groupBy(bucket).applyInArrow(candidates, "a long, b long").distinct())
    discard(held)
    clusters = components(ties).select(F.col("v").alias("u"), "label")
    wanted = members.select("u", "v", "doc_id", "n").join(clusters, "u")
    # the numbers of one class are in one cluster; one text stands for them
    wanted = written(wanted.groupBy("v").agg(F.min("label").alias("label"), F.max("n").alias("n"), F.min("doc_id").alias("doc_id")))
    texts = whole_texts(docs, wanted)
    met = parted(wanted.select("v", "label", "n"), "label", F.col("n"), TILE_SHINGLES, "v")
    total = wanted.agg(F.sum("n")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("label", "part"), F.lit(max(24, -(-total // (TILE_SHINGLES // 4)))))
    links = written(texts.join(met, "v").groupBy(bucket).applyInArrow(lambda t: cluster_links(t, every), "a binary, b binary").where("a <> b").distinct())
    return members, links, not every and not met.where("cross").limit(1).count()


def link_counts(links: DataFrame) -> DataFrame:
    """v and n_links, the classes each class is linked with, where there are any; `links` as of linked(docs, every=True)."""
    return links.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("n_links"))


def with_class(docs: DataFrame) -> DataFrame:
    """`docs` with v, the class of the text, named by `fresh`."""
    name = fresh(docs.columns, "v")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_class(s) for s in _sets(batch)], pa.binary())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`grouped` without v."""
    return grouped(docs).drop("v")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, v (class), n_shingles, component_id of every row of `docs` (doc_id, text).

    component_id is the smallest doc_id reachable by links, the row's own included. Null and blank texts have no
    shingles and are linked with nothing. Rows with repeated ids are vertices of their own, rows with null ids join
    components without naming them. Sets are compared by 64-bit hashes of their shingles; classes by 128 bits.
    """
    members, links, stars = _joined(docs, False)
    labels = links.select(F.col("a").alias("v"), F.col("b").alias("label")).unionByName(links.select(F.col("b").alias("v"), F.col("b").alias("label")).distinct()) if stars else components(links)
    classes = members.where("n > 0").groupBy("v").agg(F.min("doc_id").alias("least"))
    named = classes.join(labels, "v", "left").select("v", "least", F.coalesce("label", "v").alias("label"))
    least = written(named.groupBy("label").agg(F.min("least").alias("component_id")))  # apart from the join, whose skew can then be split
    of_class = written(named.join(least, "label").select("v", "component_id"))
    rows = members.where("n > 0").join(of_class, "v").select("doc_id", "v", F.col("n").alias("n_shingles"), "component_id")
    return rows.unionByName(members.where("n = 0").select("doc_id", "v", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (
  select distinct doc_id, array_to_string(words[i:i+4], ' ') as shingle from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b using (shingle) where a.doc_id < b.doc_id group by all),
e as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
ties as (select a, b from e union select b, a from e),
reach as (select doc_id, doc_id as other from n union select r.doc_id, t.b from reach r join ties t on t.a = r.other),
least as (select doc_id, min(other) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(l.component_id, d.doc_id) as component_id
from documents d left join n using (doc_id) left join least l using (doc_id)
"""

"""Near duplicates by HyperMinHash: compressed registers, bands, corrected estimates, verification.

1. Registers. A text is the set of its distinct shingle hashes. Its sketch has REGISTERS registers; a register is the least hash value of its
   bucket, kept as the count of leading zeros (6 bits) and the MANTISSA bits behind the first one. Small sets would leave most buckets of one
   hash function empty, and equal empty buckets say nothing. So a set of n shingles uses k = 2^i <= n / 4 buckets of REGISTERS / k hash functions:
   nearly all registers are filled at any size. Sets close below the next power of two are sketched for it too, so two sets whose sizes may link have one layout in common.
2. Bands. BAND registers in a row are a band; sets that share one are asked further. Sets at similarity j share a band with
   probability 1 - (1 - j^6)^64: all but 7 in 10^14 at 0.85, one in 10^4 pairs at 0.1.
3. Estimates. In a band each entry brings BITS, the lowest mantissa bit of every register. Agreement is corrected for collisions
   (chance makes unequal registers agree), and pairs go that are MARGIN standard deviations below the threshold, one link in 10^10.
   What is left ties classes to clusters; no table of pairs is written, a class has one tie a band at most.
4. Verification. One text of each class goes to its cluster. There whole registers are compared, again corrected for collisions, and the pairs that are left
   are decided by the intersection of their whole sets. Pairs that one component holds already are skipped.

Bands of more than TILE entries and clusters of more than TILE_SHINGLES are cut into parts by hash, and every two parts meet in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .jaccard_join import TILE_SHINGLES, _bit, _class, bitmap, has, parted, shared, unite
from .ragged import buffers, mix, packed, shingle_sets, slices, unpacked
from .shared import discard, released, table, written

WIDTH = 3
#: The similarity as a fraction of 100.
OVER, UNDER = 85, 100
REGISTERS, BAND, MANTISSA = 384, 6, 10
BANDS = REGISTERS // BAND
#: Most buckets of one hash function; REGISTERS is a multiple of it.
MOST_BUCKETS = 128
MARGIN = 6.5
EMPTY = np.uint16(0xFFFF)
#: Entries of a band that one task takes whole; pairs asked at once; shingles that a set counts as at least in a cluster's size.
TILE, PAIRS, LEAST_SIZE = 1 << 12, 1 << 18, 256


def _sets(batch: pa.RecordBatch):
    data, offsets = buffers(batch.column("text"))
    for i, j in slices(offsets):
        yield from shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WIDTH)


def layouts(n: int) -> list[int]:
    """Buckets of the layouts of a set of n members: linked sets have one in common."""
    k = 1
    while k < MOST_BUCKETS and 8 * k <= n:
        k *= 2
    # a larger set of the next layout has 8 * k members at least and links with sets of OVER / UNDER of that
    return [k, 2 * k] if k < MOST_BUCKETS and UNDER * n >= OVER * 8 * k else [k]


def compress(x: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 64-bit values as 16 bits; values below 2^11 count as the least."""
    x = x >> np.uint64(11)
    exponent = np.frexp(x.astype(np.float64))[1]
    zeros = np.minimum(53 - exponent, 52).astype(np.uint64)
    rest = (x << (zeros + np.uint64(1))) & np.uint64((1 << 53) - 1)
    return ((zeros << np.uint64(MANTISSA)) | (rest >> np.uint64(53 - MANTISSA))).astype(np.uint16)


def registers(s: np.ndarray, k: int) -> np.ndarray:
    """The compressed registers of a set, of k buckets of REGISTERS / k hash functions."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    filled = np.zeros(REGISTERS, bool)
    functions = REGISTERS // k
    seeds = mix(np.arange(1, functions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    step = max(1, (1 << 18) // functions)
    for a in range(0, len(s), step):
        h = mix(s[None, a : a + step] ^ seeds[:, None])
        bucket = (h & np.uint64(k - 1)).astype(np.int64) + k * np.arange(functions)[:, None]
        value = mix(h + np.uint64(1))
        np.minimum.at(least, bucket.ravel(), value.ravel())
        filled[bucket.ravel()] = True
    out = compress(least)
    out[~filled] = EMPTY
    return out


def bands(r: np.ndarray, k: int) -> np.ndarray:
    """64-bit keys of the bands of registers of layout k; bands without any filled register have none."""
    own = r.reshape(BANDS, BAND)
    h = mix(np.arange(BANDS, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(k))
    for j in range(BAND):
        h = mix(h ^ (own[:, j].astype(np.uint64) + np.uint64(j << 17)))
    return h[(own != EMPTY).any(axis=1)]


def lowest(r: np.ndarray) -> bytes:
    """The lowest mantissa bit of each register."""
    return np.packbits((r & 1).astype(bool)).tobytes()


def chance(n: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Probability that registers of two unrelated sets of about n members agree by collision in the zeros and `bits` bits of the mantissa."""
    n = np.atleast_1d(np.asarray(n, np.float64))
    total = np.zeros(len(n))
    split = 8  # pieces of a level, in which the density is taken as even
    for level in range(53):
        edge = 2.0 ** -(level + 1) * (1 + np.arange(split + 1) / split)
        log = np.log1p(-np.minimum(edge / k, 1 - 1e-16))
        p = np.exp(n[:, None] * log[None, :-1]) - np.exp(n[:, None] * log[None, 1:])
        total += (p * p).sum(axis=1) * split / 2**bits
    return total


def may_be(j_seen: np.ndarray, collided: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Whether pairs may reach the threshold: `j_seen` is the share of `used` registers that agree, `collided` the chance of unequal ones to do so."""
    j = OVER / UNDER
    at = j + (1 - j) * collided
    corrected = (j_seen - collided) / (1 - collided)
    spread = np.sqrt(at * (1 - at) / np.maximum(used, 1)) / (1 - collided)
    return corrected >= j - MARGIN * spread


def fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return UNDER * np.minimum(n, m) >= OVER * np.maximum(n, m)


# ---- sketches and bands


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, v (class), n; and, for the first text of a class in a task, its number u and a row of its own for each layout: k, regs, bits."""

    def run(batches):
        seen: set[bytes] = set()
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            columns: dict[str, list] = {x: [] for x in ("row", "v", "n", "u", "k", "regs", "bits")}

            def add(*values, columns=columns):
                for c, x in zip(columns.values(), values):
                    c.append(x)

            for row, s in enumerate(_sets(batch)):
                c = _class(s)
                if c in seen or not len(s):
                    add(row, c, len(s), None, None, None, None)
                    continue
                if len(seen) < 1 << 17:
                    seen.add(c)
                add(row, c, len(s), number, None, None, None)
                for k in layouts(len(s)):
                    r = registers(s, k)
                    add(None, c, len(s), number, k, r.tobytes(), lowest(r))
                number += 1
            ids = batch.column("doc_id").take(pa.array(columns["row"], pa.int64()))
            own = [pa.array([x is not None for x in columns["row"]]), ids, *(pa.array(columns[c], t) for c, t in (("v", pa.binary()), ("n", pa.int64()), ("u", pa.int64()), ("k", pa.int32()), ("regs", pa.binary()), ("bits", pa.binary())))]
            yield pa.RecordBatch.from_arrays(own, names=["member", "doc_id", "v", "n", "u", "k", "regs", "bits"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(released(run), f"member boolean, doc_id {id_type}, v binary, n long, u long, k int, regs binary, bits binary")


def posts(sketches: DataFrame, buckets: int) -> DataFrame:
    """h, u, n, k of every band entry that shares its band with a set of fitting size. Entries travel packed, without registers."""

    def run(batches):
        held: list = []
        count = 0

        def flush():
            h, u, n, k = (np.concatenate([x[c] for x in held]) for c in range(4))
            to = (h % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((u, to))
            h, u, n, k, to = h[order], u[order], n[order], k[order], to[order]
            used, at = np.unique(to, return_index=True)
            cut = [*at, len(to)]
            return pa.RecordBatch.from_arrays([pa.array(used), pa.array([packed(h[a:b], np.diff(u[a:b], prepend=0), n[a:b], k[a:b]) for a, b in zip(cut, cut[1:])], pa.binary())], names=["bucket", "entries"])

        for batch in batches:
            for u, n, k, x in zip(batch.column("u").to_pylist(), batch.column("n").to_pylist(), batch.column("k").to_pylist(), batch.column("regs")):
                h = bands(np.frombuffer(x.as_py(), np.uint16), k)
                held.append((h, np.full(len(h), u), np.full(len(h), n, np.int32), np.full(len(h), k, np.uint8)))
                count += len(h)
                if count > 1 << 20:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    def met(t: pa.Table) -> pa.Table:
        columns = [unpacked(x) for x in t.column("entries").to_pylist()]
        h, u, n, k = (np.concatenate([np.cumsum(x[c]) if c == 1 else x[c] for x in columns]) for c in range(4))
        order = np.lexsort((n, h))
        h, u, n, k = h[order], u[order], n[order], k[order]
        near = (h[1:] == h[:-1]) & fits(n[1:].astype(np.int64), n[:-1].astype(np.int64))  # neighbours in size decide
        keep = np.concatenate((near, [False])) | np.concatenate(([False], near)) if len(h) else np.zeros(0, bool)
        return pa.table({"h": pa.array(h[keep].view(np.int64)), "u": pa.array(u[keep]), "n": pa.array(n[keep].astype(np.int64)), "k": pa.array(k[keep].astype(np.int32))})

    return sketches.select("u", "n", "k", "regs").mapInArrow(released(run), "bucket long, entries binary").groupBy("bucket").applyInArrow(met, "h long, u long, n long, k int")


def tie(h, part, u, n, k, bits, cross, side) -> tuple[np.ndarray, np.ndarray]:
    """The classes of a bucket of bands, tied by the pairs whose estimate reaches the threshold: numbers and the smallest they are tied to.

    Entries in a band are in order of size, so an entry meets those behind it up to the size that may link; what one label holds is skipped.
    """
    order = np.lexsort((u, n, part, h))
    h, part, u, n, k, bits, cross, side = (x[order] for x in (h, part, u, n, k, bits, cross, side))
    vertex, number = np.unique(u, return_inverse=True)
    labels = np.arange(len(vertex))
    words = np.ascontiguousarray(bits).view(np.uint64)
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (part[1:] != part[:-1]))))
    # behind an entry: those of its band of at most UNDER / OVER of its size
    size = np.zeros(len(h), np.int64)
    for a, b in zip(new, np.append(new[1:], len(h))):
        size[a:b] = a + np.searchsorted(n[a:b], UNDER * n[a:b] // OVER, side="right")
    count = size - np.arange(len(h)) - 1
    # step d asks every entry and the d-th behind it, so early steps join most of what belongs together
    d = 1
    active = np.flatnonzero(count >= d)
    while len(active):
        for x in range(0, len(active), PAIRS):
            i = active[x : x + PAIRS]
            j = i + d
            apart = (labels[number[i]] != labels[number[j]]) & (~cross[i] | (side[i] != side[j]))
            i, j = i[apart], j[apart]
            agree = 1 - np.bitwise_count(words[i] ^ words[j]).sum(axis=1) / REGISTERS
            ok = may_be(agree, np.full(len(i), 0.5), np.full(len(i), REGISTERS))
            unite(labels, number[i[ok]], number[j[ok]])
        d += 1
        active = active[count[active] >= d]
    tied = np.flatnonzero(labels != np.arange(len(vertex)))
    return vertex[tied], vertex[labels[tied]]


def candidates(t: pa.Table) -> pa.Table:
    bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(-1, REGISTERS // 8)
    h, part, u, n, k = (t.column(x).to_numpy() for x in ("h", "part", "u", "n", "k"))
    cross, side = (t.column(x).to_numpy(zero_copy_only=False) for x in ("cross", "side"))
    a, b = tie(h, part, u, n, k, bits, cross, side)
    return pa.table({"a": a, "b": b})


# ---- verification


def chosen(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """v, n_bytes and the compressed text of every class in `wanted` (v, doc_id): texts are read again and a bitmap says which to send; a row too many does no harm."""

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


def estimates(regs: np.ndarray, sizes: np.ndarray, k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs of rows of whole registers of one layout may link, by the collision-corrected similarity."""
    used = ((regs[i] != EMPTY) | (regs[j] != EMPTY)).sum(axis=1)
    agree = ((regs[i] == regs[j]) & (regs[i] != EMPTY)).sum(axis=1)
    grid = np.unique(np.minimum(sizes[i], sizes[j]).astype(np.float64).round(-1))
    c = chance(np.maximum(grid, 1), k, MANTISSA)
    own = c[np.minimum(np.searchsorted(grid, np.minimum(sizes[i], sizes[j])), len(grid) - 1)]
    return may_be(agree / np.maximum(used, 1), own, used)


def verified(t: pa.Table) -> pa.Table:
    """Links between the classes of a bucket of clusters: pairs (a, b), b the smallest class of a's component."""
    key, part = t.column("label").to_numpy(), t.column("part").to_numpy()
    names = np.array([x.hex() for x in t.column("v").to_pylist()], dtype=object)
    order = np.lexsort((names, part, key))
    out: tuple[list, list] = ([], [])
    edge = np.flatnonzero(np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (part[order][1:] != part[order][:-1]), [True])))
    for x, y in zip(edge, edge[1:]):
        rows = order[x:y]
        own = t.take(rows)
        v = own.column("v").to_pylist()
        sets: list[np.ndarray] = []
        for a in range(0, len(rows), 256):
            few = own.slice(a, 256)
            texts = [pa.decompress(q, n, "zstd", asbytes=True) for q, n in zip(few.column("packed").to_pylist(), few.column("n_bytes").to_pylist())]
            sets += shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(q) for q in texts]))), WIDTH)
        sizes = np.array([len(s) for s in sets])
        by_size = np.argsort(sizes, kind="stable")
        side = own.column("side").to_numpy(zero_copy_only=False)
        cross = bool(own.column("cross")[0].as_py())
        sketches: dict[int, dict[int, np.ndarray]] = {}
        for r, s in enumerate(sets):
            for k in layouts(len(s)):
                sketches.setdefault(k, {})[r] = registers(s, k)
        labels = np.arange(len(rows))
        for k, held in sketches.items():
            members = np.array([r for r in by_size if r in held])
            regs, n = np.stack([held[r] for r in members]), sizes[members]
            reach = np.searchsorted(n, UNDER * n // OVER, side="right")
            for a in range(len(members)):
                near = np.arange(a + 1, reach[a])
                near = near[labels[members[near]] != labels[members[a]]]
                if cross:
                    near = near[side[members[near]] != side[members[a]]]
                for start in range(0, len(near), 256):
                    b = near[start : start + 256]
                    b = b[labels[members[b]] != labels[members[a]]]
                    if not len(b):
                        continue
                    b = b[estimates(regs, n, k, np.full(len(b), a), b)]
                    if not len(b):
                        continue
                    i, j = np.full(len(b), members[a]), members[b]
                    both = shared(sets, i, j)
                    ok = UNDER * both >= OVER * (sizes[i] + sizes[j] - both)
                    unite(labels, i[ok], j[ok])
        for a in np.flatnonzero(labels != np.arange(len(rows))):
            out[0].append(v[a])
            out[1].append(v[labels[a]])
    return pa.table({"a": pa.array(out[0], pa.binary()), "b": pa.array(out[1], pa.binary())})


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, v, n) and links between classes (a, b) that connect all classes of a component."""
    sketches = written(sketched(docs))
    members = sketches.where("member").select("doc_id", "v", "n", "u")
    layers = sketches.where("not member").select("u", "n", "k", "regs", "bits")
    entries = layers.count() * BANDS
    held = written(posts(layers, max(64, -(-entries // (1 << 18)))))
    # bands of one layout and number are of one class; the copies of a class from several tasks tie at once
    crowded = parted(held, "h", F.lit(1), TILE, "u").join(layers.select("u", "k", "bits"), ["u", "k"])
    bucket = F.pmod(F.xxhash64("h", "part"), F.lit(max(24, -(-held.count() // (1 << 16)))))
    ties = written(crowded.groupBy(bucket).applyInArrow(candidates, "a long, b long").distinct())
    discard(held)
    clusters = components(ties).select(F.col("v").alias("u"), "label")
    wanted = members.where("u is not null").join(clusters, "u")
    wanted = written(wanted.groupBy("v").agg(F.min("label").alias("label"), F.max("n").alias("n"), F.min("doc_id").alias("doc_id")))
    met = parted(wanted.select("v", "label", "n"), "label", F.greatest("n", F.lit(LEAST_SIZE)), TILE_SHINGLES, "v")
    total = wanted.agg(F.sum("n")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("label", "part"), F.lit(max(24, -(-total // (TILE_SHINGLES // 4)))))
    links = written(chosen(docs, wanted).join(met, "v").groupBy(bucket).applyInArrow(verified, "a binary, b binary").where("a <> b").distinct())
    return members.select("doc_id", "v", "n"), links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs` (doc_id, text).

    component_id is the smallest doc_id reachable by links, the row's own included; kept says that it is the row's own. Null and blank texts have
    no shingles, are linked with nothing and stay. Rows with repeated ids are vertices of their own; rows with null ids join components
    without naming them, and stay only where nothing names theirs. Sets are compared by 64-bit hashes of their shingles; classes by 128 bits.
    """
    members, links = linked(docs)
    labels = components(links)
    classes = members.where("n > 0").groupBy("v").agg(F.min("doc_id").alias("least"))
    named = classes.join(labels, "v", "left").select("v", "least", F.coalesce("label", "v").alias("label"))
    least = written(named.groupBy("label").agg(F.min("least").alias("component_id")))
    of_class = written(named.join(least, "label").select("v", "component_id"))
    rows = members.where("n > 0").join(of_class, "v").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = rows.unionByName(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (
  select distinct doc_id, array_to_string(words[i:i+2], ' ') as shingle from (select doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b using (shingle) where a.doc_id < b.doc_id group by all),
e as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
ties as (select a, b from e union select b, a from e),
reach as (select doc_id, doc_id as other from n union select r.doc_id, t.b from reach r join ties t on t.a = r.other),
least as (select doc_id, min(other) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(l.component_id, d.doc_id) as component_id, coalesce(l.component_id, d.doc_id) = d.doc_id as kept
from documents d left join n using (doc_id) left join least l using (doc_id)
"""

"""Exact removal of repeated substrings with per-shard suffix arrays.

A byte goes if a window of WINDOW bytes over it also starts earlier: in a smaller doc_id, or earlier in the
same document. Suffix arrays over a whole corpus would be sorted and moved in full, so windows are first sent where their
likes are; hashes only say where to, bytes decide what goes:

1. Anchors. Of the hashed GRAM-byte strings in a window the smallest is its anchor. Equal windows have equal
   anchors, so an anchor that occurs once in the corpus settles all its windows. A bitmap of bounded size says which occur twice.
2. Contexts. Consecutive windows of one anchor form a context, text around the anchor. A task sorts its contexts' starts by the text
   that follows, refining groups that are still tied; of equal ones the first is sent to its anchor's bucket, the others' windows go.
   So a hot anchor gets a context for each task and wording, not one for each occurrence.
3. Shards. A bucket sorts the contexts of all tasks alike. Where wordings differ, the suffix array of a shard of them is refined from
   7-byte keys by doubling ranks inside groups that are still tied (Larsson and Sadakane), common prefixes follow by Kasai's rule over
   chunks of the text at once, and neighbours that share WINDOW bytes are equal windows. A bucket of
   more than SHARD bytes has several shards, merged by binary search of first windows in the shards before.
4. The removed windows of each row are gathered, joined to its text and cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jaccard_join import BUCKET, MAP_BITS, bitmap, has
from .ragged import M1, M2, M3, buffers, gathered, mix, packed, slices, unpacked
from .shared import fresh, release, released, table, written

WINDOW, GRAM, SHARD, STEP = 100, 32, 1 << 21, 128
#: Bytes scanned for anchors at once; bytes of contexts that a task sorts at once; log2 of the bits of a bitmap at most.
SCAN, CHUNK, MOST_BITS = 1 << 18, 1 << 23, 29
_LAST = (1 << 63) - 1


# ---- suffix arrays


def suffix_array(text: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Suffixes in order of their first `depth` bytes at least; an end sorts before any byte."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text.astype(np.uint64) + 1  # 9 bits a byte: 7 bytes in a key
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | wide[k : n + k]
    sa = np.argsort(key, kind="stable")
    rank = np.zeros(n + 1, np.int64)  # one more than the place of a suffix's group; 0 beyond the end
    tied = np.arange(n)  # places in sa whose order is open
    key, h = key[sa], 7
    while True:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        rank[sa[tied]] = group + 1
        alone = new & np.concatenate((new[1:], [True]))
        tied, group = tied[~alone], group[~alone]
        if h >= depth or not len(tied):
            return sa
        own = sa[tied]
        key = (group.astype(np.uint64) << np.uint64(32)) | rank[np.minimum(own + h, n)].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        sa[tied], key = own[order], key[order]
        h *= 2


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """Bytes, up to `most`, that each suffix shares with the one before it in `sa`.

    Kasai's rule: in text order the number falls by one at most. It is followed in all chunks of STEP positions side by side. The
    rule needs an order that is settled where the two suffixes part, so after a number that reached `most` bytes are compared anew.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate((text.astype(np.int16), np.full(most + 1, -1, np.int16)))
    out, h = np.zeros(n, np.int64), np.zeros(-(-n // STEP), np.int64)
    for k in range(min(STEP, n)):
        i = np.arange(k, n, STEP)
        j = before[i]
        fresh = np.flatnonzero((h[: len(i)] == most) & (j >= 0))
        h = np.maximum(h[: len(i)] - 1, 0)
        if len(fresh):
            reach = np.arange(most)
            differs = padded[np.minimum(i[fresh][:, None] + reach, n)] != padded[np.minimum(j[fresh][:, None] + reach, n)]
            h[fresh] = np.where(differs.any(axis=1), differs.argmax(axis=1), most)
            h[fresh] = np.minimum(h[fresh], n - np.maximum(i[fresh], j[fresh]))
        h[j < 0] = 0
        live = np.flatnonzero(j >= 0)
        while len(live):
            a, b = i[live] + h[live], j[live] + h[live]
            live = live[(h[live] < most) & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)]) & (a < n) & (b < n)]
            h[live] += 1
        out[i] = h
    return out[sa]


def _row(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    return text[at[:, None] + np.arange(WINDOW)]


def find_windows(text: np.ndarray, sorted_at: np.ndarray, other: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the windows of `other` at `at` are among the sorted windows of `text`, by binary search."""
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sorted_at), np.int64)
    want = _row(other, at)
    while (open_ := lo < hi).any():
        mid = (lo + hi)[open_] // 2
        differs = (have := _row(text, sorted_at[mid])) != (asked := want[open_])
        k = differs.argmax(axis=1)
        less = have[np.arange(len(k)), k] < asked[np.arange(len(k)), k]
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)
    out = lo < len(sorted_at)
    out[out] = (_row(text, sorted_at[lo[out]]) == want[out]).all(axis=1)
    return out


def later_windows(flat: np.ndarray, offsets: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte of `flat` whether a window starts there that also starts earlier, by (id, place).

    Text i lies between offsets i and i + 1, in document ids[i] from starts[i]; texts come in this order. Shards are cut between documents.
    """
    later, done, i = np.zeros(len(flat), bool), [], 0
    edge = np.concatenate((np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))), [len(ids)])) if len(ids) else np.zeros(1, int)
    while i < len(ids):
        j = int(edge[max(np.searchsorted(edge, i, side="right"), np.searchsorted(offsets[edge], offsets[i] + SHARD, side="right") - 1)])
        base, lengths = int(offsets[i]), np.diff(offsets[i : j + 1])
        text = flat[base : offsets[j]]
        owner = np.repeat(np.arange(i, j), lengths)
        whole = np.arange(len(text)) + base + WINDOW <= offsets[owner + 1]
        sa = suffix_array(text)
        equal = common_prefixes(text, sa) >= WINDOW
        kept = whole[sa]
        group, at = np.cumsum(~equal)[kept], sa[kept]
        doc, place = ids[owner[at]], starts[owner[at]] + at + base - offsets[owner[at]]
        order = np.lexsort((place, doc, group))
        group, at, doc, place = group[order], at[order], doc[order], place[order]
        new = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        own = at[new]
        known = np.zeros(len(own), bool)
        for other, places in done:
            known |= find_windows(other, places, text, own)
        later[base + at] = (doc != doc[new][number]) | (place != place[new][number]) | known[number]
        if j < len(ids) or done:
            done.append((text, own))
        i = j
    return later


# ---- anchors and contexts


def contexts(data: np.ndarray, offsets: np.ndarray):
    """Runs of windows with one anchor: row, first window, windows, hash of the anchor. At most 2^24 bytes at once."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none.astype(np.uint64)
    view = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data).tobytes(), strides=(1,))
    m = n - GRAM + 1
    g = np.full(m, M1)
    for k in range(0, GRAM, 8):
        g = (g ^ view[k : k + m]) * M2
        g ^= g >> np.uint64(31)
    g = mix(g)
    bits = np.uint64(24)  # places below hashes
    least = (g >> bits << bits) | np.arange(m, dtype=np.uint64)
    reach, width = 1, WINDOW - GRAM + 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: n - WINDOW + 1], least[width - reach : width - reach + n - WINDOW + 1])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - WINDOW + 1]
    valid = np.arange(n - WINDOW + 1) + WINDOW <= offsets[row + 1]
    start = np.flatnonzero(valid)
    if not len(start):
        return none, none, none, none.astype(np.uint64)
    new = np.concatenate(([True], (anchor[start][1:] != anchor[start][:-1]) | (row[start][1:] != row[start][:-1])))
    s0 = start[new]
    count = np.diff(np.concatenate((np.flatnonzero(new), [len(start)])))
    return row[s0], s0 - offsets[row[s0]], count, g[anchor[s0]]


def _scan(batch):
    """The contexts of a batch, piece by piece: places in the batch's data, hashes of anchors, rows, first windows, windows.

    A text longer than SCAN is read in pieces that overlap by a window; a context at a border is just two contexts.
    """
    data, offsets = buffers(batch.column("text"))
    for i, j in slices(offsets, SCAN):
        a, b = int(offsets[i]), int(offsets[j])
        if j == i + 1:
            for c in range(a, max(a + 1, b - WINDOW + 1), SCAN):
                end = min(b, c + SCAN + WINDOW - 1)
                _, s, k, h = contexts(data[c:end], np.array([0, end - c]))
                yield data, c + s, h, np.full(len(s), i), c - a + s, k
        else:
            row, s, k, h = contexts(data[a:b], offsets[i : j + 1] - a)
            yield data, offsets[i + row] + s, h, i + row, s, k


def _bits_of(h: np.ndarray, size: int) -> np.ndarray:
    return (mix((M1 ^ h) * M3) >> np.uint64(64 - size)).astype(np.int64)


def twice(rows: DataFrame, buckets: int, size: int) -> np.ndarray:
    """Bitmap of the anchors that occur more than once; a task sends an anchor twice at most each time."""

    def run(batches):
        held, n = [], 0

        def flush():
            h = np.sort(np.concatenate(held))
            again = h[1:] == h[:-1]
            h = h[~(np.concatenate(([False], again)) & np.concatenate(([False, False], again[:-1]))[: len(h)])]
            to = (mix(h) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            used, at = np.unique(to[order], return_index=True)
            cut = [*at, len(order)]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([h[order[a:b]].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["bucket", "h"])

        for batch in batches:
            for _, _, h, *_ in _scan(batch):
                held.append(h)
                n += len(h)
                if n > 1 << 20:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def found(t: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in t.column("h")])
        h.sort()
        return pa.table({"bit": np.unique(_bits_of(h[1:][h[1:] == h[:-1]], size))})

    return bitmap(rows.select("text").mapInArrow(released(run), "bucket long, h binary").groupBy("bucket").applyInArrow(found, "bit long"), size)


def sorted_starts(flat: np.ndarray, offsets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts in order of anchor, length and text, and whether each differs from the one before it.

    The order is refined 8 bytes at a time, only in groups that are neither single nor equal to their end.
    """
    lengths = np.diff(offsets)
    width = -(-int(lengths.max()) // 8) * 8
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((flat, np.zeros(width, np.uint8))), width)[offsets[:-1]]
    rows[np.arange(width) >= lengths[:, None]] = 0
    words = rows.view(">u8").astype(np.uint64)
    del rows
    order = np.lexsort((words[:, 0], lengths, h))
    words, lengths, h = words[order], lengths[order], h[order]
    new = np.concatenate(([True], (words[1:, 0] != words[:-1, 0]) | (lengths[1:] != lengths[:-1]) | (h[1:] != h[:-1])))
    for k in range(1, width // 8):
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        tied = np.flatnonzero(first != np.arange(len(new)))
        open_ = np.zeros(len(new), bool)
        open_[first[tied[(words[tied] != words[first[tied]]).any(axis=1)]]] = True
        own = np.flatnonzero(open_[first])
        if not len(own):
            break
        by = np.lexsort((words[own, k], first[own]))
        order[own], words[own] = order[own[by]], words[own[by]]
        new[own[1:]] |= (words[own[1:], k] != words[own[:-1], k]) | (first[own[1:]] != first[own[:-1]])
    return order, new


def _firsts(flat, offsets, h, ids, rk, s):
    """Of equal contexts the first by (id, place): order of the contexts without repeated ones, their groups, and which come later than their group's first."""
    order, new = sorted_starts(flat, offsets, h)
    group = np.cumsum(new) - 1
    by = np.lexsort((rk[order], s[order], ids[order], group))
    order, group = order[by], group[by]
    i, p, r = ids[order], s[order], rk[order]
    same = np.concatenate(([False], (group[1:] == group[:-1]) & (i[1:] == i[:-1]) & (p[1:] == p[:-1]) & (r[1:] == r[:-1])))
    order, group, i, p = order[~same], group[~same], i[~same], p[~same]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))[group]
    return order, group, (i != i[first]) | (p != p[first])


def joined_runs(ids: np.ndarray, rk: np.ndarray, s: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows, those that follow each other in a row as one."""
    order = np.lexsort((s, rk, ids))
    ids, rk, s, k = ids[order], rk[order], s[order], k[order]
    new = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (rk[1:] != rk[:-1]) | (s[1:] != s[:-1] + k[:-1])))) if len(ids) else np.zeros(0, int)
    return ids[new], rk[new], s[new], np.add.reduceat(k, new) if len(new) else k


def sent_contexts(rows: DataFrame, bits, size: int, buckets: int) -> DataFrame:
    """bucket and packed: contexts whose anchor may occur twice, first ones of their task, by anchor; and, in buckets of their own, runs that go."""

    def dealt(to, *columns):
        order = np.argsort(to, kind="stable")
        used, at = np.unique(to[order], return_index=True)
        return used, [order[a:b] for a, b in zip(at, [*at[1:], len(order)])]

    def run(batches):
        def flush():
            flat = np.concatenate([x[0] for x in held])
            k, h, ids, rk, s = (np.concatenate([x[c] for x in held]) for c in range(1, 6))
            offsets = np.concatenate(([0], np.cumsum(k + WINDOW - 1)))
            order, _, later = _firsts(flat, offsets, h, ids, rk, s)
            goes = joined_runs(*(x[order[later]] for x in (ids, rk, s, k)))
            order = order[~later]
            used, parts = dealt((mix(h[order]) % np.uint64(buckets)).astype(np.int64))
            blobs = [packed(h[o], k[o].astype(np.int16), ids[o], rk[o], s[o], gathered(flat, offsets[o], k[o] + WINDOW - 1)) for o in (order[x] for x in parts)]
            more, parts = dealt(buckets + (mix(goes[1].view(np.uint64)) % np.uint64(buckets)).astype(np.int64))
            blobs += [packed(*(x[o] for x in goes)) for o in parts]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate((used, more)), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "packed"])

        held, n = [], 0
        for batch in batches:
            ids, rk = batch.column("id").to_numpy(), batch.column("rk").to_numpy()
            for data, at, h, row, s, k in _scan(batch):
                ok = has(bits.value, _bits_of(h, size))
                at, h, row, s, k = at[ok], h[ok], row[ok], s[ok], k[ok]
                if len(at):
                    held.append((gathered(data, at, k + WINDOW - 1), k, h, ids[row], rk[row], s))
                    n += len(held[-1][0])
                if n > CHUNK:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return rows.mapInArrow(released(run), "bucket long, packed binary")


def settle(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """The removed runs of a bucket of contexts: ids, rk, first windows, windows."""
    columns = list(zip(*(unpacked(x) for x in blobs)))
    h, k, ids, rk, s, flat = (np.concatenate(c) for c in columns)
    del columns
    k = k.astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(k + WINDOW - 1)))
    order, group, later = _firsts(flat, offsets, h, ids, rk, s)
    out = [tuple(x[order[later]] for x in (ids, rk, s, k))]
    order, group = order[~later], group[~later]
    # of each wording one context stands for all of the same place, where its anchor has several wordings
    stands = np.concatenate(([True], group[1:] != group[:-1]))
    anchors, number, wordings = np.unique(h[order[stands]], return_inverse=True, return_counts=True)
    several = (wordings > 1)[number]
    rep = order[stands][several]
    if len(rep):
        by = np.lexsort((s[rep], ids[rep]))
        rep, wording = rep[by], group[stands][several][by]
        lengths = k[rep] + WINDOW - 1
        at = np.concatenate(([0], np.cumsum(lengths)))
        goes = later_windows(gathered(flat, offsets[rep], lengths), at, ids[rep], s[rep])
        step = np.flatnonzero(np.diff(np.concatenate(([0], goes.astype(np.int8), [0]))))
        a, b = step[::2], step[1::2]
        own = np.searchsorted(at, a, side="right") - 1
        # all that hold the wording at its first place
        lo, hi = np.searchsorted(group, wording[own]), np.searchsorted(group, wording[own], side="right")
        many = hi - lo
        holder = order[gathered(np.arange(len(order)), lo, many)]
        out.append((ids[holder], rk[holder], s[holder] + np.repeat(a - at[own], many), np.repeat(b - a, many)))
    return joined_runs(*(np.concatenate(x) for x in zip(*out)))


def removed_windows(docs: DataFrame) -> DataFrame:
    """id, rk, s, k: runs of removed windows of each row. A null doc_id counts as the largest."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64("doc_id", text).alias("rk"), text.alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = min(MOST_BITS, max(MAP_BITS, int(total // 16).bit_length()))
    bits = spark.sparkContext.broadcast(twice(rows, max(64, -(-total // 35 // BUCKET)), size))
    buckets = max(64, -(-total * 3 // 2 // SHARD))

    def run(key, t):
        blobs = t.column("packed").to_pylist()
        if key[0].as_py() < buckets:
            out = settle(blobs)
        else:
            out = joined_runs(*(np.concatenate(x) for x in zip(*(unpacked(x) for x in blobs))))
        release()
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("id", "rk", "s", "k"), out)})

    return sent_contexts(rows, bits, size, buckets).groupBy("bucket").applyInArrow(run, "id long, rk long, s long, k long")


def cut(docs: DataFrame, runs: DataFrame, with_text: bool = True) -> DataFrame:
    """All rows and columns of `docs` with n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text, named by `fresh`.

    Where a cut divides a character, its remaining bytes become U+FFFD in kept_text; the digest is of the bytes.
    """
    names = docs.columns
    more = [fresh(names, x) for x in ("n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text)]
    key_id, key_rk, places = (fresh(names, x) for x in ("cut_id", "cut_rk", "cut_runs"))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({key_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), key_rk: F.xxhash64("doc_id", text)})
    each = runs.groupBy(F.col("id").alias(key_id), F.col("rk").alias(key_rk)).agg(F.collect_set(F.struct("s", "k")).alias(places))
    joined = keyed.join(each, [key_id, key_rk], "left").select(*[F.col(f"`{c}`") for c in names], F.col(places).s.alias(fresh(names, "cut_s")), F.col(places).k.alias(fresh(names, "cut_k")))

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            rows = []
            for i, (s, k) in enumerate(zip(batch.column(len(names)), batch.column(len(names) + 1))):
                own = left = data[offsets[i] : offsets[i + 1]]
                gone = spans = 0
                if s.is_valid:
                    edge = np.zeros(len(own) + 1, np.int64)
                    start, count = np.array(s.as_py()), np.array(k.as_py())
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + count + WINDOW - 1, -1)
                    goes = np.cumsum(edge)[:-1] > 0
                    left = own[~goes]
                    gone, spans = int(goes.sum()), int(goes[:1].sum() + (goes[1:] & ~goes[:-1]).sum())
                rows.append((len(own), gone, spans, hashlib.sha256(left).hexdigest(), *[left.tobytes().decode("utf-8", "replace")] * with_text))
            added = [pa.array([r[x] for r in rows], t.type) for x, t in enumerate(own_types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *added], names=[*names, *more])

    own_types = [pa.field(n, pa.int64() if x < 3 else pa.string()) for x, n in enumerate(more)]
    kinds = [T.LongType()] * 3 + [T.StringType()] * 2
    return joined.mapInArrow(released(run), T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(more, kinds))]))


def deduplicate(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """`cut` with the removed windows of `docs` (doc_id, text and more).

    Null texts are empty and lose nothing. Rows with equal ids count as one document whose rows all begin at 0, so equal rows
    do not remove each other; null ids come after all others. Hashes send windows to where they are compared byte by byte.
    """
    return cut(docs, written(removed_windows(docs)), with_text)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

"""Ranked lexical search over a tiered index.

1. Counting. One pass over the texts keeps, for each document, its length and its counts of the terms that the items ask for; collection figures
   (N, L, df) are sums over it.
2. Index. Documents are dealt to shards where they are read. A posting's impact is what the term adds to the score of any item that has it once.
   A shard's postings of highest impact are its first tier, and so on: rare terms are in it whole, of common ones the short and
   repetitive documents. A tier is one row of a shard: its postings, and for every term the residual bound, the largest impact in lower tiers.
3. Search. Every shard scores all items on its first tier. The 10th largest partial score of an item over all shards is a bound that
   the result reaches. A shard is done with an item when no document's partial score and residuals can reach the bound unless its
   score is complete already; items without that proof fall through, in that shard, to the next tier, with a better bound. In
   the last tier nothing is residual, so the result is exact whatever the data. Only bounds (items x 10) and results travel.

Items are taken in blocks of bounded size, so what is broadcast (terms, weights, bounds) does not grow with the corpus or the number of items.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ragged import LOWER, buffers, packed, slices, unpacked, word_hashes, words
from .shared import discard, released, shared_dir, table, written

#: Bytes outside of terms; all bytes of characters beyond ASCII are inside.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
#: A shard ends at so many postings or documents. Shares of a shard's postings that the tiers but the last reach to.
SHARD_POSTINGS, SHARD_DOCS, TIERS = 1 << 20, 1 << 11, (1 / 8, 1 / 2, 7 / 8)
#: A block of items ends at so many different terms or at so many items.
BLOCK_TERMS, BLOCK_ITEMS = 1 << 18, 1 << 12
UNITS = 1_000_000_000
SALTS = 32


class Lexicon:
    """Numbers of terms, found by hash and confirmed by their bytes."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        lengths = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.cumsum(lengths) - lengths
        h = word_hashes(data, starts, lengths)
        order = np.argsort(h, kind="stable")
        self.h, self.number, self.data, self.starts, self.lengths = h[order], order.astype(np.int64), data, starts[order], lengths[order]
        if len(np.unique(h)) < len(h):
            raise ValueError("two terms have one 64-bit hash")

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The term's number of each segment, -1 where it is none."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.h) or not len(starts):
            return out
        h = word_hashes(data, starts, lengths)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = np.flatnonzero((self.h[at] == h) & (self.lengths[at] == lengths))
        own = at[hit]
        size = lengths[hit]
        ends = np.cumsum(size)
        inner = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
        alike = data[np.repeat(starts[hit], size) + inner] == self.data[np.repeat(self.starts[own], size) + inner]
        same = np.logical_and.reduceat(alike, ends - size) if len(ends) else np.zeros(0, bool)
        out[hit[same]] = self.number[own[same]]
        return out


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(UPPER_LOWER))


def counted(docs: DataFrame, lexicon) -> DataFrame:
    """u (a number), doc_id, n (terms with repeats) and the packed counts (term numbers, tf) of the lexicon's terms, of every row with a term; null texts have none."""

    def run(batches):
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j in slices(offsets):
                own = LOWER[data[offsets[i] : offsets[j]]]
                starts, lengths, first = words(own, offsets[i : j + 1] - offsets[i], OUTSIDE)
                n = np.diff(first)
                found = lexicon.value.find(own, starts, lengths)
                row = np.repeat(np.arange(j - i), n)[found >= 0]
                width = max(1, len(lexicon.value.h))
                pair, tf = np.unique(row * width + found[found >= 0], return_counts=True)
                edge = np.searchsorted(pair, np.arange(j - i + 1) * width)
                term = (pair % width).astype(np.int32)
                rows = np.flatnonzero(n > 0)
                got = [packed(term[edge[r] : edge[r + 1]], tf[edge[r] : edge[r + 1]].astype(np.int32)) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(len(rows))), ids.slice(i, j - i).take(pa.array(rows)), pa.array(n[rows].astype(np.int64)), pa.array(got, pa.binary())], names=["u", "doc_id", "n", "counts"])
                number += len(rows)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(released(run), f"u long, doc_id {id_type}, n long, counts binary")


def frequencies(counts: DataFrame) -> DataFrame:
    """term, df: documents that hold a term, summed in tasks first."""

    def run(batches):
        total: dict[int, int] = {}
        for batch in batches:
            held = [unpacked(x.as_py())[0] for x in batch.column("counts")]
            for t, n in zip(*(x.tolist() for x in np.unique(np.concatenate(held), return_counts=True))) if held else ():
                total[t] = total.get(t, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["term", "df"])

    return counts.select("counts").mapInArrow(released(run), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def parts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term adds to a score for each unit of its weight, in a document of n terms."""
    m = 100 - 75 + (75 * n * documents) // length
    return (UNITS * tf) // (1000 * tf + 8 * m)


TIER = "shard long, tier int, n_docs long, postings binary"


def indexed(counts: DataFrame, weights, documents: int, length: int) -> DataFrame:
    """The tiers of all shards, a row each: term numbers, edges, documents (places in the shard), parts, and per term the largest part in lower tiers.

    `weights`: the weight of each term, broadcast. Nothing is shuffled: a shard is what one task read, up to a number of postings.
    """

    def tiers(number, n, held):
        doc = np.repeat(np.arange(len(n)), [len(x[0]) for x in held])
        term, tf = (np.concatenate([x[k] for x in held]).astype(np.int64) for k in (0, 1))
        part = parts(tf, np.array(n, np.int64)[doc], documents, length)
        order = np.lexsort((doc, -part, term))
        term, doc, part = term[order], doc[order], part[order]
        impact = weights.value[term] * part
        new = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
        size = np.diff(np.append(new, len(term)))
        place = np.arange(len(term)) - np.repeat(new, size)
        falling = -np.sort(-impact)
        upto = [np.add.reduceat(impact >= falling[int(len(falling) * share)], new, dtype=np.int64) if len(new) else size for share in TIERS] + [size]
        low = np.zeros_like(size)
        for tier, high in enumerate(upto):
            own = (place >= np.repeat(low, size)) & (place < np.repeat(high, size))
            bound = np.where(high < size, part[np.minimum(new + high, len(term) - 1)], 0) if len(term) else size
            edge = np.cumsum(np.concatenate(([0], high - low)))
            yield number, tier, len(n), packed(*(x.astype(np.int32) for x in (term[new], edge, doc[own], part[own], bound)))
            low = high

    def run(batches):
        n, held, postings, first = [], [], 0, None

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*tiers(first, n, held)), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["shard", "tier", "n_docs", "postings"])

        for batch in batches:
            for u, m, x in zip(batch.column("u").to_pylist(), batch.column("n").to_pylist(), batch.column("counts")):
                own = unpacked(x.as_py())
                if held and (u != first + len(n) or postings + len(own[0]) > SHARD_POSTINGS or len(n) >= SHARD_DOCS):
                    yield flush()
                    n, held, postings = [], [], 0
                if not held:
                    first = u
                n.append(m)
                held.append(own)
                postings += len(own[0])
        if held:
            yield flush()

    return counts.select("u", "n", "counts").mapInArrow(released(run), TIER)


def stored(index: DataFrame) -> DataFrame:
    """`index` as a table of one folder a tier, so lower tiers are read only by those that fall through."""
    path = shared_dir(index.sparkSession)
    index.write.partitionBy("tier").parquet(path)
    out = index.sparkSession.read.schema(index.schema).parquet(path)
    out.written_at = path
    return out


class Shard:
    """The tiers of one shard, first to last known, to score items on."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("tier")
        self.n_docs = int(rows["n_docs"].iloc[0])
        self.tiers = [unpacked(x) for x in rows["postings"]]
        self.terms = self.tiers[0][0]
        self.bound = self.tiers[-1][4].astype(np.int64)

    def scores(self, item: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        """Partial scores of all documents, the residual each may gain, and that of a document that no posting named; exact integers.

        `item`: term numbers and weight times repeats.
        """
        partial, settled, rest = np.zeros(self.n_docs, np.int64), np.zeros(self.n_docs, np.int64), 0
        at = np.minimum(np.searchsorted(self.terms, item[0]), max(len(self.terms) - 1, 0))
        if not len(self.terms):
            return partial, settled, 0
        held = (self.terms[at] == item[0]) & (item[1] > 0)
        for k, w in zip(at[held].tolist(), item[1][held].tolist()):
            residual = w * int(self.bound[k])
            rest += residual
            for _, edge, doc, impact, _ in self.tiers:
                own = slice(edge[k], edge[k + 1])
                partial[doc[own]] += w * impact[own].astype(np.int64)
                if residual:
                    settled[doc[own]] += residual
        return partial, rest - settled, rest


def _round(items, k: int):
    """The function of one shard in one round: `pending` names its items (null: all); the items' bounds are broadcast beside their terms."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(pdf)
        weights, floors = items.value
        wanted = pdf["pending"].iloc[0]
        wanted = np.arange(len(weights)) if wanted is None else np.frombuffer(wanted, np.int32)
        last = not shard.bound.any()
        item, doc, score, kind, left = [], [], [], [], []
        for q in wanted.tolist():
            partial, gain, _ = shard.scores(weights[q])
            low = np.partition(partial, len(partial) - k)[-k:] if len(partial) > k else partial
            # the k-th score of the result is at least this
            floor = max(int(floors[q]), int(low.min()) if len(low) == k else 0, 1)
            can = partial + gain >= floor
            if last or not (gain[can] > 0).any():
                own = np.flatnonzero(can)  # ties with the floor are all there
                few = partial[own]
            else:
                left.append(q)
                few = low[low > 0]
                own = np.full(len(few), -1)
            item += [q] * len(own)
            doc += own.tolist()
            score += few.tolist()
            kind += [int(bool(left) and left[-1] == q)] * len(own)
        number = int(pdf["shard"].iloc[0])
        out = pd.DataFrame({"shard": number, "item": item, "doc": doc, "score": score, "kind": kind, "pending": None})
        if left:
            out = pd.concat([out, pd.DataFrame({"shard": [number], "item": [-1], "doc": [-1], "score": [0], "kind": [2], "pending": [np.array(left, np.int32).tobytes()]})], ignore_index=True)
        return out

    return run


#: kind 0: a result of its shard; 1: a partial score; 2: the items that fall through.
FOUND = "shard long, item int, doc long, score long, kind int, pending binary"


def top(rows: DataFrame, k: int, by: list, spread: str) -> DataFrame:
    """The k first rows of each item, found in parts first."""
    part = Window.partitionBy("item", F.pmod(F.xxhash64(spread), F.lit(SALTS))).orderBy(*by)
    few = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= k)


def search(index: DataFrame, weights: list, k: int) -> DataFrame:
    """shard, item, doc, score: of each item the k best of each shard that may be among the k best of all, ties included.

    `weights`: for each item its term numbers and weights times repeats.
    """
    spark = index.sparkSession
    floors = np.zeros(len(weights), np.int64)
    found, pending = [], None
    for tier in range(len(TIERS) + 1):
        rows = index.where(F.col("tier") <= tier)
        step = _round(spark.sparkContext.broadcast((weights, floors)), k)
        if pending is None:  # a shard is one row

            def first(frames, step=step):
                for pdf in frames:
                    for i in range(len(pdf)):
                        yield step(pdf.iloc[i : i + 1])

            got = written(rows.withColumn("pending", F.lit(None).cast("binary")).mapInPandas(released(first), FOUND))
        else:
            got = written(rows.join(pending, "shard").groupBy("shard").applyInPandas(step, FOUND))
        found.append(got.where("kind = 0").select("shard", "item", "doc", "score"))
        pending = got.where("kind = 2").select("shard", "pending")
        if tier == len(TIERS) or not pending.limit(1).count():
            break
        floors = floors.copy()
        for r in top(got.where("kind < 2"), k, [F.desc("score")], "shard").where(F.col("rank") == k).select("item", "score").collect():  # a row an item of the block
            floors[r["item"]] = max(floors[r["item"]], r["score"])
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def blocks(items: DataFrame):
    """Blocks of items as lists of (number, terms with repeats as a dict); an item without terms is in none. Items come to the driver one after another."""
    block, terms = [], set()
    for row in items.toLocalIterator():
        own: dict[str, int] = {}
        for t in terms_of(row["text"]):
            own[t] = own.get(t, 0) + 1
        if not own:
            continue
        if block and (len(block) >= BLOCK_ITEMS or len(terms) + len(own) > BLOCK_TERMS):
            yield block, sorted(terms)
            block, terms = [], set()
        block.append((row["item_number"], own))
        terms |= own.keys()
    if block:
        yield block, sorted(terms)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of `items` (item_id, text) the k best rows of `docs` (doc_id, text) with a score above 0.

    Equal scores come by ascending doc_id, null ids first. Every row of `docs` is a document of its own and every row of `items` an item of
    its own, whatever its id, so repeated ids are ranked each by itself. Null and empty texts have no terms: such items have no rows, such documents
    are not counted. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    numbered = written(items.select("item_id", "text").withColumn("item_number", F.monotonically_increasing_id()))
    id_type = docs.schema["doc_id"].dataType
    names = numbered.select("item_number", "item_id")
    out = None
    for block, terms in blocks(numbered.select("item_number", "text")):
        lexicon = spark.sparkContext.broadcast(Lexicon(terms))
        counts = written(counted(docs, lexicon))
        documents, length = counts.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            continue
        number = {t: i for i, t in enumerate(terms)}
        df = dict.fromkeys(range(len(terms)), 0) | {r["term"]: r["df"] for r in frequencies(counts).collect()}  # a row a term of the block
        of_term = np.array([weight(documents, df[i]) for i in range(len(terms))], np.int64)
        asked = [(np.array([number[t] for t in own], np.int64), np.array([n * of_term[number[t]] for t, n in own.items()], np.int64)) for _, own in block]
        index = stored(indexed(counts, spark.sparkContext.broadcast(of_term), documents, length))
        best = search(index, asked, k)
        best = best.join(counts.select("u", "doc_id"), F.col("shard") + F.col("doc") == F.col("u")).select("item", "doc_id", "score", "u")
        best = top(best, k, [F.desc("score"), F.asc("doc_id"), F.asc("u")], "u")
        own = spark.createDataFrame([(q, n) for q, (n, _) in enumerate(block)], "item int, item_number long")
        best = written(best.join(F.broadcast(own), "item").select("item_number", "rank", "doc_id", "score"))
        discard(index)
        discard(counts)
        out = best if out is None else out.unionByName(best)
    if out is None:
        out = spark.createDataFrame([], T.StructType([T.StructField("item_number", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())]))
    return out.join(names, "item_number").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
with t as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents where text is not null),
d as (select doc_id, len(terms)::bigint as n, terms from t where len(terms) > 0),
total as (select count(*)::bigint as docs, sum(n)::bigint as l from d),
p as (select doc_id, n, term, count(*)::bigint as tf from (select doc_id, n, unnest(terms) as term from d) group by all),
w as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::double))::bigint as w from p, total group by term, docs),
q as (
  select item_id, term, count(*)::bigint as k from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark where text is not null) group by all),
s as (
  select item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // l))))::bigint as score
  from q join p using (term) join w using (term), total group by item_id, doc_id)
select item_id, rank::int as rank, doc_id, score from (
  select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 10
"""

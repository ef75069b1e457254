"""Ranked search against scoring every document in plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspectra.llm import tiered_index

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("u", T.LongType()), T.StructField("item", T.StringType()), T.StructField("n", T.LongType())])
ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("item_number", T.StringType())])


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], DOC), spark.createDataFrame([(i, t, "x") for i, t in items], ITEM)


def plain(docs, items, k=10):
    counts = [(i, Counter(tiered_index.terms_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    number, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 100 - 75 + (75 * c.total() * number) // length
            s = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in tiered_index.terms_of(text) if c[t])
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out += [(item, r + 1, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def found(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def corpus(seed=1, n=300):
    turn = random.Random(seed)
    common, rare = [f"c{i}" for i in range(20)], [f"ráre{i}" for i in range(400)]
    make = lambda k: " ".join(turn.choice(common if turn.random() < 0.8 else rare) for _ in range(k))
    docs = [(i, make(turn.randrange(1, 120))) for i in range(n)]
    items = [(i, make(turn.randrange(1, 30))) for i in range(12)]
    return docs, items


@pytest.mark.parametrize("shard_docs", [16, 1 << 11])
def test_against_every_score(spark, monkeypatch, shard_docs):
    monkeypatch.setattr(tiered_index, "SHARD_DOCS", shard_docs)
    docs, items = corpus()
    docs += [(None, "ráre1 c1"), (5, "ráre1 ráre1 ráre1"), (5, "ráre1"), (900, None), (901, ""), (902, " .,!"), (903, "RÁRE2 Ráre2 C1" + " c2" * 40_000), (904, "x" * 100_000), *((910 + i, items[0][1]) for i in range(15))]
    items += [(50, None), (51, ""), (52, "unheard of"), (53, "c1 C1 c1-c1 ráre2"), (53, "x" * 100_000), (None, "ráre1"), (54, "c1\x00c2\x7fc3")]
    got = found(tiered_index.ranked(*frames(spark, docs, items)))
    assert got == plain(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(n=5)
    assert tiered_index.ranked(*frames(spark, [], items)).count() == 0
    assert tiered_index.ranked(*frames(spark, docs, [])).count() == 0
    assert tiered_index.ranked(*frames(spark, [(1, None)], [(1, "a")])).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    docs, items = corpus(2, 60)
    monkeypatch.setattr(tiered_index, "BLOCK_TERMS", 40)
    assert found(tiered_index.ranked(*frames(spark, docs, items), k=3)) == plain(docs, items, 3)


def test_shards_without_copies_are_proven_early(spark, monkeypatch):
    """With enough copies of the items, most shards need their first tiers only; what falls through is still exact."""
    monkeypatch.setattr(tiered_index, "SHARD_DOCS", 16)
    docs, items = corpus(3, 400)
    docs += [(1000 + i, items[i % 2][1]) for i in range(40)]
    real = tiered_index.written
    fell = []

    def kept(df):
        out = real(df)
        if "pending" in df.columns:
            fell.append(out.agg(F.sum(F.length("pending") / 4)).first()[0] or 0)
        return out

    monkeypatch.setattr(tiered_index, "written", kept)
    assert found(tiered_index.ranked(*frames(spark, docs, items[:2]))) == plain(docs, items[:2])
    assert fell == sorted(fell, reverse=True) and fell[-1] == 0 and fell[-2] < fell[0]


def test_lexicon_confirms_by_bytes(monkeypatch):
    from gridspectra.llm.ragged import words

    lexicon = tiered_index.Lexicon(["abc", "é", "a" * 80])
    text = ("abc abd é " + "a" * 80 + " " + "a" * 81).encode()
    data = np.frombuffer(text, np.uint8)
    starts, lengths, _ = words(data, np.array([0, len(data)]))
    assert lexicon.find(data, starts, lengths).tolist() == [0, -1, 1, 2, -1]
    lexicon.h[:] = lexicon.h[0]
    monkeypatch.setattr(tiered_index, "word_hashes", lambda d, s, n: np.full(len(s), lexicon.h[0]))
    assert (lexicon.find(data, starts, lengths)[[1, 4]] == -1).all()

"""Near duplicates by HyperMinHash against all pairs, and the estimates against known similarities."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from gridspectra.llm import hyperminhash as hmh
from gridspectra.llm.ragged import mix

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("v", T.StringType()), T.StructField("n", T.LongType()), T.StructField("kept", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOC)


def shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    groups: dict[int, list] = {}
    for a in range(len(rows)):
        groups.setdefault(find(a), []).append(a)
    out = Counter()
    for own in groups.values():
        ids = [rows[a][0] for a in own if rows[a][0] is not None]
        for a in own:
            least = min(ids) if ids else None
            out[(rows[a][0], len(sets[a]), least, rows[a][0] == least)] += 1
    return out


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def corpus(seed=1):
    """Families of near copies at all sizes, many just at the threshold, with one line in all of them."""
    turn = random.Random(seed)
    rows, number = [], 0
    for size in [3, 6, 7, 8, 9, 12, 15, 16, 17, 31, 33, 60, 64, 130, 260, 500, 1025]:
        for _ in range(3):
            words = [f"w{turn.randrange(10**6)}" for _ in range(size)] + "one common line in all".split()
            for edits in range(6):
                own = list(words)
                for _ in range(edits * max(1, size // 40)):
                    at = turn.randrange(len(own))
                    own[at : at + turn.randrange(2)] = [f"e{turn.randrange(10**6)}"] * turn.randrange(2)
                number += 1
                rows.append((number, " ".join(own)))
            number += 1
            rows.append((number, " ".join(words + words[: size // 6])))
    turn.shuffle(rows)
    return rows


EDGES = [(5001, None), (5002, ""), (5003, " \n\t"), (5004, "one"), (5005, "ONE"), (5006, "one two"), (5007, "one  two"), (None, "one two"), (None, "alone here now and then"), (5008, "a b c " * 30_000), (5009, "a b c " * 29_000), (5010, "x" * 100_000), (5010, "x" * 100_000), (5010, "other text than that")]


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, monkeypatch, small):
    if small:  # bands and clusters cut into parts
        monkeypatch.setattr(hmh, "TILE", 4)
        monkeypatch.setattr(hmh, "TILE_SHINGLES", 600)
    rows = corpus(7 if small else 1) + EDGES
    rows += [(6000 + i, " ".join(f"g{k}" if k != i else f"h{k}" for k in range(120))) for i in range(60)]
    assert found(hmh.near_duplicates(frame(spark, rows))) == plain(rows)


def test_empty(spark):
    assert hmh.near_duplicates(frame(spark, [])).count() == 0


def test_layouts_meet():
    for n in range(1, 3000):
        own = set(hmh.layouts(n))
        for m in range(n, 100 * n // 85 + 1):
            assert own & set(hmh.layouts(m)), (n, m)


def test_compression():
    x = np.array([0, 1, 2**11, 2**63, 2**64 - 1, 2**62 + 2**52, 3 << 61], np.uint64)
    r = hmh.compress(x)
    assert (r >> 10).tolist() == [52, 52, 52, 0, 0, 1, 1]
    assert (r & 1023).tolist() == [0, 0, 0, 0, 1023, 1, 512]
    order = np.sort(mix(np.arange(1, 5000, dtype=np.uint64)))
    zeros = (hmh.compress(order) >> 10).astype(int)
    assert (np.diff(zeros) <= 0).all()


@pytest.mark.parametrize("n", [8, 40, 300, 5000])
@pytest.mark.parametrize("j", [0.0, 0.5, 0.9])
def test_estimates(n, j):
    """Corrected agreement is near the similarity, of whole registers and of the lowest bits."""
    seen, low = [], []
    k = hmh.layouts(n)[0]
    for seed in range(20):
        pool = mix(np.arange(1, 3 * n, dtype=np.uint64) + np.uint64(seed * 10**6))
        both = round(2 * n * j / (1 + j))
        a, b = hmh.registers(pool[:n], k), hmh.registers(np.concatenate((pool[:both], pool[n : 2 * n - both])), k)
        c = hmh.chance(np.array([n]), k, hmh.MANTISSA)[0]
        seen.append(((a == b).mean() - c) / (1 - c))
        low.append(2 * ((a & 1) == (b & 1)).mean() - 1)
    true = both / (2 * n - both)
    assert abs(np.mean(seen) - true) < 0.03 and abs(np.mean(low) - true) < 0.06
    assert hmh.chance(np.array([n]), k, hmh.MANTISSA)[0] < 0.001 < 0.02 < hmh.chance(np.array([n]), k, 2)[0]


def test_margin():
    used = np.full(3, hmh.REGISTERS)
    assert hmh.may_be(np.array([0.9, 0.8, 0.4]), np.zeros(3), used).tolist() == [True, True, False]
    assert hmh.may_be(np.array([0.925, 0.85, 0.7]), np.full(3, 0.5), used).tolist() == [True, True, False]

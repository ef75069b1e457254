"""The ten operators: SQL twins, brute force, round trips, and the edges each docstring defines."""

import collections
import functools
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from compare import same
from conftest import DATA
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspectra.llm import archives, bpe_codec, chat, components, jaccard_join, mixing, quality_model, quality_rules, ragged, registry, substring_dedup, token_counts, topk
from gridspectra.llm.bpe import Vocabulary

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = f"{DATA}/sf0.001"
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n", T.LongType()), T.StructField("h", T.StringType())])
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (5, LONG), (6, "one two"), (7, "ONE two"), (None, "some text without an id"), (8, "x" * 50_000), (9, "a\x00b é 日本 😀"), (9, "a\x00b é 日本 😀")]


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, None if t is None else f"s{len(t) % 3}", 7, 7, "h") for i, t in rows], DOC)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(name, spark, duck):
    same(registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df())


@functools.cache
def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def texts(seed=1, n=300):
    turn = random.Random(seed)
    letters = "abstmdrevl''  \n\t1239!?<|>é日😀Σİ" + "THE the ing "
    return ["".join(turn.choice(letters) for _ in range(turn.randrange(60))) for _ in range(n)] + ["it's we'll 'RE ", "a  b\n\nc \n", "<|endoftext|>a <|endoftext|>", "<|startoftext|>", "<|endo", "ftext|>"]


# ---- 1


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = frame(spark, EDGES + [(100 + i, t) for i, t in enumerate(texts())])
    want = collections.Counter((r.doc_id, len((r.text or "").encode()), len(library("byte_bpe_50k.json").encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, path).collect())
    assert got == want
    assert token_counts.count_tokens(frame(spark, []), path).count() == 0


@pytest.mark.parametrize("states", [3, 1 << 17])
def test_counts_with_colliding_words_and_few_states(monkeypatch, states):
    monkeypatch.setattr(token_counts, "word_hashes", lambda data, starts, lengths: (lengths % 2).astype(np.uint64))
    monkeypatch.setattr(token_counts, "MOST_STATES", states)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokens = token_counts.Tokens(Vocabulary.parse(f.read()))
    rows = texts(3, 60) + ["x" * 3000 + "ab" * 500, ""]
    flat, offsets = ragged.buffers(pa.array(rows, pa.string()))
    for _ in range(2):
        assert tokens.of_texts(flat, offsets).tolist() == [len(library("byte_bpe_50k.json").encode(t, add_special_tokens=False).ids) for t in rows]


@pytest.mark.parametrize(("stretch", "group", "states"), [(64, 1 << 18, 1 << 15), (3, 30, 1 << 15), (7, 70, 5), (64, 64, 5)])
def test_counts_of_long_words_by_composed_chunk_maps(monkeypatch, stretch, group, states):
    """Words that never settle, that go on from group to group, and whose states are forgotten on the way."""
    for name, value in (("STRETCH", stretch), ("GROUP", group), ("MOST_STATES", states)):
        monkeypatch.setattr(token_counts, name, value)
    path, turn = public_tokenizers.path("byte_bpe_50k.json"), random.Random(8)
    with open(path, encoding="utf-8") as f:
        tokens = token_counts.Tokens(Vocabulary.parse(f.read()))
    rows = ["=" * 700, "a" * 257, "ab" * 300, "日本" * 200] + ["".join(turn.choice(x) for _ in range(900)) for x in ("=-", "ACGT", "abcdefgh", "日本語漢字")]
    rows += [" ".join("y" * k for k in range(1, 140)), "z" * 64, "z" * 65, "z" * 128]
    data, offsets = ragged.buffers(pa.array(rows))
    assert tokens.of_texts(data, offsets).tolist() == [len(library("byte_bpe_50k.json").encode(t, add_special_tokens=False).ids) for t in rows]


def test_splitter_scan_equals_one_walk():
    turn = np.random.default_rng(2)
    to, mark = token_counts.splitter()
    for n in (1, 255, 256, 257, 5000):
        c = turn.integers(0, token_counts.N_CLASSES, n).astype(np.uint8)
        state, begins = token_counts.START, np.zeros(n, bool)
        for i, x in enumerate(c):
            at = state * token_counts.N_CLASSES + int(x)
            begins[i] |= bool(mark[at] & token_counts.HERE)
            if i and mark[at] & token_counts.BEFORE:
                begins[i - 1] = True
            state = int(to[at])
        assert (token_counts.pretoken_marks(c) == begins).all()


def test_classes_equal_the_library():
    split = library("byte_bpe_50k.json").pre_tokenizer
    kinds = token_counts.classes()
    for c in [*range(0x250), *range(0x550, 0x5A0), *range(0x1C80, 0x1C90), *range(0x2000, 0x2070), *range(0xA7C0, 0xA7E0), 0x3000, 0xFEFF, 0x10D50, 0x1F600]:
        known = {"a": token_counts.LETTER, "1": token_counts.NUMBER, "!": token_counts.OTHER}
        for x, kind in known.items():
            own = kinds[c] in range(6) if kind == token_counts.LETTER else kinds[c] in ((token_counts.OTHER, token_counts.QUOTE) if kind == token_counts.OTHER else (kind,))
            assert (len(split.pre_tokenize_str(x + chr(c))) == 1) == own, (hex(c), x)


# ---- 2


def plain_rules(text):
    import re

    words = re.findall(quality_rules.WORD, text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(quality_rules.WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(quality_rules.SYMBOL, text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    extra = [(50, "a b c a b c"), (51, "a a a a"), (52, "l\nl\n l\n\nl"), (53, "# $ * | a"), (54, "a b c d a b"), (55, "a b c b c d b c")]
    docs = frame(spark, EDGES + extra)
    book = quality_rules.ledger(docs)
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in book.collect())
    assert got == collections.Counter((i, *plain_rules(t)) for i, t in EDGES + extra)
    assert quality_rules.ledger(frame(spark, [])).count() == 0


def test_colliding_keys_take_the_exact_path(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 62)
    turn = random.Random(3)
    rows = [(i, " ".join(turn.choice("abcdef") for _ in range(turn.randrange(40)))) for i in range(60)]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.measured(frame(spark, rows)).collect()}
    assert got == {i: plain_rules(t)[4] for i, t in rows}


def test_policies_and_ablations(spark):
    book = spark.createDataFrame([(0,), (1,), (4,), (5,), (8,)], "failed long")
    v2 = quality_rules.POLICIES["v2"]
    assert quality_rules.apply_policy(book, quality_rules.BASE).where("kept").count() == 3
    got = {r.rule: (r.n_fail, r.n_only, r.n_kept_without) for r in quality_rules.ablations(book, v2).collect()}
    assert got["few_words"] == (2, 1, 2) and got["symbols"] == (2, 1, 2) and got["duplicate_lines"] == (1, 1, 2) and got["long_words"] == (0, 0, 1)


# ---- 3


def plain_links(rows):
    import re

    sets = []
    for _, t in rows:
        w = re.findall(quality_rules.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return collections.Counter((d, len(s), least.get(x) if s else d) for (d, _), s, x in zip(rows, sets, label))


def near_copies(seed, n):
    turn = random.Random(seed)
    bases = [[f"w{turn.randrange(500)}" for _ in range(turn.choice([5, 6, 12, 60, 200]))] for _ in range(12)]
    common = [f"c{i}" for i in range(40)]
    out = []
    for i in range(n):
        w = list(turn.choice(bases[:3] if i % 2 else bases))
        for _ in range(turn.choice([0, 0, 1, 1, 2, 5])):
            w[turn.randrange(len(w))] = f"x{turn.randrange(40)}"
        if turn.random() < 0.3:
            w += common
        out.append((1000 + (i * 37) % 1009, " ".join(w)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = EDGES + near_copies(seed, 180)
    got = jaccard_join.near_duplicates(frame(spark, rows).repartition(3))
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_links(rows)


@pytest.mark.parametrize("tile", [1, 3, 16])
def test_tiles_of_hot_blocks_lose_no_link(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "TILE_SHINGLES", 40 * tile)
    rows = EDGES + near_copies(3, 120)
    got = jaccard_join.near_duplicates(frame(spark, rows).repartition(3))
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_links(rows)


@pytest.mark.parametrize("crowd", [2, 5, 1000])
def test_thinned_blocks_keep_all_that_may_link(monkeypatch, crowd):
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    turn = np.random.default_rng(crowd)
    for _ in range(30):
        e = np.zeros(120, jaccard_join.ENTRY)
        e["h"], e["u"], e["n"] = turn.integers(0, 12, 120), np.arange(120), np.exp(turn.uniform(0, 9, 120)).astype(int) + 1
        e["at"] = turn.integers(0, 1 + e["n"] // 4)
        kept, sent = set(), []
        for own in np.array_split(turn.permutation(e), 3):
            done, rest = jaccard_join._thinned(own[np.lexsort((own["n"], own["h"]))])
            kept |= set(done["u"].tolist())
            sent.append(rest)
        met = np.concatenate(sent)
        met = met[np.lexsort((met["n"], met["h"]))]
        kept |= set(met["u"][jaccard_join._fit(met) & (met["kind"] == 0)].tolist())
        for x in e:
            n, m = int(x["n"]), e["n"].astype(int)
            least = jaccard_join.needed(np.full(len(e), n), m)
            ok = (e["h"] == x["h"]) & (e["u"] != x["u"]) & (np.minimum(n, m) >= least) & (np.minimum(n - x["at"], m - e["at"]) >= least)
            assert not ok.any() or int(x["u"]) in kept


def test_intersections_of_pairs():
    turn = np.random.default_rng(6)
    sets = [np.unique(turn.integers(0, 300, turn.integers(1, 200))).astype(np.uint64) for _ in range(20)] + [np.arange(40000, dtype=np.uint64)] * 2
    i, j = (x.ravel() for x in np.meshgrid(np.arange(22), np.arange(22)))
    assert jaccard_join.shared(sets, i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert jaccard_join.shared([np.array([1], np.uint64), np.array([2], np.uint64)], np.array([0]), np.array([1])).tolist() == [0]


def test_every_link(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if k != 7 * i else f"x{i}" for k, w in enumerate(words))) for i in range(12)]
    _, links = jaccard_join.linked(frame(spark, rows), every=True)
    assert links.count() == 66 and [r.n_links for r in jaccard_join.link_counts(links).collect()] == [11] * 12


def test_near_duplicates_of_nothing(spark):
    assert jaccard_join.near_duplicates(frame(spark, [])).count() == 0
    assert jaccard_join.near_duplicates(frame(spark, [(1, None)])).collect()[0].component_id == 1


@pytest.mark.parametrize("width", [3, 5])
def test_batches_of_few_words(width):
    """A batch of fewer words than a shingle has gives each row's whole sequence."""
    words = "one two three four five six".split()
    for n in range(7):
        (alone,) = ragged.shingle_sets(*ragged.buffers(pa.array([" ".join(words[:n])])), width)
        among, _ = ragged.shingle_sets(*ragged.buffers(pa.array([" ".join(words[:n]), " ".join(words)])), width)
        assert alone.tolist() == among.tolist() and len(alone) == (max(n - width + 1, 1) if n else 0)


def test_copies_of_a_three_word_text_in_several_tasks(spark):
    rows = [(i, "One two three") for i in range(4)]
    got = jaccard_join.near_duplicates(frame(spark, rows).repartition(4, "doc_id"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == [(i, 1, 0) for i in range(4)]


def test_tree_join_loses_no_pair():
    turn = np.random.default_rng(4)
    points = turn.integers(0, 4, (90, jaccard_join.GROUPS))
    points[::3] = points[0] + (turn.random((30, jaccard_join.GROUPS)) < 0.05)
    sizes, at, labels = points.sum(axis=1), np.zeros(90, int), np.arange(90)
    got = {tuple(sorted(p)) for i, j in jaccard_join.tree_join(points, sizes, at, labels) for p in zip(i.tolist(), j.tolist())}
    i, j = np.triu_indices(90, 1)
    ok = jaccard_join.may_link(points, sizes, at, i, j)
    assert got == set(zip(i[ok].tolist(), j[ok].tolist())) and len(got) > 100


def test_components(spark):
    turn = random.Random(5)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(40)], [(turn.randrange(80), turn.randrange(80)) for _ in range(60)], [(0, None), (3, 2)]):
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a is not None and b is not None and a != b:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
        got = {r.v: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {v: root(v) for v in parent}


# ---- 4


def test_archives(spark):
    big = "p" * 200
    rows = [(3, "http://a b/", big), (1, "http://x", big), (2, None, big), (4, "http://y", None), (5, "http://y", "short"), (6, "http://z", "short"), (None, "http://n", big), (7, "http://u", "é" * 60), (1, "http://x", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = archives.round_trip(pages.repartition(4)).collect()
    assert len(got) == len(rows) and len({r.record_id for r in got}) == len(rows)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id is not None) == [(1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None)]
    assert [r.payload_bytes for r in got if r.page_id == 7] == [120]
    assert [(r.record_type, r.refers_to, r.payload_bytes) for r in got if r.page_id is None] == [("revisit", 1, 200)]
    assert all(r.payload_digest == hashlib.sha256({i: h or "" for i, _, h in rows}[r.page_id].encode()).hexdigest() for r in got)
    assert archives.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_with_the_address_of_a_version_block(spark):
    rows = [(1, "filedesc://a", "x"), (2, "http://b", "y")]
    got = archives.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "response"), (2, "response")]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    body = b"HTTP/1.1 200 OK\r\nX-Page-Id: 9\r\n\r\nline\nWARC/1.1\n"
    data = archives.arc_version_block(version, "n.arc") + archives.arc_record(version, "n.arc", 0, "http://h/a b", body) + archives.arc_record(version, "n.arc", 9, "http://h/2", b"")
    got = list(archives.parse_arc(iter([data])))
    assert [c for _, c in got[1:]] == [body, b""] and got[1][0]["URL"] == "http://h/a%20b"
    warc = list(archives.parse_warc(archives.convert("n.arc", iter(got), {})))
    assert [h["WARC-Type"] for h, _ in warc] == ["warcinfo", "response", "resource"]
    assert warc[1][1] == body and warc[1][0]["WARC-Date"] == "2024-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        list(archives.parse_arc(iter([data[:-3]])))


def test_dates():
    assert archives.warc_date("19990102") == "1999-01-02T00:00:00Z" and archives.warc_date("x") == "1970-01-01T00:00:00Z"


# ---- 5


def plain_top(rows, k):
    q = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows}
    out = set()
    for i in (i for i in q if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i and len(q[j]) == len(q[i]))[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def test_top_k(spark):
    turn = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.float32(turn.choice([-1, -0.5, 0, 0.25, 1], 6))]) for i in range(330)]
    bad = [(400, None), (450, [1.0, None]), (451, [float("nan")] * 6), (452, [float("inf")] * 6), (None, [0.5] * 6)]
    v = spark.createDataFrame(rows + bad + [(500, [1.0, 2.0])], "vec_id long, embedding array<float>").repartition(5)
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v).collect()}
    assert got == plain_top(rows, 5)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert topk.top_k(few).count() == 2 and topk.top_k(few.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(0, [1.0, 0.5]), (1, [2.0**41, 0.0]), (2, [1.0, 1.0])]
    make = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(make(rows)).collect()]
    assert sorted(got) == [(0, 1, 1, 2**41 * 256 * 256), (0, 2, 2, 256 * 256 + 128 * 256)]
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(make([*rows, (3, [1e300, 0.0])])).collect()
    low = topk.top_k(make([*rows, (3, [-1e300, 0.0]), (4, [-1.7e308, 1.0])]), k=2)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in low.collect()) == sorted(got)


def test_top_k_of_all_sizes(spark):
    import math
    from fractions import Fraction

    turn = random.Random(12)
    rows = [(i, [turn.choice([-1, 1]) * turn.random() * 2.0 ** turn.choice([-3, 0, 8, 20 if i % 3 else 3, -60]) for _ in range(4)]) for i in range(160)]
    rows += [(1000 + i, [-(2.0 ** (60 + i)), 0.0, 2.0**44, 1.0]) for i in range(3)] + [(2000, [4e6] * 64), (2050, [0.5] * 64), (2001, [-1.0] * 64)]
    q = {i: [math.floor(Fraction(x) * 256) for x in v] for i, v in rows}
    want, held = set(), []
    for i in (i for i in q if i % 50 == 0 and i < 1000 or i == 2050):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i and len(q[j]) == len(q[i]))[:3]
        if all(abs(s) < 2**63 for s, _ in best):
            held.append(rows[[r[0] for r in rows].index(i)])
            want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    make = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>")
    got = topk.top_k(make(rows).repartition(3), make(held), k=3)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()} == want and len(held) > 2


def test_queries_of_one_id(spark):
    """Each vector of an id is a query with its own list; equal rows are one query."""
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (1, [0.5, 0.0]), (2, [0.0, 0.25]), (2, [0.0, 0.25]), (3, [0.25, 0.125])]
    got = collections.Counter(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()))
    first = [(50, 1, 1, 32768), (50, 2, 3, 16384), (50, 3, 2, 0)]
    second = [(50, 1, 2, 16384), (50, 2, 2, 16384), (50, 3, 3, 8192)]
    assert got == collections.Counter(first + second)


# ---- 6


def test_classifier(spark):
    got = registry.QUERIES["op6_quality_classifier"](spark, f"{DATA}/sf0.01")
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    both = got.join(labels, "doc_id").where("held_out").collect()
    assert len(both) > 50 and sum(r.predicted == r.quality for r in both) / len(both) > 0.9
    assert all(0 <= r.score <= 1 for r in both) and got.count() == 1000


def test_classifier_edges(spark):
    docs = frame(spark, EDGES)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_model.classify(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 10)] + [(3, None, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_model.classify(docs, some).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert quality_model.classify(frame(spark, []), some).count() == 0


def test_scores_of_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, EDGES).withColumns({n: F.lit(f"mine {n}") for n in ("score", "held_out", "quality", "found")})
    labels = spark.createDataFrame([(6, 1), (8, 0), (5, 1)], "doc_id long, quality int")
    got = quality_model.score(docs, quality_model.train(docs, labels))
    assert got.columns == [*docs.columns, "score_"] and got.where("score = 'mine score' and score_ between 0 and 1").count() == len(EDGES)
    assert quality_model.classify(docs, labels).count() == len(EDGES)


def plain_features(text):
    """The indicators of a text, word by word."""
    import math
    import re

    one = lambda b: ragged.word_hashes(np.frombuffer(b.lower() if b.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in b), np.uint8), np.array([0]), np.array([len(b)]))[0]
    pair = lambda x, y: ragged.mix(np.array([x]) * ragged.M3 + y)[0]
    kind = lambda c: 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 1 if 97 <= c <= 122 or c >= 128 else c
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    with np.errstate(over="ignore"):
        h = [one(b) for b in w]
        shape = [ragged.mix(np.array([kind(b[0])], np.uint64) * ragged.M2 + np.uint64(kind(b[-1])) * ragged.M3 + ragged.M1)[0] for b in w]
        out = {*h, *shape, *map(pair, h, h[1:]), *map(pair, shape, shape[1:])}
        windows = list(zip(h, h[1:], h[2:]))
        share = (len(windows) - len(set(windows))) / max(1, len(windows))
        out.add(ragged.mix(np.array([math.ceil(share * 10)], np.uint64) + ragged.M2)[0])
    return sorted({int(x) >> (64 - quality_model.BITS) for x in out})


def test_scores_word_by_word(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = quality_model.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.limit(40).collect()] + [(-1, ""), (-2, "a a a a a a"), (-3, "É b1 C")]
    got = {r.doc_id: r.score for r in quality_model.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in rows:
        f = plain_features(t)
        margin = sum(float(model.weight[x]) for x in f) / max(1e-12, sum(float(model.square[x]) for x in f)) ** 0.5 + model.bias
        assert abs(got[i] - 1 / (1 + np.exp(-min(30, max(-30, model.slope * margin + model.shift))))) < 1e-6


def test_dual_descent_reaches_the_optimum(monkeypatch):
    """The dual problem by projected gradient steps on the whole Gram matrix, against the descent by coordinates."""
    monkeypatch.setattr(quality_model, "EPOCHS", 5000)
    turn = np.random.default_rng(11)
    x = turn.normal(size=(40, 6))
    y = np.where(x[:, 0] + turn.normal(size=40) > 0, 1.0, -1.0)
    w, bias = quality_model.dual_descent([np.arange(6)] * 40, list(x), y, 6)
    z = np.hstack((x, np.ones((40, 1)))) * y[:, None]
    gram, alpha = z @ z.T, np.zeros(40)
    for _ in range(200_000):
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, quality_model.COST)
    primal = lambda v: v @ v / 2 + quality_model.COST * np.maximum(0, 1 - z @ v).sum()
    best, found = primal(alpha @ z), primal(np.append(w, bias))
    assert abs(best - (alpha.sum() - alpha @ gram @ alpha / 2)) < 1e-6 * best and found < best * 1.001


def test_dual_descent_separates():
    turn = np.random.default_rng(7)
    rows = [np.array([i % 2, 2 + turn.integers(0, 5)]) for i in range(60)]
    y = np.where(np.arange(60) % 2, 1.0, -1.0)
    w, b = quality_model.dual_descent(rows, [np.ones(2)] * 60, y, 8)
    assert all(y[i] * (w[rows[i]].sum() + b) > 0 for i in range(60))


# ---- 7


def test_words_at_all_code_points():
    """Around every character the words are those that the file's own normalizer and pattern give."""
    import json

    from tokenizers import Regex, pre_tokenizers

    tokenizer = library("word_bpe_49k.json")
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        pattern = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    parts = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
    splitter = bpe_codec.Splitter([])
    marks = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    same = lambda text: splitter.words(text) == [w for w, _ in parts.pre_tokenize_str(tokenizer.normalizer.normalize_str(text))]
    some = [marks[k : k + 512] for k in range(0, len(marks), 512) if not same(" ".join(f"a{c}b {c}" for c in marks[k : k + 512]))]
    wrong = [hex(ord(c)) for group in some for c in group if not same(f"a{c}b {c}")]
    assert not some, wrong[:60]


def test_codec(spark):
    path, tok = public_tokenizers.path("word_bpe_49k.json"), library("word_bpe_49k.json")
    docs = frame(spark, EDGES + [(100 + i, t) for i, t in enumerate(texts(8))])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = collections.Counter()
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))] += 1
    assert collections.Counter(map(tuple, bpe_codec.encode_texts(docs, path).collect())) == want
    assert bpe_codec.encode_texts(frame(spark, []), path).count() == 0
    one = bpe_codec.token_ids(frame(spark, [(1, "The cats' <|endoftext|>")]), path).collect()[0]
    assert one.ids == tok.encode("The cats' <|endoftext|>", add_special_tokens=False).ids and one.decoded == tok.decode(one.ids, skip_special_tokens=False)


def test_lexicon():
    turn = random.Random(9)
    words = sorted({"".join(turn.choice("abcé") for _ in range(turn.randrange(1, 9))).encode() for _ in range(500)})
    outputs = [[turn.randrange(9) for _ in range(turn.randrange(4))] for _ in words]
    data = bpe_codec.build(words, outputs)
    lexicon = bpe_codec.Lexicon(data)
    assert [lexicon.find(w) for w in words] == outputs
    assert all(lexicon.find(w + b"zz") is None for w in words) and lexicon.find(b"") is None
    assert bpe_codec.Lexicon(bpe_codec.build([], [])).find(b"a") is None
    shared = bpe_codec.build([b"aing", b"bing", b"cing"], [[1], [2], [3]])
    assert len(bpe_codec.Lexicon(shared).ends) == 5


def test_long_words_merge_alike():
    v = Vocabulary.parse(open(public_tokenizers.path("word_bpe_49k.json")).read())
    tok = library("word_bpe_49k.json")
    for word in ("ab" * 40, "x" * 500, "internationalization" * 9):
        assert v.encode(word.encode()) == tok.encode(word, add_special_tokens=False).ids


# ---- 8


def test_mixing(spark):
    docs = spark.createDataFrame([(i, f"t{i}", None, None if i % 10 == 0 else f"src{min(i % 7, 3)}", 1, 1, "h") for i in range(4000)], DOC)
    out = mixing.replicate(docs, {"src0": 0.5, "src3": 0.1}, 0.1)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    total = 0.5 + 0.1 * 4
    for source, weight in (("src0", 0.5), ("src3", 0.1), ("src1", 0.1), (None, 0.1)):
        assert abs(n[source] - 4000 * weight / total) < 5 * (4000 * weight / total) ** 0.5
    again = mixing.replicate(docs.repartition(7), {"src0": 0.5, "src3": 0.1}, 0.1)
    assert sorted(map(tuple, out.select("doc_id", "copy", "place").collect())) == sorted(map(tuple, again.select("doc_id", "copy", "place").collect()))
    assert set(docs.columns) < set(out.columns)
    assert mixing.replicate(frame(spark, [])).count() == 0
    assert mixing.replicate(frame(spark, EDGES), {"s0": 0.0}, 0.0).count() == 0


def test_mixing_of_clashing_columns(spark):
    from pyspark.sql import functions as F

    names = ["copy", "place", "steps", "rate", "lowest", "weight", "mix_u", "mix_at", "mix_times", "mix_source", "mix_lowest", "mix_steps", "mix_salt", "mass", "mix_rate", "mix_mass", "mix_block"]
    docs = frame(spark, EDGES)
    want = mixing.replicate(docs)
    got = mixing.replicate(docs.withColumns({n: F.lit(f"mine {n}") for n in names}))
    assert got.columns == [*docs.columns, *names, "copy_", "place_"]
    assert got.select(*docs.columns, "copy_", "place_").exceptAll(want).count() == 0 and got.count() == want.count()
    assert all(r[n] == f"mine {n}" for r in got.collect() for n in names)


def counts_at(spark, rate, us):
    one = spark.createDataFrame([(u,) for u in us], "u double").withColumn("rate", F.lit(float(rate))).withColumn("mass", mixing.mass(F.col("rate")))
    return [r.n for r in one.select(mixing.times_at(F.col("u"), F.col("rate"), F.col("mass")).alias("n")).collect()]


@pytest.mark.parametrize("rate", [0.0, 0.3, 4.0, 60.0, 166.0, 200.0, 700.0, 745.5, 1000.0, 10000.0])
def test_poisson_counts(spark, rate):
    """The inverse at even steps, and at both ends of what 52 bits can say."""
    import bisect

    us = [i / 997 for i in range(1, 997)] + [2.0**-52, 1e-12, 1 - 1e-9]
    want = poisson(rate)
    assert counts_at(spark, rate, us) == [bisect.bisect_right(want, u) for u in us]
    assert counts_at(spark, rate, [1 - 2.0**-52])[0] <= rate + 12 * rate**0.5 + 13


def test_poisson_counts_of_huge_rates(spark):
    """At 3 x 10^8 the distribution is normal but for a skewness of 6 x 10^-5."""
    from statistics import NormalDist

    rate, us = 3e8, [0.001, 0.1, 0.5, 0.9, 0.999]
    for u, n in zip(us, counts_at(spark, rate, us)):
        z = NormalDist().inv_cdf(u)
        assert abs(n - (rate + rate**0.5 * z + (z * z - 1) / 6)) < 3


def poisson(rate):
    """The distribution function to 50 digits, up to 1 - 1e-40."""
    import decimal

    with decimal.localcontext(decimal.Context(prec=50, Emin=-999999, Emax=999999)):
        p, total, out = (-decimal.Decimal(rate)).exp(), decimal.Decimal(0), []
        while not out or total < 1 - decimal.Decimal("1e-40"):
            total += p
            out.append(total)
            p = p * decimal.Decimal(rate) / len(out)
        return out


@pytest.mark.parametrize("rate", [746, 1000, 10000])
def test_rare_source_is_drawn(spark, rate):
    import bisect

    docs = spark.createDataFrame([(i, f"t{i}", None, None, 1, 1, "h") for i in range(20)], DOC)
    out = mixing.replicate(docs, {}, 1.0, total=20 * rate)
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    u = lambda i: int(hashlib.md5(f"{i}\x1f{hashlib.md5(f't{i}'.encode()).hexdigest()}\x1f{mixing.SEED}".encode()).hexdigest()[:13], 16) / 2**52
    want = poisson(rate)
    assert got == {i: bisect.bisect_right(want, u(i)) for i in range(20)} and len(set(got.values())) > 10


def test_copies_in_blocks(spark, monkeypatch):
    """Blocks change who makes the copies, not which are made."""
    docs = spark.createDataFrame([(i, f"t{i}", None, "rare" if i == 3 else "src0", 1, 1, "h") for i in range(60)] + [(None, None, None, None, 1, 1, "h")], DOC)
    rows = lambda: sorted(map(str, mixing.replicate(docs, {"src0": 0.2, "rare": 0.5}, 0.3, total=900).collect()))
    want = rows()
    assert len(want) > 700
    for block in (1, 7, 100):
        monkeypatch.setattr(mixing, "BLOCK", block)
        assert rows() == want


def test_mixing_sql_with_a_rare_source(spark, tmp_path):
    """One row of src0 among 30,000 has a rate of some 9,000; the twin draws the same copies, null sources and texts too."""
    import duckdb

    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("t"), "id")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") == 7, "src0").when(F.col("id") % 3 == 0, "src1").alias("source"), F.lit(2).cast("long").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = mixing.op8_source_mixing(spark, str(tmp_path)).toPandas()
    assert (got["source"] == "src0").sum() > 8000
    same(got, c.sql(mixing.SQL).df())


# ---- 9


def plain_cut(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        key = float("inf") if d is None else d
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            first[w] = min(first.get(w, (key, i)), (key, i))
    out = collections.Counter()
    for d, t in rows:
        b = (t or "").encode()
        key = float("inf") if d is None else d
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if first[b[i : i + 100]] != (key, i):
                gone[i : i + 100] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1)
        out[d, len(b), int(gone.sum()), len(edges), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    return out


def pieces(seed, n):
    turn = random.Random(seed)
    base = ["".join(turn.choice("abcd efg é") for _ in range(turn.randrange(90, 500))) for _ in range(20)]
    out = []
    for i in range(n):
        k = turn.random()
        if k < 0.2:
            t = turn.choice(base)
        elif k < 0.6:
            t = "".join(turn.choice(base)[turn.randrange(60) :][: turn.randrange(80, 300)] for _ in range(turn.randrange(1, 5)))
        elif k < 0.75:
            t = turn.choice(["ab", "x", "\x00"]) * turn.randrange(500)
        else:
            t = "".join(turn.choice("abcdefghijkl ") for _ in range(turn.randrange(400)))
        out.append((1000 + i * 7 % 211, t))
    return out


def test_substring_dedup(spark):
    rows = [r for r in EDGES if r[1] is not LONG] + [(4, LONG[:6000]), (5, LONG[:6000]), (5, LONG[:6000])] + pieces(1, 130)
    got = substring_dedup.deduplicate(frame(spark, rows).repartition(5))
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == plain_cut(rows)
    assert substring_dedup.deduplicate(frame(spark, [])).count() == 0


def test_copies_in_other_tasks_when_read_again(spark, monkeypatch):
    once = substring_dedup.twice
    monkeypatch.setattr(substring_dedup, "twice", lambda rows, buckets, size: once(rows.coalesce(1), buckets, size))
    turn = random.Random(8)
    text = "".join(turn.choice("abcdef ") for _ in range(400))
    rows = [(1, text), (2, text)]
    got = substring_dedup.deduplicate(frame(spark, rows[:1]).union(frame(spark, rows[1:])))
    assert {r.doc_id: r.n_removed for r in got.collect()} == {1: 0, 2: 400}


@pytest.mark.parametrize("shard", [1 << 21, 3000, 700])
def test_shards_merge_alike(monkeypatch, shard):
    """Texts of one document may start at one place, as rows of equal ids do."""
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    turn = random.Random(shard)
    rows = sorted(((i // 3, turn.randrange(3) * 50, t.encode()) for i, (_, t) in enumerate(pieces(9, 60))), key=lambda r: r[:2])
    first = {}
    for d, s, t in rows:
        for i in range(len(t) - 99):
            first[t[i : i + 100]] = min(first.get(t[i : i + 100], (d, s + i)), (d, s + i))
    want = [i + 100 <= len(t) and first[t[i : i + 100]] != (d, s + i) for d, s, t in rows for i in range(len(t))]
    offsets = np.concatenate(([0], np.cumsum([len(t) for *_, t in rows])))
    flat = np.frombuffer(b"".join(t for *_, t in rows), np.uint8)
    got = substring_dedup.later_windows(flat, offsets, np.array([d for d, *_ in rows]), np.array([s for _, s, _ in rows]))
    assert got.tolist() == want


def settled_here(rows, chunks):
    """The runs of a bucket that holds all contexts of `rows` (id, text), sent by `chunks` tasks."""
    blobs = []
    for part in np.array_split(np.arange(len(rows)), chunks):
        own = [rows[i] for i in part]
        batch = pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in own], pa.string())})
        for data, at, h, row, s, k in substring_dedup._scan(batch):
            ids = np.array([own[r][0] for r in row], np.int64)
            rk = np.array([part[0] + r for r in row], np.int64)
            blobs.append(ragged.packed(h, k.astype(np.int16), ids, rk, s, ragged.gathered(data, at, k + 99)))
    return substring_dedup.settle(blobs)


@pytest.mark.parametrize("shard", [1 << 21, 2000])
def test_equal_hashes_do_not_remove(monkeypatch, shard):
    """All anchors collide: contexts of different texts meet, and bytes still decide."""
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    real = substring_dedup.contexts
    monkeypatch.setattr(substring_dedup, "contexts", lambda data, offsets: (*(x := real(data, offsets))[:3], np.zeros_like(x[3])))
    monkeypatch.setattr(substring_dedup, "SCAN", 1 << 10)
    rows = [(i % 23, t) for i, (_, t) in enumerate(pieces(5, 90))]
    ids, rk, s, k = settled_here(rows, 4)
    got = {(int(r), int(a) + x) for r, a, n in zip(rk, s, k) for x in range(int(n))}
    first = {}
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - 99):
            first[b[i : i + 100]] = min(first.get(b[i : i + 100], (d, i)), (d, i))
    want = {(r, i) for r, (d, t) in enumerate(rows) for i in range(len(t.encode()) - 99) if first[t.encode()[i : i + 100]] != (d, i)}
    assert got == want and len(want) > 1000


def test_sorted_starts():
    turn = np.random.default_rng(3)
    base = [bytes(turn.integers(0, 2, turn.integers(100, 169)).astype(np.uint8)) for _ in range(30)]
    texts = [base[i][:n] for i, n in zip(turn.integers(0, 30, 400), turn.choice([100, 101, 120, 168], 400))]
    h = turn.integers(0, 3, 400).astype(np.uint64)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    order, new = substring_dedup.sorted_starts(np.frombuffer(b"".join(texts), np.uint8), offsets, h)
    keys = [(int(h[i]), len(texts[i]), texts[i]) for i in order]
    assert sorted(order.tolist()) == list(range(400)) and new.tolist() == [True, *(a != b for a, b in zip(keys, keys[1:]))]
    assert new.sum() == len(set(keys)) and [k[:2] for k in keys] == sorted(k[:2] for k in keys)


def test_cut_of_clashing_columns(spark):
    from pyspark.sql import functions as F

    names = ["n_bytes", "n_removed", "kept_text", "cut_id", "cut_rk", "cut_runs", "cut_s", "id", "rk", "s", "k"]
    docs = frame(spark, [(1, LONG[:500]), (2, LONG[:500])]).withColumns({n: F.lit(f"mine {n}") for n in names})
    got = substring_dedup.deduplicate(docs)
    assert got.columns == [*docs.columns, "n_bytes_", "n_removed_", "n_spans", "kept_sha256", "kept_text_"]
    for r in got.collect():
        assert all(r[n] == f"mine {n}" for n in names) and r.n_removed_ == (500 if r.doc_id == 2 else 0) and len(r.kept_text_) == (0 if r.doc_id == 2 else 500)


def test_suffix_array():
    turn = np.random.default_rng(3)
    for n in (0, 1, 2, 100, 300):
        for top in (1, 2, 200):
            t = turn.integers(0, top, n).astype(np.uint8)
            sa, b = substring_dedup.suffix_array(t), t.tobytes()
            assert sorted(sa) == list(range(n)) and [b[i : i + 100] for i in sa] == sorted(b[i : i + 100] for i in range(n))


# ---- 10


def plain_chat(rows):
    said = collections.defaultdict(set)
    for c, t, r, x in rows:
        said[c].add((-1 if t is None else t, r or "", x or ""))
    lists = collections.defaultdict(list)
    for c, turns in said.items():
        lists[tuple((r, x) for _, r, x in sorted(turns))].append(c)
    return {(min(ids, key=lambda c: (c is not None, c or 0)) if None not in ids or len(ids) == 1 else min(c for c in ids if c is not None), len(k), len(ids)) for k, ids in lists.items() if not any(len(o) > len(k) and o[: len(k)] == k for o in lists)}


def test_chat(spark):
    turns = [("user", "hi"), ("assistant", "yo"), ("user", "more"), ("assistant", None)]
    rows = [(c, i, *turns[i]) for c, n in ((1, 2), (2, 4), (3, 3), (4, 4)) for i in range(n)]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, 0, None, None), (7, None, "user", "x"), (7, 0, "user", "y"), (None, 0, "user", "lost"), (8, 0, "user", "hi"), (8, 0, "user", "hi")]
    log = spark.createDataFrame([(*r, 1, "h") for r in rows], "conv_id long, turn long, role string, text string, copies int, hash string")
    got = chat.collapse(log).collect()
    assert {(r.conv_id, r.n_turns, r.copies) for r in got} == plain_chat(rows)
    assert [r.text for r in got if r.conv_id == 2] == ["<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n<|im_start|>assistant\n<|im_end|>"]
    assert chat.collapse(log.limit(0)).count() == 0


def test_long_conversations(spark):
    """Snapshots of a conversation of thousands of turns, some turned at the last or with two turns exchanged."""
    rows = [(c, i, "user" if i % 2 else "assistant", "same" if i % 5 else f"t{i}") for c, n in ((1, 6000), (2, 5999), (3, 6000), (4, 1), (5, 0)) for i in range(n)]
    rows += [(6, i, r, t) for _, i, r, t in [(0, 0, "assistant", "t0"), (0, 1, "assistant", "same"), (0, 2, "user", "same")]]
    rows += [(7, i, r, t) for _, i, r, t in [(0, 0, "assistant", "t0"), (0, 1, "user", "same"), (0, 2, "assistant", "same"), (0, 3, "user", "same"), (0, 4, "assistant", "other")]]
    # role and text shifted against each other
    rows += [(8, 0, "a", "bc"), (9, 0, "ab", "c"), (10, 0, "a\x1fb", "c"), (11, 0, "a", "b\x1fc")]
    got = chat.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.n_turns, r.copies) for r in got} == plain_chat(rows)


# ---- shared


def test_shingles_and_words():
    rows = ["", None, " a  b\tc\n", "é日 x", "w" * 200 + " v"]
    data, offsets = ragged.buffers(pa.array(rows))
    starts, lengths, first = ragged.words(data, offsets)
    got = [[bytes(data[s : s + n]).decode() for s, n in zip(starts[a:b], lengths[a:b])] for a, b in zip(first, first[1:])]
    assert got == [(r or "").split() for r in rows]
    sets = list(ragged.shingle_sets(data, offsets))
    assert [len(s) for s in sets] == [0, 0, 1, 1, 1]

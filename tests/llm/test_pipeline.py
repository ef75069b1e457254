"""The pipeline's stages against plain versions on one small corpus."""

import bisect
import collections
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from conftest import DATA
from pyspark.sql import functions as F
from test_operators import EDGES, LONG, frame, library, plain_cut, plain_links, poisson

import corpus_pipeline
from gridspectra.llm import bpe_codec, mixing, shared


def test_stages(spark):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120).cache()
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, sf)
    assert kept.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    good = [i for i in labels if labels[i] == 1 and i < 120]
    assert sum(i in ids for i in good) >= 0.95 * len(good)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    near = stages["near_duplicates"](spark, docs, sf)
    assert near.columns == docs.columns
    assert sorted(r.doc_id for r in near.collect()) == sorted(d for d, _, c in plain_links(rows).elements() if d == c)
    cut = stages["repeats"](spark, docs, sf)
    assert cut.columns == docs.columns and cut.schema == docs.schema
    want = {d: n - gone for d, n, gone, *_ in plain_cut(rows) if not n or gone < n}
    assert {r.doc_id for r in cut.collect()} == set(want)
    assert all(len(r.text.encode()) == want[r.doc_id] for r in cut.collect() if "�" not in r.text)
    mixed = stages["mix"](spark, docs, sf)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {d for d, _ in rows}
    twice = docs.union(docs)
    assert set(collections.Counter(r.doc_id for r in stages["encode"](spark, twice, sf).collect()).values()) == {2}


def test_namesakes_of_near_copies_stay(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words, "x"])
    rows = [(1, " ".join(words)), (5, near), (5, "a text of its own that is linked with nothing"), (6, near), (None, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)


def test_copies_of_a_three_word_text_in_several_tasks_leave_one(spark):
    docs = spark.createDataFrame([(i, "one two three") for i in range(4)], "doc_id long, text string").repartition(4, "doc_id")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()] == [0]


def plain_left(rows):
    """(doc_id, text, source) without what occurs before; rows of which nothing is left go."""
    first, out = {}, []
    for d, t, _ in sorted(rows, key=lambda r: r[0]):
        b = t.encode()
        for i in range(len(b) - 99):
            first.setdefault(b[i : i + 100], (d, i))
    for d, t, source in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if first[b[i : i + 100]] != (d, i):
                gone[i : i + 100] = True
        if not gone.any() or not gone.all():
            out.append((d, bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "replace"), source))
    return out


def test_run(spark):
    """All stages after the classifier, whose decisions are taken from its stage, against plain versions."""
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.quality(spark, docs, sf).collect()]
    assert 100 < len(good) < docs.count()
    stay = {d for d, _, c in plain_links([r[:2] for r in good]) if d == c}
    left = plain_left([r for r in good if r[0] in stay])
    n = collections.Counter(r[2] for r in left)
    weight = {s: mixing.WEIGHTS.get(s, mixing.DEFAULT_WEIGHT) for s in n}
    curve = {s: poisson(weight[s] / sum(weight.values()) * len(left) / n[s]) for s in n}
    codec, want = library("word_bpe_49k.json"), collections.Counter()
    for d, t, source in left:
        u = int(hashlib.md5(f"{d}\x1f{hashlib.md5(t.encode()).hexdigest()}\x1f{mixing.SEED}".encode()).hexdigest()[:13], 16) / 2**52
        ids = codec.encode(t, add_special_tokens=False).ids
        row = (d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        want[row] += bisect.bisect_right(curve[source], u)
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == +want and sum(got.values()) > 50


def test_stages_of_odd_rows(spark):
    """Null ids and texts, empty, long and repeated rows, columns named like inner ones; and no rows at all."""
    names = ["score", "component_id", "v", "n_shingles", "label", "least", "u", "id", "rk", "s", "k", "n_removed", "n_bytes", "kept_text", "copy", "place", "rate", "steps", "some", "all", "gone"]
    docs = frame(spark, [r for r in EDGES if r[1] is not LONG] + [(4, LONG[:5000]), (5, LONG[:5000]), (5, "another text of the same id"), (None, None)])
    docs = docs.withColumns({n: F.lit(f"mine {n}") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, f"{DATA}/sf0.001")
        rows = got.collect()
        assert got.columns == docs.columns and all(r[n] == f"mine {n}" for r in rows for n in names), name
        assert stage(spark, docs.limit(0), f"{DATA}/sf0.001").count() == 0
    near = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert "another text of the same id" in {r.text for r in near} and sum(r.text == LONG[:5000] for r in near) == 1
    assert corpus_pipeline.encode(spark, docs, "").count() == docs.count()
    assert corpus_pipeline.encode(spark, docs.limit(0), "").count() == 0


def test_a_worker_drops_what_the_stage_before_kept(spark):
    """Workers of the encode stage hold words of the codec; tasks of other operators begin without them, those of the codec do not."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.range(64, numPartitions=8).selectExpr("id as doc_id", "concat('some words ', id) as text")

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bpe_codec.codec_of.cache_info().currsize])], names=["held"])

    probe = lambda *uses: max(r.held for r in docs.mapInArrow(shared.released(held, *uses), "held long").collect())
    want = sorted(bpe_codec.encode_texts(docs, path).collect())
    assert probe() == 0
    assert sorted(bpe_codec.encode_texts(docs, path).collect()) == want
    assert probe(bpe_codec.codec_of) == 1


def test_the_codec_forgets_words_in_two_generations(monkeypatch):
    monkeypatch.setattr(bpe_codec, "REMEMBERED", 3)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = bpe_codec.Vocabulary.parse(f.read())
    codec = bpe_codec.Codec(vocabulary)
    texts = ["one two three four", "one five", "two one", "six seven eight nine", "one", "", "ten one six"] * 2
    for t in texts:
        assert codec.digest(t) == bpe_codec.Codec(vocabulary).digest(t)
        assert len(codec) <= 3 and codec.keys() == codec.named.keys() and codec.elder.keys() == codec.elder_named.keys()

"""Spelling variants against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from gridspectra.llm import spelling

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("run", T.LongType()), T.StructField("own_id", T.LongType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2, 3) for i, t in rows], DOC)


def plain_words(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return out


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts):
    vocab = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    own = {}
    for w, n in vocab.items():
        near = sorted((-m, x) for x, m in vocab.items() if one_apart(w, x))
        form = near[0] if near and -near[0][0] >= 10 * n else None
        own[w] = (n, len(near), form and form[1], form and -form[0])
    out = set()
    for w, row in own.items():
        root = w
        while own[root][2]:
            root = own[root][2]
        out.add((w, *row, root))
    return out


def result(df):
    rows = [tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_groups_against_all_pairs(spark):
    turn = random.Random(3)
    base = ["".join(turn.choice("abcé") for _ in range(turn.randrange(6, 10))) for _ in range(60)]
    variants = [w[:i] + x + w[i + k :] for w in base for i, x, k in [(turn.randrange(len(w)), turn.choice(["", "a", "é", "ÿ"]), turn.randrange(2)) for _ in range(4)]]
    rows = [(i, " ".join(turn.choices(base, k=40) + turn.choices(variants, k=6) + ["colours"] * 3 + ["colour"])) for i in range(80)]
    rows += [(None, "COLOURS colourſs x" * 3), (7, None), (7, ""), (8, "aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa aaaaaaaaa aaaaaaaaa"), (8, "×÷×÷×÷×÷ ×÷×÷×÷×÷"), (8, "×÷×÷×÷×÷")]
    rows += [(9, f"{'chains' * 2} " * 300 + f"{'chains' * 2}x " * 25 + f"{'chains' * 2}xy " * 2), (10, "12345678 12345678")]
    assert result(spelling.groups(spelling.vocabulary(spelling.misspelt(frame(spark, rows))))) == plain_groups(plain_words(rows))
    assert spelling.groups(spelling.vocabulary(spelling.misspelt(frame(spark, [])))).count() == 0


def test_long_words_are_edited_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "EDITS", 1 << 12)
    long = "".join(random.Random(1).choice("abcdefg") for _ in range(6000))
    words = [long, long[:300] + long[301:], long + "a", "x" * 5000, "x" * 5001, "x" * 4999 + "yy"]
    rows = [(w, 2 * 11**k) for k, w in enumerate(words)]
    vocab = spark.createDataFrame(rows, "word string, n long")
    assert result(spelling.groups(vocab)) == plain_groups(dict(rows))


@pytest.mark.parametrize("word", ["a", "aab", "abcabc", "bbbbbb"])
def test_edits_are_all_distinct_and_hashed_alike(word):
    alphabet = np.array(sorted(map(ord, "abcx")), np.uint32)
    points = np.array([list(map(ord, word))], np.uint32)
    found = {}
    for kind, _, i, c, h in spelling.edits(points, alphabet):
        for k in range(len(h)):
            text = spelling.edited(word, kind, int(i[k]), None if c is None else int(c[k]))
            assert text not in found
            found[text] = h[k]
    letters = "abcx"
    want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + x + word[i + 1 :] for i in range(len(word)) for x in letters} | {word[:i] + x + word[i:] for i in range(len(word) + 1) for x in letters}
    assert set(found) == want - {word}
    for text, h in found.items():
        if text:
            assert spelling.word_hash(np.array([list(map(ord, text))], np.uint32))[0] == h


def test_bitmap_only_turns_away(spark, monkeypatch):
    """With a bitmap that lets nearly everything through the result is the same."""
    monkeypatch.setattr(spelling, "FEWEST_BITS", 11)
    monkeypatch.setattr(spelling, "MOST_BITS", 11)
    turn = random.Random(5)
    rows = [(f"letters{x}", 2) for x in "abcdefgh"] + [("letters", 900), ("lettersaa", 5)] + [("".join(turn.choice("abcdefgh") for _ in range(12)), 3) for _ in range(600)]
    assert result(spelling.groups(spark.createDataFrame(rows, "word string, n long"))) == plain_groups(dict(rows))

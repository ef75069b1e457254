"""Spelling variants: words one edit apart, found by generating every edit.

1. Vocabulary. Runs of letters are counted over all texts, natively; `misspelt` plants the contract's errors.
2. Neighbourhood. For each word all distinct deletions, replacements and insertions over the alphabet that the vocabulary shows are made:
   of a run of equal letters one deletion, no replacement of a letter by itself, no insertion of a letter behind the same letter. So no candidate
   comes twice and each is one edit away by construction. An edit's hash follows from prefix sums in constant time; a bitmap of the vocabulary
   (two bits a word, size bounded) turns most edits away before their strings are made, and never one that is a word.
3. Join. The strings that are left meet the vocabulary in an equi-join. What meets is near: no distance is computed anywhere.
4. Forms. The near word of largest count is the form if its count is `ratio` times the word's; counts grow along forms, so
   roots are found by doubling in few joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jaccard_join import bitmap, has
from .ragged import mix
from .shared import discard, released, table, written

RUNS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in ERRORS loses a letter.
ERRORS = 31
#: Least code points and occurrences of a word; how much more frequent its form is.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Edits hashed at once, and words to a task, about. log2 of the least and most bits of the bitmap.
EDITS, TASK, FEWEST_BITS, MOST_BITS = 1 << 20, 1 << 13, 20, 29
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def misspelt(docs: DataFrame) -> DataFrame:
    """word, a row for every run of letters of `docs` (doc_id, text), A-Z lower-cased; a run whose hash with its doc_id is divisible by ERRORS loses one letter.

    Null texts have no runs; a null doc_id is hashed as an empty one. Rows with repeated ids count each by itself.
    """
    run = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUNS), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("own_id"), run.alias("run"))
    h = F.crc32(F.concat("own_id", F.lit(":"), "run").cast("binary"))
    hashed = runs.withColumn("h", h)
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % ERRORS == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the distinct words of at least `length` code points that occur at least `count` times. Counts are summed in tasks before they are shuffled."""
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def _values(points: np.ndarray) -> np.ndarray:
    """A 64-bit value of each code point."""
    return mix(points.astype(np.uint64) + np.uint64(BASE))


def powers(n: int) -> np.ndarray:
    out = np.full(n + 1, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hash(points: np.ndarray) -> np.ndarray:
    """Hash of the words in the rows of a matrix of code points: the sum of value * BASE^place, modulo 2^64."""
    return (_values(points) * powers(points.shape[1] - 1)[None]).sum(axis=1, dtype=np.uint64)


def bits_of(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash."""
    h = mix(h)
    return (h >> np.uint64(64 - size)).astype(np.int64), (h & np.uint64((1 << size) - 1)).astype(np.int64)


def edits(points: np.ndarray, alphabet: np.ndarray, at: slice | None = None):
    """All distinct edits of the words in the rows of a matrix of code points, of places `at` (by default all).

    Yields (kind, rows, places, letters, hashes), flat arrays; kind is delete, replace or insert; letters is None for deletions. Of edits that give
    the same string only the first in place is made, so none comes twice.
    """
    rows, length = points.shape
    at = at or slice(0, length + 1)
    inside = slice(at.start, min(at.stop, length))
    x, pw, values = _values(points), powers(length + 1), _values(alphabet)
    terms = x * pw[None, :length]
    prefix = np.concatenate((np.zeros((rows, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)), axis=1)
    total = prefix[:, -1:]
    back = np.uint64(BACK)

    first = np.ones((rows, length), bool)
    first[:, 1:] = points[:, 1:] != points[:, :-1]
    h = prefix[:, inside] + (total - prefix[:, inside.start + 1 : inside.stop + 1]) * back
    r, i = np.nonzero(first[:, inside])
    yield "delete", r, i + at.start, None, h[r, i]

    other = points[:, inside, None] != alphabet[None, None]
    h = (total - terms[:, inside])[:, :, None] + pw[inside][None, :, None] * values[None, None]
    r, i, c = np.nonzero(other)
    yield "replace", r, i + at.start, alphabet[c], h[r, i, c]

    spots = np.arange(at.start, at.stop)
    before = np.where(spots[None] > 0, points[:, np.maximum(spots - 1, 0)], 0)
    h = (prefix[:, at] + (total - prefix[:, at]) * np.uint64(BASE))[:, :, None] + pw[at][None, :, None] * values[None, None]
    r, i, c = np.nonzero(before[:, :, None] != alphabet[None, None])
    yield "insert", r, i + at.start, alphabet[c], h[r, i, c]


def edited(word: str, kind: str, i: int, letter: int | None) -> str:
    return word[:i] + ("" if kind == "delete" else chr(letter)) + word[i + (kind != "insert") :]


def _matrices(words: list[str]):
    """Words of one length at a time, as (words, matrix of code points)."""
    by_length: dict[int, list[str]] = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for length, own in by_length.items():
        step = max(1, EDITS // (128 * length))
        for k in range(0, len(own), step):
            part = own[k : k + step]
            yield part, np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).reshape(len(part), length)


def candidates(vocab: DataFrame, alphabet: np.ndarray, size: int) -> DataFrame:
    """word, edit: every edit of every word that the vocabulary's bitmap of 2^size bits does not turn away. All words are among them."""

    def bits(batches):
        for batch in batches:
            for _, points in _matrices([w for w in batch.column("word").to_pylist() if w]):
                yield pa.RecordBatch.from_pydict({"bit": np.concatenate(bits_of(word_hash(points), size))})

    held = vocab.sparkSession.sparkContext.broadcast(bitmap(vocab.select("word").mapInArrow(released(bits), "bit long"), size))

    def run(batches):
        for batch in batches:
            for own, points in _matrices([w for w in batch.column("word").to_pylist() if w]):
                length = points.shape[1]
                step = max(1, EDITS // (len(own) * max(1, len(alphabet))))
                for start in range(0, length + 1, step):
                    word, edit = [], []
                    for kind, r, i, c, h in edits(points, alphabet, slice(start, min(length + 1, start + step))):
                        a, b = bits_of(h, size)
                        ok = np.flatnonzero(has(held.value, a))
                        ok = ok[has(held.value, b[ok])]
                        letters = np.zeros(len(ok), np.int64) if c is None else c[ok]
                        for row, place, letter in zip(r[ok].tolist(), i[ok].tolist(), letters.tolist()):
                            word.append(own[row])
                            edit.append(edited(own[row], kind, place, letter))
                    if word:
                        yield pa.RecordBatch.from_pydict({"word": pa.array(word, pa.string()), "edit": pa.array(edit, pa.string())})

    return vocab.select("word").mapInArrow(released(run), "word string, edit string")


def near(vocab: DataFrame) -> DataFrame:
    """word, other, other_n for every two words of `vocab` (word, n; distinct, written) that are one inserted, deleted or replaced code point apart; both directions."""
    count = vocab.count()
    letters = [r.letter for r in vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct().collect() if r.letter]
    alphabet = np.array(sorted(ord(x) for x in letters), np.uint32)  # code points of RUNS: a few score
    size = min(MOST_BITS, max(FEWEST_BITS, (32 * count).bit_length()))
    spread = vocab.repartition(max(1, -(-count // TASK)), "word")
    found = candidates(spread, alphabet, size)
    return found.join(vocab.select(F.col("word").alias("edit"), F.col("n").alias("other_n")), "edit").select("word", F.col("edit").alias("other"), "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word of `forms` (word, form, both not null), following forms to the last; a word on a circle would have no last one, but counts grow along forms."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("above"))
        after = written(now.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        discard(now)
        now = after.select("word", "root")
        now.written_at = after.written_at
        if not after.where("moved").limit(1).count():
            return now


def groups(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of `vocab` (word, n).

    form is the near word of largest n, ties to the smallest in code-point order, if its n is at least `ratio` times the word's, else null; root the last of the
    forms' chain, the word itself without a form. An empty vocabulary gives no rows. Words of any length are handled: edits are made by blocks of places.
    """
    vocab = written(vocab)
    best = near(vocab).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    whole = vocab.join(best, "word", "left")
    holds = -F.col("best.less") >= ratio * F.col("n")
    own = written(whole.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(holds, F.col("best.other")).alias("form"), F.when(holds, -F.col("best.less")).alias("form_n")))
    discard(vocab)
    return own.join(roots(own.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(vocabulary(misspelt(table(spark, sf_dir, "documents"))))


#: crc32 bit by bit: the polynomial 0xEDB88320 takes part where the lowest bit is set. Words are near by shared patterns, not by generated edits.
SQL = r"""
with recursive runs as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents),
steps as (select b, list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end)) as c from (select unnest(range(256)) as b)),
tbl as (select list(c order by b) as t from steps),
single as (select distinct doc_id, run from runs),
hashed as (
  select doc_id, run, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(hx) // 2 + 1), lambda i: ('0x' || substr(hx, 2 * i - 1, 2))::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h
  from (select doc_id, run, hex(coalesce(doc_id::varchar, '') || ':' || run) as hx from single), tbl),
word as (
  select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word
  from runs join hashed using (doc_id, run)),
vocab as (select word, count(*) as n from word where length(word) >= 7 group by word having count(*) >= 2),
hole as (select word, n, length(word) as size, i, left(word, i - 1) as a, substr(word, i + 1) as b from (select word, n, unnest(range(1, length(word) + 1)) as i from vocab)),
near as (
  select x.word, y.word as other, y.n as other_n from hole x join hole y using (size, i, a, b) where x.word <> y.word
  union select x.word, y.word, y.n from hole x join vocab y on x.a || x.b = y.word
  union select y.word, x.word, x.n from hole x join vocab y on x.a || x.b = y.word),
best as (select word, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by word),
own as (
  select v.word, v.n, coalesce(b.n_near, 0) as n_near, case when b.other_n >= 10 * v.n then b.other end as form, case when b.other_n >= 10 * v.n then b.other_n end as form_n
  from vocab v left join best b using (word)),
climb as (select word, word as node, 0 as k from own union all select c.word, o.form, k + 1 from climb c join own o on o.word = c.node where o.form is not null)
select o.word, o.n, o.n_near, o.form, o.form_n, c.root from own o join (select word, last(node order by k) as root from climb group by word) c using (word)
"""

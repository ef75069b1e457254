"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The frequent words of the whole corpus, with the ids they encode to, are compiled into a minimal
acyclic automaton: words share prefixes and suffixes, and a number on each transition adds up to the
word's place in a table of id sequences. The automaton is one file in the shared folder, memory-mapped by
every worker. Words that it does not hold are merged exactly, so its size changes speed alone.
"""

from __future__ import annotations

import hashlib
import mmap
import unicodedata
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import read_file, write_file
from .bpe import Vocabulary, letters
from .ragged import LOWER, buffers, slices, word_hashes, words
from .shared import kept, released, shared_dir, table, written

#: Most words of the lexicon, their most bytes, and words a worker remembers before it forgets all.
LEXICON_WORDS, WORD_BYTES, REMEMBERED = 1 << 16, 64, 3 << 17
#: Marks of checksums beside the automaton: sixteen to a word.
MARK_BITS = 20
MARKS = (1 << MARK_BITS) - 1
#: Bytes that part the words of the lexicon: all but ASCII letters and those of characters beyond ASCII.
BREAK = np.ones(256, dtype=bool)
BREAK[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def word_pattern(letter: str = r"\p{L}", number: str = r"\p{N}", other: str = r"[^\s\p{L}\p{N}]") -> str:
    # Fixed value: the word pattern of the vocabulary file.
    return rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|{other}+"


@cache
def newer() -> str:
    """Code points that `regex` takes for letters or numbers and the library, with older tables, does not."""
    from tokenizers.pre_tokenizers import ByteLevel

    library = ByteLevel(add_prefix_space=False)
    late = (c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) == "Cn" and regex.match(r"[\p{L}\p{N}]", c))
    return "".join(c for c in late if len(library.pre_tokenize_str("a" + c)) > 1 and len(library.pre_tokenize_str("1" + c)) > 1)


@cache
def lowered() -> dict[int, str]:
    """Lower case of the capitals that Python's tables do not have and the library's do."""
    from tokenizers.normalizers import Lowercase

    late = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) == "Cn"]
    return {ord(a): b for a, b in zip(late, Lowercase().normalize_str("\n".join(late)).split("\n"), strict=True) if a != b}


# ---- lexicon


def build(words: list[bytes], outputs: list[list[int]]) -> bytes:
    """The automaton of the sorted, distinct `words`: header, states, transitions, outputs.

    States are numbered when they are frozen; a state is frozen once no later word can pass it, and equal
    ones (same end mark, same transitions) are one. A transition's number is how many words come before
    those that pass it, in its state.
    """
    register: dict[tuple, int] = {}
    states: list[tuple] = []
    sizes: list[int] = []
    path: list[list] = [[False, []]]  # open states of the last word: end mark, [(byte, target)]

    def freeze(down_to: int, last: bytes) -> None:
        while len(path) > down_to + 1:
            end, edges = path.pop()
            key = (end, tuple(edges))
            if (n := register.get(key)) is None:
                n = register[key] = len(states)
                states.append(key)
                sizes.append(end + sum(sizes[to] for _, to in edges))
            path[-1][1].append((last[len(path) - 1], n))

    before = b""
    for word in words:
        same = next((i for i, (a, b) in enumerate(zip(before, word)) if a != b), min(len(before), len(word)))
        freeze(same, before)
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        before = word
    freeze(0, before)
    states.append((path[0][0], tuple(path[0][1])))
    first, ends, labels, targets, adds = [0], [], [], [], []
    for end, edges in states:
        ends.append(end)
        at = int(end)
        for byte, to in edges:
            labels.append(byte)
            targets.append(to)
            adds.append(at)
            at += sizes[to]
        first.append(len(labels))
    marks = np.zeros(1 << MARK_BITS, bool)
    marks[[zlib.crc32(w) & MARKS for w in words]] = True
    parts = [np.array(first, "<u4"), np.array(targets, "<u4"), np.array(adds, "<u4"), np.cumsum([0, *map(len, outputs)]).astype("<u4"), np.array([i for o in outputs for i in o], "<u4"), np.array(labels, "u1"), np.array(ends, "u1"), marks.view("u1")]
    return np.array([len(p) for p in parts], "<u8").tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """Reads what `build` makes."""

    def __init__(self, data):
        lengths, at, parts = np.frombuffer(data, "<u8", 8), 64, []
        for n, kind in zip(lengths, ("<u4",) * 5 + ("u1",) * 3):
            parts.append(np.frombuffer(data, kind, int(n), at))
            at += parts[-1].nbytes
        self.first, self.targets, self.adds, self.at, self.ids, self.labels, self.ends, self.marks = map(memoryview, parts)
        self.root = len(self.ends) - 1

    def find(self, word: bytes) -> list[int] | None:
        """The word's ids, or None. A table of marks turns most of the words away that the automaton lacks, before any of its states is read."""
        if not self.marks[zlib.crc32(word) & MARKS]:
            return None
        s, index = self.root, 0
        for byte in word:
            lo, end = self.first[s], self.first[s + 1]
            hi = end
            while lo < hi:
                mid = (lo + hi) // 2
                if self.labels[mid] < byte:
                    lo = mid + 1
                else:
                    hi = mid
            if lo == end or self.labels[lo] != byte:
                return None
            index += self.adds[lo]
            s = self.targets[lo]
        return self.ids[self.at[index] : self.at[index + 1]].tolist() if self.ends[s] else None


@kept
def mapped(path: str) -> Lexicon:
    """The file as a memory map; from a store without files, once per worker into an anonymous map."""
    if path.startswith("file:") or "://" not in path:
        with open(path.removeprefix("file://"), "rb") as f:
            return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    data = read_file(path)
    held = mmap.mmap(-1, len(data))
    held[:] = data
    return Lexicon(held)


# ---- texts


class Splitter:
    """A text's words and special tokens, normalized as the vocabulary file asks: NFC, white space dropped, lower case."""

    def __init__(self, specials):
        self.specials = dict(specials)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.word = regex.compile(word_pattern())
        late = f"[{newer()}]"
        self.capitals = regex.compile("[" + "".join(map(chr, lowered())) + "]") if lowered() else None
        self.late, self.late_word = regex.compile(late), regex.compile(word_pattern(rf"\p{{L}}--{late}", rf"\p{{N}}--{late}", rf"[[^\s\p{{L}}\p{{N}}]||{late}]"))

    def words(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # a capital sigma by itself, as each character is lowered alone
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.capitals and self.capitals.search(text):
                text = text.translate(lowered())
            if self.late.search(text):
                return self.late_word.findall(text)
        return self.word.findall(text)

    def pieces(self, text: str) -> list[str]:
        """Words, and special tokens as they are; words never look like those, for they lack mixed kinds of characters."""
        if self.special is None or not any(s in text for s in self.specials):
            return self.words(text)
        out = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self.words(part)
        return out


class Codec(dict):
    """word -> its ids as text; `named` has its token names as text.

    What was met is remembered in two generations: at REMEMBERED words the younger one becomes the elder, and
    words of the elder that are met again move over. Long words are forgotten after each text.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        super().__init__()
        self.vocabulary, self.lexicon, self.splitter = vocabulary, lexicon, Splitter(vocabulary.specials)
        self.named: dict[str, str] = {}
        self.elder: dict[str, str] = {}
        self.elder_named: dict[str, str] = {}
        self.long: list[str] = []
        self.gaps = False  # whether some word has no ids

    def __missing__(self, word: str) -> str:
        if (ids := self.elder.get(word)) is not None:
            out = ids, self.elder_named[word]
        else:
            data = word.encode()
            if word in self.vocabulary.specials:
                ids = [self.vocabulary.specials[word]]
            else:
                ids = self.lexicon.find(data) if self.lexicon and len(data) <= WORD_BYTES else None
                if ids is None:
                    ids = self.vocabulary.encode(data)
            out = (" ".join(map(str, ids)), self.decode(ids))
            self.gaps |= not ids
            if len(data) > WORD_BYTES:
                self.long.append(word)
        self[word], self.named[word] = out
        return out[0]

    def forget(self) -> None:
        for word in self.long:
            self.pop(word, None)
            self.named.pop(word, None)
        self.long.clear()
        if len(self) > REMEMBERED:
            self.elder = self.elder_named = {}  # gone before the copy is made
            self.elder, self.elder_named, self.named = dict(self), self.named, {}
            self.clear()

    def _joined(self, text: str) -> tuple[str, str]:
        words = self.splitter.pieces(text)
        ids = " ".join(map(self.__getitem__, words))
        names = " ".join(map(self.named.__getitem__, words))
        if self.gaps:
            ids, names = (" ".join(x for w in words if (x := d[w])) for d in (self, self.named))
        self.forget()
        return ids, names

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self._joined(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Token names side by side, for the file names no decoder."""
        return " ".join([self.vocabulary.names[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, and SHA-256 of the ids as text and of the decoded text."""
        ids, names = self._joined(text)
        return ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(names.encode()).hexdigest()


@kept
def codec_of(vocabulary: str, lexicon: str) -> Codec:
    """One per worker process, which runs many tasks."""
    return Codec(Vocabulary.parse(vocabulary), mapped(lexicon))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all texts: runs of ASCII letters and characters beyond ASCII, lower-cased in ASCII, of up to WORD_BYTES bytes.

    That is the splitter's idea of a word for nearly all of them; one it splits otherwise is only merged when met. Tasks add up their own words
    first, by hash inside a slice and in pieces of bounded size.
    """

    def run(batches):
        seen: Counter[bytes] = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                part = LOWER[data[offsets[i] : offsets[j]]]
                starts, lengths, _ = words(part, offsets[i : j + 1] - offsets[i], BREAK)
                short = lengths <= WORD_BYTES
                starts, lengths = starts[short], lengths[short]
                _, first, n = np.unique(word_hashes(part, starts, lengths), return_index=True, return_counts=True)
                raw = part.tobytes()
                for s, k, c in zip(starts[first].tolist(), lengths[first].tolist(), n.tolist()):
                    seen[raw[s : s + k]] += c
                if len(seen) > REMEMBERED:
                    yield flush()
                    seen.clear()
        yield flush()

    return docs.select("text").mapInArrow(released(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def make_lexicon(docs: DataFrame, vocabulary: Vocabulary, most: int = LEXICON_WORDS) -> str:
    """Path of the lexicon of the corpus: its words by falling frequency, in whole classes of like frequency, up to `most`.

    Frequencies are classed by eighths of their binary logarithm; only the few classes and the chosen words reach the driver.
    """
    counts = written(word_counts(docs).withColumn("level", F.floor(8 * F.log2("n")).cast("int")))
    room, least = most, None
    for level, words in sorted(((r.level, r.words) for r in counts.groupBy("level").agg(F.count("*").alias("words")).collect()), reverse=True):
        if (room := room - words) < 0:
            break
        least = level
    frequent = [] if least is None else counts.where(F.col("level") >= least).select("word").toPandas()["word"]
    words = sorted(w.encode() for w in frequent if w not in vocabulary.specials)
    path = f"{shared_dir(docs.sparkSession)}/lexicon"
    write_file(path, build(words, [vocabulary.encode(w) for w in words]))
    return path


def _codec(docs: DataFrame, tokenizer: str):
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    return docs.sparkSession.sparkContext.broadcast(text), make_lexicon(docs, Vocabulary.parse(text))


def encode_texts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, in the order of rows, and nothing collected.

    As the tokenizers library encodes with the file at `tokenizer`, without added special tokens, and decodes with them. Null texts are
    empty: no tokens, digests of nothing. Rows with null or repeated ids are encoded like others; other columns are not looked at.
    """
    held, lexicon = _codec(docs, tokenizer)

    def run(batches):
        codec = codec_of(held.value, lexicon)
        for batch in batches:
            rows = [codec.digest(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(released(run, codec_of, mapped), f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids, decoded: what `encode_texts` digests."""
    held, lexicon = _codec(docs, tokenizer)

    def run(batches):
        codec = codec_of(held.value, lexicon)
        for batch in batches:
            ids = [codec.encode(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(codec.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(released(run, codec_of, mapped), f"doc_id {id_type}, ids array<int>, decoded string")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

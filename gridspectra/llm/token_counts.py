"""Token counts by finite-state transducers.

Two deterministic transducers take the place of the tokenizer.

The first splits a text into pre-tokens. It has a dozen states over classes of characters and marks
where pre-tokens begin. A batch of texts is cut into equal chunks; every chunk is run from all states at
once, which gives its state map; a parallel prefix scan composes the maps, so each chunk learns its
entry state and can be run once more for its marks.

The second reads the bytes of a pre-token and annotates each transition with the number of tokens it
emits. A state holds, for every suffix that may still grow into a token, the last token before that suffix
and the count there: the last token of each prefix is the one whose pair with its forerunner is stable
under merging. States and transitions are compiled when first met and kept in tables, by which many pre-tokens
are read at once. Long ones are cut into chunks, whose state maps carry counts and are composed by a prefix scan too.
"""

from __future__ import annotations

from functools import cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .bpe import Vocabulary, byte_letters
from .ragged import buffers, gathered, slices, word_hashes
from .shared import kept, released, table

LIMIT = 1024
#: Characters in a chunk; kept words, their bytes and kept states, beyond which a worker forgets and starts again.
CHUNK, MOST_WORDS, MOST_BYTES, MOST_STATES = 256, 1 << 20, 1 << 25, 1 << 15
#: Bytes in a chunk of a long pre-token; bytes of pre-tokens read at once.
STRETCH, GROUP = 64, 1 << 18

# Classes of characters.
LETTER, STMD, R, E, V, L, NUMBER, OTHER, QUOTE, BLANK, SPACE, END = range(12)
# States: after nothing, in a run, in white space by its last character, in a possible contraction, after one.
START, IN_L, IN_N, IN_O, WS_BLANK, WS_OTHER, AP, AP_R, AP_V, AP_L, DONE = range(11)
N_CLASSES, N_STATES = 12, 11
#: Bits of a mark: a pre-token begins at this character, at the one before.
HERE, BEFORE = 1, 2


@cache
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and marks of the pre-token transducer, by state * N_CLASSES + class."""
    letters = (LETTER, STMD, R, E, V, L)
    run = {**dict.fromkeys(letters, IN_L), NUMBER: IN_N, OTHER: IN_O, QUOTE: AP, BLANK: WS_BLANK, SPACE: WS_OTHER}

    def fresh(c):  # c begins a pre-token
        return run[c], HERE

    def step(s, c):
        if c == END:
            return START, BEFORE if s in (AP_R, AP_V, AP_L) else 0
        if s in (START, DONE):
            return fresh(c)
        if s in (WS_BLANK, WS_OTHER):
            if c in (BLANK, SPACE):
                return run[c], 0
            if s == WS_BLANK:  # the blank goes with what follows
                return (IN_O if c == QUOTE else run[c]), BEFORE
            return run[c], BEFORE | HERE
        if s == AP:
            if c == STMD:
                return DONE, 0
            if c in (R, V, L):
                return {R: AP_R, V: AP_V, L: AP_L}[c], 0
            return (IN_O, 0) if c in (OTHER, QUOTE) else fresh(c)
        if s in (AP_R, AP_V, AP_L):
            if c == (L if s == AP_L else E):
                return DONE, 0
            to, mark = step(IN_L, c)
            return to, mark | BEFORE
        same = {IN_L: letters, IN_N: (NUMBER,), IN_O: (OTHER, QUOTE)}[s]
        return (s, 0) if c in same else fresh(c)

    cells = [step(s, c) for s in range(N_STATES) for c in range(N_CLASSES)]
    return np.array([x for x, _ in cells], np.uint8), np.array([x for _, x in cells], np.uint8)


@cache
def classes() -> np.ndarray:
    """The class of every code point; the last entry, beyond Unicode, is END.

    Letters and numbers that are newer than Python's own tables are as the library's splitter has them.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    library = ByteLevel(add_prefix_space=False)
    out = np.full(0x110001, OTHER, np.uint8)
    newer = set(regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, range(0x110000)))))
    for c in range(0x110000):
        kind = category(chr(c))
        if kind[0] in "LN":
            out[c] = LETTER if kind[0] == "L" else NUMBER
        elif kind == "Cn" and chr(c) in newer:
            for known, mark in (("a", LETTER), ("1", NUMBER)):
                if len(library.pre_tokenize_str(known + chr(c))) == 1:
                    out[c] = mark
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    for kind, chars in ((STMD, "stmd"), (R, "r"), (E, "e"), (V, "v"), (L, "l"), (QUOTE, "'"), (BLANK, " ")):
        out[[ord(c) for c in chars]] = kind
    out[-1] = END
    return out


def pretoken_marks(cls: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in a sequence of classes, by chunk state maps and their prefix scan."""
    to, mark = splitter()
    n = len(cls)
    rows = -(-n // CHUNK)
    padded = np.full(rows * CHUNK, END, np.uint8)
    padded[:n] = cls
    grid = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
    maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], rows, axis=1)
    for k in range(CHUNK):
        maps = to[maps * np.uint8(N_CLASSES) + grid[k]]
    reach = 1
    while reach < rows:  # after this step a column maps the entry of 2 * reach chunks to its own exit
        maps[:, reach:] = np.take_along_axis(maps[:, reach:], maps[:, :-reach].copy(), axis=0)
        reach *= 2
    state = np.concatenate(([np.uint8(START)], maps[START, :-1])).astype(np.uint8)
    marks = np.empty((CHUNK, rows), np.uint8)
    for k in range(CHUNK):
        at = state * np.uint8(N_CLASSES) + grid[k]
        marks[k] = mark[at]
        state = to[at]
    flat = marks.T.reshape(-1)[:n]
    begins = (flat & HERE).astype(bool)
    begins[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return begins


class Counter:
    """The second transducer: counts the tokens of pre-tokens.

    Its states are not known beforehand, so a chunk's map holds only the first one and those that its forerunner's
    map leads to. Maps carry counts and are composed like those of the first transducer.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        back = {c: b for b, c in enumerate(byte_letters())}
        self.child: dict[tuple[int, int], int] = {}  # the tree of all tokens
        self.token: dict[int, str] = {}
        nodes = 1
        for name in vocabulary.ids:
            at = 0
            for c in name:
                if (to := self.child.get((at, back[c]))) is None:
                    to = self.child[at, back[c]] = nodes
                    nodes += 1
                at = to
            self.token[at] = name
        self.stable: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self, kept: int | None = None) -> int:
        """Drops all states but the first and `kept`, whose new number it returns."""
        first = ((0, "", 0),)
        here = first if kept is None else self.states[kept]
        self.states: list[tuple] = list(dict.fromkeys((first, here)))
        self.number = {x: i for i, x in enumerate(self.states)}
        self.to, self.emits = np.full((1 << 10, 256), -1, np.int32), np.zeros((1 << 10, 256), np.int32)
        return self.number[here]

    def pair(self, a: str, b: str) -> bool:
        """Whether merging leaves the tokens a, b beside each other as they are."""
        if (known := self.stable.get((a, b))) is None:
            if len(self.stable) > MOST_WORDS:
                self.stable.clear()
            known = self.stable[a, b] = self.vocabulary.merge(list(a + b)) == ([a, b] if a else [b])
        return known

    def compile(self, s: int, byte: int) -> None:
        """Sets the transition of state s at a byte: its target and the tokens it emits."""
        grown = [(to, last, count) for node, last, count in self.states[s] if (to := self.child.get((node, byte))) is not None]
        for node, last, count in grown:
            if (t := self.token.get(node)) is not None and self.pair(last, t):
                break
        else:
            raise ValueError(f"no token ends at byte {byte}")
        emitted = count + 1
        to = (*((n, x, c - emitted) for n, x, c in grown), (0, t, 0))
        if (number := self.number.get(to)) is None:
            number = self.number[to] = len(self.states)
            self.states.append(to)
            if number == len(self.to):
                self.to = np.concatenate((self.to, np.full_like(self.to, -1)))
                self.emits = np.concatenate((self.emits, np.zeros_like(self.emits)))
        self.to[s, byte], self.emits[s, byte] = number, emitted

    def run(self, data: np.ndarray, at: np.ndarray, lengths: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where stretches of bytes lead, each from its own state, and the tokens emitted; all are read side by side."""
        by = np.argsort(-lengths, kind="stable")
        at, state, total = at[by], states[by].astype(np.int64), np.zeros(len(at), np.int64)
        live = np.searchsorted(-lengths[by], -np.arange(lengths.max(initial=0)), side="left")
        for k, n in enumerate(live.tolist()):
            s, byte = state[:n], data[at[:n] + k].astype(np.int64)
            to = self.to[s, byte]
            if len(new := np.flatnonzero(to < 0)):
                for key in np.unique(s[new] << 8 | byte[new]).tolist():
                    self.compile(key >> 8, key & 255)
                to = self.to[s, byte]
            total[:n] += self.emits[s, byte]
            state[:n] = to
        out, tokens = np.empty_like(state), np.empty_like(total)
        out[by], tokens[by] = state, total
        return out, tokens

    def composed(self, data: np.ndarray, at: np.ndarray, lengths: np.ndarray, follows: np.ndarray, entry: int) -> tuple[int, np.ndarray]:
        """The state after the last chunk and the tokens up to the end of each; a chunk that does not follow another one begins a word.

        `entry` is the state before the first chunk. Maps grow until every state that a chunk leads to is in the map of the
        chunk behind it. A chunk that has been asked r times has r states there, and only few can end at one byte, so rounds are few.
        """
        m = len(at)
        none = np.zeros(0, np.int64)
        key, exits, tokens = none, none, none  # chunk and state before it, state behind it, tokens
        asked = np.arange(m) << 32
        asked[0] |= entry
        while len(asked):
            chunk = asked >> 32
            to, n = self.run(data, at[chunk], lengths[chunk], asked & 0xFFFFFFFF)
            key, exits, tokens = np.concatenate((key, asked)), np.concatenate((exits, to)), np.concatenate((tokens, n))
            order = np.argsort(key)
            key, exits, tokens = key[order], exits[order], tokens[order]
            on = (chunk < m - 1) & follows[np.minimum(chunk + 1, m - 1)]
            asked = np.setdiff1d(chunk[on] + 1 << 32 | to[on], key)
        chunk = key >> 32
        first = np.searchsorted(chunk, np.arange(m))
        slot = np.arange(len(key)) - first[chunk]
        # a chunk's map by slots: the slot of the chunk behind it, the first one (nothing read) where a word ends
        behind = np.where((chunk < m - 1) & follows[np.minimum(chunk + 1, m - 1)], exits, 0)
        to = np.searchsorted(key, chunk + 1 << 32 | behind) - first[np.minimum(chunk + 1, m - 1)]
        maps, counts = np.zeros((2, int(slot.max()) + 1, m), np.int64)
        maps[slot, chunk], counts[slot, chunk] = np.where(chunk < m - 1, to, slot), tokens
        leads = exits[first[-1] :]
        reach = 1
        while reach < m:  # after this step a column maps a slot of the chunk 2 * reach - 1 before to what is behind its own
            before = maps[:, :-reach].copy()
            counts[:, reach:] = counts[:, :-reach] + np.take_along_axis(counts[:, reach:], before, axis=0)
            # the last map keeps the slot it was entered by
            maps[:, reach:] = np.take_along_axis(maps[:, reach:], before, axis=0)
            reach *= 2
        start = int(np.searchsorted(key, entry))
        return int(leads[maps[start, -1]]), counts[start]

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The tokens of each word. Words of one chunk are read side by side; longer ones, in groups of chunks, by composed maps."""
        out = np.zeros(len(starts), np.int64)
        short = np.flatnonzero(lengths <= STRETCH)
        ends = np.concatenate(([0], np.cumsum(lengths[short])))
        for i, j in slices(ends, GROUP):
            if len(self.states) > MOST_STATES:
                self.forget()
            own = short[i:j]
            out[own] = self.run(data, starts[own], lengths[own], np.zeros(j - i, np.int64))[1]
        long = np.flatnonzero(lengths > STRETCH)
        chunks = -(-lengths[long] // STRETCH)
        word = np.repeat(long, chunks)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        at, size = starts[word] + nth * STRETCH, np.minimum(STRETCH, lengths[word] - nth * STRETCH)
        state = 0
        for i in range(0, len(word), GROUP // STRETCH):
            j = min(i + GROUP // STRETCH, len(word))
            state = state if nth[i] else 0  # a word may go on from the group before
            if len(self.states) > MOST_STATES:
                state = self.forget(state)
            state, upto = self.composed(data, at[i:j], size[i:j], nth[i:j] > 0, state)
            np.add.at(out, word[i:j], np.diff(upto, prepend=0))
        return out


class Tokens:
    """Counts for texts; keeps the counts of words it has met, found by 64-bit hash and compared byte by byte."""

    def __init__(self, vocabulary: Vocabulary):
        self.counter, self.specials = Counter(vocabulary), list(vocabulary.specials)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.forget()

    def forget(self) -> None:
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.lengths, self.bytes, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint8), 0

    def keep(self, hashes: np.ndarray, flat: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> None:
        size = len(flat)
        if self.used + size > len(self.bytes):
            self.bytes = np.concatenate((self.bytes, np.zeros(max(size, len(self.bytes)), np.uint8)))
        self.bytes[self.used : self.used + size] = flat
        both = np.concatenate((self.hashes, hashes))
        order = np.argsort(both, kind="stable")
        self.hashes, self.counts = both[order], np.concatenate((self.counts, counts))[order]
        self.starts = np.concatenate((self.starts, self.used + np.cumsum(lengths) - lengths))[order]
        self.lengths = np.concatenate((self.lengths, lengths))[order]
        self.used += size

    def of_words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.int64)
        h = word_hashes(data, starts, lengths)
        at = np.searchsorted(self.hashes, h)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == h[known]
        if not known.all():
            if len(self.hashes) > MOST_WORDS or self.used > MOST_BYTES:
                self.forget()
                return self.of_words(data, starts, lengths)
            new, first = np.unique(h[~known], return_index=True)
            own = np.flatnonzero(~known)[first]
            self.keep(new, gathered(data, starts[own], lengths[own]), lengths[own], self.counter.counts(data, starts[own], lengths[own]))
            at = np.searchsorted(self.hashes, h)
        out = self.counts[at]
        same = self.lengths[at] == lengths
        own = np.flatnonzero(same)
        differs = gathered(data, starts[own], lengths[own]) != gathered(self.bytes, self.starts[at[own]], lengths[own])
        if differs.any():
            same[own] = ~np.logical_or.reduceat(differs, np.cumsum(lengths[own]) - lengths[own])
        other = np.flatnonzero(~same)  # another word of the same hash
        out[other] = self.counter.counts(data, starts[other], lengths[other])
        return out

    def of_texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a batch."""
        n = len(offsets) - 1
        out = np.zeros(n, np.int64)
        text = data.tobytes()
        ends = offsets[1:]
        cuts = [(m.start(), m.end()) for s in self.specials if s.encode() in text for m in regex.finditer(regex.escape(s.encode()), text)] if self.special else []
        if cuts:  # a special string is one token and ends what is before it; strings across texts do not count
            cuts = [c for c in sorted(cuts) if np.searchsorted(ends, c[0], "right") == np.searchsorted(ends, c[1] - 1, "right")]
            out += np.bincount(np.searchsorted(ends, [c[0] for c in cuts], "right"), minlength=n)[:n] if cuts else 0
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        if not len(lead):
            return out
        cls = classes()[np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32)]
        hidden = np.zeros(len(lead), bool)
        for a, b in cuts:
            hidden[np.searchsorted(lead, a) : np.searchsorted(lead, b)] = True
        cls[hidden] = END
        # an END between texts, so that no pre-token crosses
        breaks = np.searchsorted(lead, offsets[1:-1])
        breaks = breaks[(breaks > 0) & (breaks < len(lead))]
        spread = np.insert(cls, breaks, END)
        begins = np.delete(pretoken_marks(spread), breaks + np.arange(len(breaks)))
        starts = lead[begins]
        stop = np.zeros(len(data) + 1, bool)
        stop[starts] = stop[offsets] = True
        for a, b in cuts:
            stop[a] = stop[b] = True
        edges = np.flatnonzero(stop)
        ends_at = edges[np.searchsorted(edges, starts, "right")]
        counts = self.of_words(data, starts, ends_at - starts)
        sums = np.concatenate(([0], np.cumsum(counts)))
        first = np.searchsorted(starts, offsets)
        return out + sums[first[1:]] - sums[first[:-1]]


@kept
def tokens_of(vocabulary: str) -> Tokens:
    """One per worker process, which runs many tasks."""
    return Tokens(Vocabulary.parse(vocabulary))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text, as the tokenizers library counts without added special tokens.

    `tokenizer` is the path of a byte-level BPE file. Null and empty texts have no bytes and no tokens; rows with
    null or repeated ids are counted like others; other columns are not looked at.
    """
    with open(tokenizer, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        tokens = tokens_of(held.value)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            counts = np.zeros(len(batch), np.int64)
            for i, j in slices(offsets):
                counts[i:j] = tokens.of_texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(released(run, tokens_of), f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

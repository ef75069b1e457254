"""What both tokenizer operators need of a byte-pair vocabulary file: bytes, ranks, exact merging."""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field
from functools import cache

#: Symbols up to which the lowest rank is looked up in a plain list; a rank beyond all.
SHORT, NEVER = 32, 1 << 40


@cache
def byte_letters() -> tuple[str, ...]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return tuple(chr(b) if b in plain else chr(next(spare)) for b in range(256))


def letters(data: bytes) -> str:
    if data.isalnum():  # ASCII letters and digits stand for themselves
        return data.decode()
    table = byte_letters()
    return "".join([table[b] for b in data])


@dataclass
class Vocabulary:
    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    specials: dict[str, int]
    suffix: str = ""
    names: dict[int, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Vocabulary:
        """From the JSON of a tokenizers file whose model is BPE."""
        j = json.loads(text)
        m = j["model"]
        if m["type"] != "BPE" or m.get("byte_fallback") or m.get("ignore_merges") or m.get("dropout") or m.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE models are supported")
        pairs = (tuple(x) if isinstance(x, list) else tuple(x.split(" ", 1)) for x in m["merges"])
        specials = {x["content"]: x["id"] for x in j["added_tokens"]}
        names = {i: t for t, i in [*m["vocab"].items(), *specials.items()]}
        return cls(m["vocab"], {p: i for i, p in enumerate(pairs)}, specials, m.get("end_of_word_suffix") or "", names)

    def merge(self, symbols: list[str]) -> list[str]:
        """Merges the pair of lowest rank, leftmost first, until none is left; n log n for n symbols."""
        n = len(symbols)
        if n <= SHORT:
            part, get = list(symbols), self.ranks.get
            ranks = [get(p, NEVER) for p in zip(part, part[1:])]
            while ranks and (best := min(ranks)) != NEVER:
                i = ranks.index(best)
                part[i : i + 2] = [part[i] + part[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = get((part[i - 1], part[i]), NEVER)
                if i < len(ranks):
                    ranks[i] = get((part[i], part[i + 1]), NEVER)
            return part
        part, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.ranks.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if part[i] else n
            if j >= n or self.ranks.get((part[i], part[j])) != r:
                continue
            part[i] += part[j]
            part[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := self.ranks.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := self.ranks.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [p for p in part if p]

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-token; symbols missing from the vocabulary are dropped, as there is no unknown token."""
        if not word:
            return []
        symbols = list(letters(word))
        symbols[-1] += self.suffix
        return [i for p in self.merge(symbols) if (i := self.ids.get(p)) is not None]

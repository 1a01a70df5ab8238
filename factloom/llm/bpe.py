"""Byte-pair merging shared by the token operators: exact, one word at a time."""

from __future__ import annotations

import json
import unicodedata
from itertools import repeat

import numpy as np


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


LETTERS = byte_letters()
#: White space as Unicode defines it; str.isspace() has four control characters more.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class Merges:
    """The merges of a vocabulary file in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        self.vocab: dict[str, int] = data["model"]["vocab"]
        self.suffix: str = data["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        # The first place of a pair counts, should one be listed twice.
        pairs = list(dict.fromkeys(map(tuple, pairs)))
        self.rank = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self._order = {pair: r for pair, (r, _) in self.rank.items()}
        self._joined = [new for _, new in self.rank.values()]
        self._inner = [self.vocab[c] for c in LETTERS]
        self._last = [self.vocab[c + self.suffix] for c in LETTERS]

    def merge(self, word: str) -> list[int]:
        """Ids of one pretoken, which isn't empty."""
        return self.merge_bytes(word.encode("utf-8", "surrogatepass"))

    def merge_bytes(self, data: bytes) -> list[int]:
        ids = [self._inner[b] for b in data]
        ids[-1] = self._last[data[-1]]
        if len(ids) > 64:
            return self._merge_long(ids)
        get, joined, none = self._order.get, self._joined, len(self._joined)
        found = [*map(get, zip(ids, ids[1:]), repeat(none))]
        while found and (best := min(found)) != none:
            at = found.index(best)
            ids[at] = joined[best]
            del ids[at + 1], found[at]
            if at:
                found[at - 1] = get((ids[at - 1], ids[at]), none)
            if at < len(found):
                found[at] = get((ids[at], ids[at + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, for words of any length."""
        from heapq import heapify, heappop, heappush

        rank, n = self.rank, len(ids)
        ahead, back, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = [(*rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapify(heap)
        while heap:
            r, new, i = heappop(heap)
            j = ahead[i]
            if not alive[i] or j >= n or rank.get((ids[i], ids[j])) != (r, new):
                continue
            ids[i], alive[j] = new, False
            ahead[i] = ahead[j]
            if ahead[i] < n:
                back[ahead[i]] = i
            for a, b in ((back[i], i), (i, ahead[i])):
                if a >= 0 and b < n and (p := rank.get((ids[a], ids[b]))):
                    heappush(heap, (*p, a))
        return [t for t, kept in zip(ids, alive) if kept]


def pieces_of(texts: list[str], most: int) -> list[slice]:
    """Consecutive texts in slices of about ``most`` characters, at least one text each."""
    out, start, size = [], 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            out.append(slice(start, i))
            start, size = i, 0
        size += len(text)
    return [*out, slice(start, len(texts))]


def general_category_table() -> np.ndarray:
    """For each code point: 0 letter, 1 number, 2 white space, 3 anything else."""
    table = np.full(0x110000, 3, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = 0
        elif kind == "N":
            table[code] = 1
    table[[ord(c) for c in WHITE]] = 2
    return table

"""Licence scan over a positional index of rare licence words.

Fixed phrases give the base labels. For the method, every template is a sequence
of words with its positions. The document frequency of each template word is
counted over all documents (the vocabulary is fixed, so the counts are a few
hundred rows), which gives its inverse document frequency. Every template word has postings:
the templates and places that hold it. Of each file the licence words of highest IDF
are looked up (the rarer half of those it holds, ``look_up`` at least, and the words of
mandatory phrases whose words it holds all), and the postings are intersected by relative position (file position minus template position,
within ``slack`` words). Where half of a template's ``rare`` rarest words, as a
number, agree, the template is aligned; there it must repeat ``min_cover`` of its
words and all its mandatory phrases.

Defined cases: null text is the empty text, with no words, no label and score 0.
Texts are scanned whole. Repeated rows give repeated rows, extra columns are
ignored, an empty table gives an empty result. Labels are distinct and sorted.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import map_rows, slices, table, texts

# Phrases of the contract and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Label, words of the template, mandatory phrases in it.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms", "are permitted")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu general public license",)),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ("has waived all copyright",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    # Titles.
    ("mit", "mit license", ("mit license",)),
    ("isc", "isc license", ("isc license",)),
    ("apache-2.0", "apache license version 2 0 january 2004", ("apache license", "version 2 0")),
    ("bsd", "bsd 3 clause license", ("bsd 3 clause",)),
    ("bsd", "bsd 2 clause license", ("bsd 2 clause",)),
    ("gpl-3", "gnu general public license version 3 29 june 2007", ("gnu general public license", "version 3")),
    ("gpl-2", "gnu general public license version 2 june 1991", ("gnu general public license", "version 2")),
    ("lgpl", "gnu lesser general public license version", ("gnu lesser general public license",)),
    ("agpl", "gnu affero general public license version 3", ("gnu affero general public license",)),
    ("mpl-2.0", "mozilla public license version 2 0", ("mozilla public license",)),
    # Further sentences of the whole texts.
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ("distributed under the license", "as is")),
    ("apache-2.0", "grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of", ("royalty free irrevocable",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included",)),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", ("redistributions in binary form",)),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ("endorse or promote products",)),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", ("verbatim copies of this license document",)),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", ("copy modify publish use compile sell",)),
) + tuple(
    # Tags of one line; what stands for each licence there is its identifier.
    (label, f"spdx license identifier {words}", (f"identifier {words}",))
    for label, words in (
        ("mit", "mit"), ("isc", "isc"), ("apache-2.0", "apache 2 0"), ("bsd", "bsd 3 clause"), ("bsd", "bsd 2 clause"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("lgpl", "lgpl 2 1"),
        ("lgpl", "lgpl 3 0"), ("agpl", "agpl 3 0"), ("mpl-2.0", "mpl 2 0"), ("cc0", "cc0 1 0"), ("cc-by-sa", "cc by sa 4 0"), ("cc-by-nc", "cc by nc 4 0"), ("unlicense", "unlicense"),
    )
)

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_EDGE, _GAP = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]+"


def _phrase(phrase: str) -> re.Pattern:
    return re.compile(rb"(?<!" + _EDGE + rb")" + _GAP.join(re.escape(w.encode()) for w in phrase.split()) + rb"(?!" + _EDGE + rb")")


_BASE = tuple((_phrase(p), label) for p, label in BASE)
VOCABULARY = frozenset(w.encode() for _, words, _ in TEMPLATES for w in words.split())


def lowered(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased; every byte of another letter is above 0x7F."""
    return text.encode("utf-8", "surrogatepass").lower()


def word_starts(data: bytes) -> np.ndarray:
    """Byte offsets at which words start."""
    inside = _IS_WORD[np.frombuffer(data, np.uint8)]
    return np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1]))) if len(data) else np.zeros(0, np.int64)


def document_frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of those that hold each template word.

    Each task sums over its own rows; what is gathered is one row for each word
    of the fixed vocabulary.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, defaultdict(int)
        for batch in slices(batches):
            total += batch.num_rows
            for text in texts(batch):
                for w in VOCABULARY.intersection(_WORD.findall(lowered(text))):
                    df[w] += 1
        words = ["", *(w.decode() for w in df)]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([total, *df.values()], pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return found.pop(b"", 0), found


@dataclass(frozen=True)
class LicenceIndex:
    """Postings of the templates' words by rarity, and what is needed to verify."""

    words: tuple[tuple[bytes, ...], ...]
    labels: tuple[str, ...]
    order: dict[bytes, int]
    postings: dict[bytes, tuple[tuple[int, int], ...]]
    enough: tuple[int, ...]
    phrases: tuple[tuple[tuple[bytes, ...], ...], ...]
    needed: tuple[frozenset[bytes], ...]
    look_up: int
    slack: int
    min_cover: float

    @classmethod
    def build(cls, n_docs: int, df: dict[bytes, int], rare: int = 4, slack: int = 2, min_cover: float = 0.75, look_up: int = 24) -> LicenceIndex:
        idf = lambda w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1
        order = {w: i for i, w in enumerate(sorted(VOCABULARY, key=lambda w: (-idf(w), w)))}
        postings: dict[bytes, list] = defaultdict(list)
        words = tuple(tuple(w.encode() for w in text.split()) for _, text, _ in TEMPLATES)
        for t, sequence in enumerate(words):
            for place, w in enumerate(sequence):
                postings[w].append((t, place))
        phrases = tuple(tuple(tuple(w.encode() for w in p.split()) for p in keys) for _, _, keys in TEMPLATES)
        needed = tuple(frozenset(w for key in keys for w in key) for keys in phrases)
        enough = tuple(min(-(-min(rare, len(set(sequence))) // 2), len(own)) for sequence, own in zip(words, needed))
        return cls(words, tuple(label for label, _, _ in TEMPLATES), order, {k: tuple(v) for k, v in postings.items()}, enough, phrases, needed, look_up, slack, min_cover)

    def matches(self, words: list[bytes]) -> dict[str, float]:
        """Label to the best share of a template's words that stand in place."""
        held = VOCABULARY.intersection(words)
        # A template whose mandatory phrases' words the file lacks cannot be verified.
        possible = {t for t, needed in enumerate(self.needed) if needed <= held}
        if not possible:
            return {}
        chosen = set(sorted(held, key=self.order.__getitem__)[: max(self.look_up, -(-len(held) // 2))]).union(*(self.needed[t] for t in possible))
        offsets: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
        for at, w in enumerate(words):
            if w in chosen:
                for t, place in self.postings[w]:
                    if t in possible:
                        offsets[t][at - place].add(w)
        found: dict[str, float] = {}
        for t, by_offset in offsets.items():
            for offset in by_offset:
                near = set().union(*(by_offset.get(offset + d, ()) for d in range(-self.slack, self.slack + 1)))
                if len(near) >= self.enough[t]:
                    share = self.verify(t, offset, words)
                    if share >= self.min_cover:
                        found[self.labels[t]] = max(found.get(self.labels[t], 0.0), share)
        return found

    def verify(self, t: int, offset: int, words: list[bytes]) -> float:
        """Share of a template's words that stand in place at an offset; 0 without its mandatory phrases."""
        template = self.words[t]
        low = max(0, offset - self.slack)
        window = words[low : max(0, offset + len(template) + self.slack)]
        for key in self.phrases[t]:
            if not any(tuple(window[i : i + len(key)]) == key for i in range(len(window) - len(key) + 1)):
                return 0.0
        hits = sum(1 for i, w in enumerate(template) if w in window[max(0, offset + i - self.slack - low) : max(0, offset + i + self.slack + 1 - low)])
        return hits / len(template)


def scan_text(text: str, index: LicenceIndex) -> tuple:
    data = lowered(text)
    words = _WORD.findall(data)
    places, base = [], set()
    starts = None
    for pattern, label in _BASE:
        # Places may overlap, so each search starts one byte after the last.
        m = pattern.search(data)
        while m:
            starts = word_starts(data) if starts is None else starts
            places.append(int(np.searchsorted(starts, m.start())))
            base.add(label)
            m = pattern.search(data, m.start() + 1)
    found = index.matches(words)
    score = max([1.0 if base else 0.0, *found.values()])
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found.keys())), score


def scan_licences(docs: DataFrame, rare: int = 4, slack: int = 2, min_cover: float = 0.75) -> DataFrame:
    """Base phrases, template labels and score of each document."""
    docs = docs.select("doc_id", "text")
    index = LicenceIndex.build(*document_frequencies(docs), rare=rare, slack=slack, min_cover=min_cover)

    def scan(batch: pa.RecordBatch) -> dict:
        rows = [scan_text(t, index) for t in texts(batch)]
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
        return {"doc_id": batch.column("doc_id").cast(pa.int64())} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return map_rows(docs, SCHEMA, scan)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents", "doc_id", "text"))

"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The lexicon holds the frequent words: the runs of letters that occur most often in
all texts, counted before (``least`` times or more, ``most_words`` at most, all above
one count). It decides how fast a word is found, never its ids. The words are compiled with their
id sequences into a minimal acyclic automaton, built from sorted words with shared
suffixes. A transition carries the number of words that sort before it below its
state; the sum along a path is the word's number, and that number finds its ids.
The driver compiles it once (some 3 MB at 65,536 words, a bound that doesn't hang on
the input). On executors all parts lie in one memory-mapped file without a name,
one for each Python worker, which goes away with the worker. Words of a batch walk
the automaton in step, all at once. A word outside the lexicon is merged exactly.
What words became is kept, up to ``keep`` words and a batch.

Defined cases: null text is the empty text, of no ids. Special strings inside a
text become their ids, as in the library. Texts are read whole; repeated rows
repeat; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import mmap
import re
import struct
import tempfile
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.bpe import LETTERS, WHITE, Merges, pieces_of
from factloom.llm.common import map_rows, most_counted, table, texts

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
BATCH_CHARACTERS = 2_000_000

_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACE = re.escape(WHITE)


# What the regex module takes for letters and numbers and Unicode 16, which the library follows, doesn't.
YOUNGER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB "
    "11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 "
    "191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
# Lower case of capitals that Unicode 16 and 17 added, which str.lower() may not know.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_younger = "".join("-".join(chr(int(x, 16)) for x in span.split("-")) for span in YOUNGER.split())
_WORD = regex.compile(rf"{_CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
#: The same for texts that hold a character of the two lists; slower, and rarely needed.
_ANY_WORD = regex.compile(
    rf"(?V1){_CONTRACTIONS}|[\p{{L}}--[{_younger}]]+|[\p{{N}}--[{_younger}]]|(?:[^{_SPACE}\p{{L}}\p{{N}}]|[{_younger}])+"
)
_RARE = re.compile(f"[{_younger}{''.join(map(chr, LOWER))}]")


def _beyond_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return False


def words_of(text: str) -> list[str]:
    """Pretokens of a text without special strings: NFC, lower case, white space dropped."""
    if text.isascii():
        return _WORD.findall(text.lower())
    # Letters are lowered one by one, so there is no final sigma.
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    if _beyond_latin(text) and _RARE.search(text):
        return _ANY_WORD.findall(text.translate(LOWER).lower())
    return _WORD.findall(text.lower())


def minimal_automaton(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """keys, targets, numbers and finals of the minimal automaton of sorted distinct words.

    A key is state * 256 + byte, in order; number counts the words of a state
    that sort before the transition's. State 0 is the start.
    """
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, state), ...)), from the leaves up
    path: list[list] = [[False, []]]  # of the last word: final, finished children

    def freeze(down_to: int) -> None:
        while len(path) > down_to + 1:
            final, children, byte = path.pop()
            shape = (final, tuple(children))
            if shape not in register:
                register[shape] = len(states)
                states.append(shape)
            path[-1][1].append((byte, register[shape]))

    before = b""
    for word in words:
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        freeze(same)
        path += [[False, [], b] for b in word[same:]]
        path[-1][0] = True
        before = word
    freeze(0)
    states.append((path[0][0], tuple(path[0][1])))
    size: list[int] = []
    for final, children in states:
        size.append(final + sum(size[s] for _, s in children))
    keys, targets, numbers = [], [], []
    last = len(states) - 1  # renumbered from the end, so the start is 0
    for at, (final, children) in enumerate(reversed(states)):
        number = int(final)
        for byte, s in children:
            keys.append(at << 8 | byte)
            targets.append(last - s)
            numbers.append(number)
            number += size[s]
    finals = np.array([s[0] for s in reversed(states)], bool)
    return np.array(keys, np.int64), np.array(targets, np.int32), np.array(numbers, np.int32), finals


def compiled(merges: Merges, words: list[str]) -> dict[str, np.ndarray]:
    """The automaton of the words, and the ids of each by its number."""
    known = sorted({w.encode() for w in words if w})
    ids = [merges.merge_bytes(w) for w in known]
    parts = dict(zip(("keys", "targets", "numbers", "finals"), minimal_automaton(known)))
    return parts | {"offsets": np.cumsum([0, *map(len, ids)], dtype=np.int64), "ids": np.array([x for i in ids for x in i], np.uint32)}


def whole_words(merges: Merges) -> list[str]:
    """The words that the vocabulary itself keeps whole; half a character is no word of any text."""
    byte_of, suffix = {c: b for b, c in enumerate(LETTERS)}, merges.suffix
    known = (bytes(byte_of[c] for c in t.removesuffix(suffix)) for t in merges.vocab if t.endswith(suffix))
    return [w for b in known if (w := b.decode(errors="ignore")).encode() == b]


def frequent_words(docs: DataFrame, most_words: int, least: int = 2) -> list[str]:
    """The runs of letters that occur most often in all texts, lower-cased; at most ``most_words``, all of at least the same count."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(\\p{L}+)"), F.lit(1))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("c")).where("length(word) <= 64")
    return [r["word"] for r in most_counted(counted, most_words, least).sort(F.desc("c"), "word").collect()]


class Lexicon:
    """Word to ids: a memory-mapped automaton first, exact merging for the rest."""

    def __init__(self, path: str, parts: dict[str, np.ndarray] | None = None, keep: int = 150_000):
        self.merges, self.keep = Merges(path), keep
        # What words of earlier batches became; a word walks the automaton, or is merged, once.
        self.coded: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}
        parts = compiled(self.merges, whole_words(self.merges)) if parts is None else parts
        self.n_words, self.n_states = len(parts["offsets"]) - 1, len(parts["finals"])
        with tempfile.TemporaryFile() as file:
            places = {}
            for name, array in parts.items():
                file.write(b"\0" * (-file.tell() % 8))
                places[name] = (file.tell(), array.dtype, len(array))
                file.write(array.tobytes())
            file.flush()
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        for name, (at, dtype, n) in places.items():
            setattr(self, name, np.frombuffer(self._map, dtype, n, at))

    def numbers_of(self, words: list[bytes]) -> np.ndarray:
        """The number of each word in the lexicon, or -1."""
        out = np.full(len(words), -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8)
        begins = np.cumsum(lengths) - lengths
        active = np.arange(len(words))
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(active):
            ended = lengths[active] == step
            done = active[ended]
            out[done] = np.where(self.finals[state[done]], number[done], -1)
            active = active[~ended]
            key = state[active] << 8 | letters[begins[active] + step]
            if not len(self.keys):
                break
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            active, at = active[there], at[there]
            state[active] = self.targets[at]
            number[active] += self.numbers[at]
            step += 1
        return out

    def ids_of(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of each distinct word."""
        found = self.numbers_of([w.encode("utf-8", "surrogatepass") for w in words])
        out = {}
        for word, number in zip(words, found.tolist()):
            out[word] = self.ids[self.offsets[number] : self.offsets[number + 1]].tolist() if number >= 0 else self.merges.merge(word)
        return out

    @property
    @lru_cache(maxsize=1)  # noqa: B019
    def _special(self) -> re.Pattern:
        return re.compile("(" + "|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True))) + ")")

    def split(self, text: str) -> list[str]:
        """Pretokens, with special strings as items of their own."""
        if "<|" not in text:
            return words_of(text)
        return [w for i, part in enumerate(self._special.split(text)) for w in ([part] if i % 2 else words_of(part))]

    def encode(self, batch: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the decoded text."""
        split = [self.split(t) for t in batch]
        if len(self.coded) > self.keep:
            self.coded, self.decoded = {}, {}
        new = set(chain.from_iterable(split)).difference(self.coded)
        special = self.merges.special
        known = self.ids_of([w for w in new if w not in special]) | {s: [special[s]] for s in new & special.keys()}
        for word, ids in known.items():
            self.coded[word] = struct.pack(f"<{len(ids)}I", *ids)
            self.decoded[word] = self.decode(ids)
        coded, decoded = self.coded.__getitem__, self.decoded.__getitem__
        return [(b"".join(map(coded, words)), " ".join(map(decoded, words))) for words in split]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder of its own: its entries, joined by spaces."""
        names = self.merges.names
        return " ".join([names[i] for i in ids])


@lru_cache(maxsize=2)
def lexicon(path: str) -> Lexicon:
    """Of the words that the vocabulary keeps whole, where no corpus is at hand."""
    return Lexicon(path)


_LEXICONS: dict[tuple[str, str], Lexicon] = {}


def _lexicon_of(path: str, digest: str, parts: dict[str, np.ndarray]) -> Lexicon:
    """The worker's lexicon of these parts, made when first asked for."""
    if (path, digest) not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[path, digest] = Lexicon(path, parts)
    return _LEXICONS[path, digest]


def encode_decode(docs: DataFrame, path: str, keep_ids: bool = False, most_words: int = 1 << 16, least: int = 16) -> DataFrame:
    """doc_id, number of ids and the hashes of ids and decoded text.

    With ``keep_ids`` the ids (little-endian) and the decoded text are returned too.
    """
    words = frequent_words(docs, most_words, least)
    parts, digest = compiled(Merges(path), words), hashlib.sha256("\n".join(words).encode()).hexdigest()

    def encode(batch: pa.RecordBatch) -> dict:
        lex, all_texts = _lexicon_of(path, digest, parts), texts(batch)
        rows = []
        for s in pieces_of(all_texts, BATCH_CHARACTERS):
            for ids, decoded in lex.encode(all_texts[s]):
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest(), *((ids, decoded) if keep_ids else ())))
        names = ("n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if keep_ids else ()))
        return {"doc_id": batch.column("doc_id").cast(pa.int64())} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return map_rows(docs.select("doc_id", "text"), SCHEMA + (", ids binary, decoded string" if keep_ids else ""), encode)


def op7_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))

"""Token counts with a compiled finite-state tokenizer.

The machine has two levels. The split into pretokens is a deterministic transducer
of eight states over nine character classes; a character's class includes what its
pattern looks ahead for (a contraction, or the last white space of a run). Each
transition says whether a pretoken starts. A batch is cut into chunks: for all
chunks at once the map from every entry state to the exit state is computed, the
maps compose in a parallel prefix scan (doubling), and with each chunk's entry
state known the transitions are taken.

A start of a pretoken resets the second level, a deterministic transducer over
bytes (``Transitions``) whose every transition is annotated with the tokens that it
emits: the number of tokens of the prefix read with the byte, less that without it
(negative where the byte joins tokens). Its states are those that byte-pair
encoding can tell apart: the longest suffix read that begins a vocabulary entry,
and for each of its places the last token of the prefix that ends there and the
tokens since. The last token of a longer prefix is the entry that may follow the
last token before it: a token sequence is the encoding of its text exactly if each
two neighbours are the encoding of theirs, which is found once for each two tokens
by merging. Transitions are compiled when first taken, for 400,000 states at a time. Counts of whole pretokens
are kept, up to ``keep``, so a frequent word walks the machine once.

Defined cases: null text is the empty text, of no tokens. A special string inside
a text is one token, and the text on either side of it is split on its own. Texts
are read whole; repeated rows repeat; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.bpe import LETTERS, Merges, general_category_table, pieces_of
from factloom.llm.common import map_rows, table, texts

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
CHUNK, BATCH_CHARACTERS = 128, 2_000_000

# States: fresh start, letters, numbers, others, a space that joins what follows,
# white space, one and two letters of a contraction to come.
X, L, N, O, P, W, K1, K2 = range(8)
# Classes: letter, number, other, apostrophe of a contraction of two and of three
# characters, white space inside a run, its last if no space, its last if a
# space, end of a text.
LETTER, NUMBER, OTHER, SHORT, LONG, INSIDE, LAST, JOINS, END = range(9)


def _transition(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a pretoken starts with this character."""
    if state in (K1, K2):
        return (X if state == K1 else K1), False
    run = {LETTER: L, NUMBER: N, OTHER: O}.get(kind)
    if run is not None:
        return run, state not in (run, P)
    if kind in (SHORT, LONG):
        return (O, False) if state in (O, P) else (K1 if kind == SHORT else K2, True)
    if kind == INSIDE:
        return W, state != W
    return (P if kind == JOINS else X), True


NEXT = np.array([_transition(s, k)[0] for s in range(8) for k in range(9)], np.uint8)
STARTS = np.array([_transition(s, k)[1] for s in range(8) for k in range(9)], bool)


@lru_cache(maxsize=1)
def _categories() -> np.ndarray:
    return general_category_table()


def classes(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each code point; ends marks the ends of texts."""
    kind = _categories()[codes]
    kind[ends] = 4
    out = np.array([LETTER, NUMBER, LAST, OTHER, END], np.uint8)[kind]
    ahead = np.concatenate((kind[1:], np.full(1, 4, np.uint8)))
    white = kind == 2
    out[white & ((ahead == 2) | (ahead == 4))] = INSIDE
    out[white & (out == LAST) & (codes == 0x20)] = JOINS
    marks = np.flatnonzero((codes == 0x27) & ~ends)
    if len(marks):
        padded = np.concatenate((codes, np.zeros(2, codes.dtype)))
        one, two = padded[marks + 1], padded[marks + 2]
        is_end = np.concatenate((ends, np.ones(2, bool)))
        short = np.isin(one, [ord(c) for c in "stmd"]) & ~is_end[marks + 1]
        long = np.zeros(len(marks), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b)) & ~is_end[marks + 1] & ~is_end[marks + 2]
        out[marks[short]] = SHORT
        out[marks[long]] = LONG
    return out


def pretoken_starts(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Places at which a pretoken, or the end of a text, starts."""
    n = len(kinds)
    rows = max(1, -(-n // chunk))
    columns = np.full(rows * chunk, END, np.uint8)
    columns[:n] = kinds
    columns = np.ascontiguousarray(columns.reshape(rows, chunk).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in columns:
        maps = NEXT[maps * 9 + column[:, None]]
    step = 1
    while step < rows:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.full(rows, X, np.uint8)
    state[1:] = maps[:-1, X]
    starts = np.empty((chunk, rows), bool)
    for i, column in enumerate(columns):
        taken = state * 9 + column
        starts[i] = STARTS[taken]
        state = NEXT[taken]
    return np.flatnonzero(starts.T.reshape(-1)[:n])


class Transitions:
    """Deterministic transitions over the bytes of a pretoken, compiled when first taken.

    State 0 has read nothing. ``steps`` maps state * 256 + byte to the next state and
    the tokens emitted.
    """

    def __init__(self, merges: Merges, most_states: int = 400_000):
        self.merges, self.most_states = merges, most_states
        byte_of = {c: b for b, c in enumerate(LETTERS)}
        self.entries = {bytes(byte_of[c] for c in t): i for t, i in merges.vocab.items() if t not in merges.special}
        self.bytes_of = {i: e for e, i in self.entries.items()}
        self.begins = {e[:k] for e in self.entries for k in range(1, len(e) + 1)}
        self._whole: dict[bytes, bool] = {}
        self.clear()

    def clear(self) -> None:
        # Of a state: the suffix it holds, and for each place in it the last token's id and the tokens from there on.
        start = (b"", (-1, 0))
        self.steps: dict[int, tuple[int, int]] = {}
        self.states, self.numbers = [start], {start: 0}
        self._follows: dict[int, bool] = {}

    def _is_whole(self, token: bytes) -> bool:
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = len(self.merges.merge_bytes(token)) == 1
        return known

    def _may_follow(self, before: int, token: bytes) -> bool:
        own = self.entries[token]
        if (known := self._follows.get(before << 32 | own)) is None:
            known = self._follows[before << 32 | own] = self.merges.merge_bytes(self.bytes_of[before] + token) == [before, own]
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        held, places = self.states[state]
        read = held + bytes([byte])
        for start in range(len(read)):
            token = read[start:]
            before, since = places[2 * start : 2 * start + 2]
            # Counts are relative to the state's end: ``since`` tokens stand behind the place.
            if token in self.entries and self._is_whole(token) and (before < 0 or self._may_follow(before, token)):
                emitted = 1 - since
                break
        else:
            raise ValueError("a byte without a vocabulary entry")
        cut_at = next(k for k in range(len(read) + 1) if k == len(read) or read[k:] in self.begins)
        kept = [x + emitted if k % 2 else x for k, x in enumerate(places[2 * cut_at :])]
        target = (read[cut_at:], (*kept, self.entries[token], 0))
        if (number := self.numbers.get(target)) is None:
            if len(self.states) >= self.most_states:
                # Only the state that is left for stays known; a word may be longer than all that is kept.
                self.clear()
                state = -1
            number = self.numbers.setdefault(target, len(self.states))
            if number == len(self.states):
                self.states.append(target)
        if state >= 0:
            self.steps[state << 8 | byte] = (number, emitted)
        return number, emitted

    def count(self, data: bytes) -> int:
        state = total = 0
        for byte in data:
            step = self.steps.get(state << 8 | byte)
            state, emitted = step if step is not None else self.compile(state, byte)
            total += emitted
        return total


class Transducer(dict):
    """Pretoken to token count, by the machine; counts are kept up to ``keep`` pretokens."""

    def __init__(self, path: str, keep: int = 1_000_000):
        super().__init__()
        self.merges, self.keep = Merges(path), keep
        self.transitions = Transitions(self.merges)

    def __missing__(self, word: str) -> int:
        count = self.transitions.count(word.encode("utf-8", "surrogatepass"))
        if len(self) >= self.keep:
            self.clear()
        self[word] = count
        return count

    def counts(self, batch: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        out = np.zeros(len(batch), np.int64)
        parts, owner = [], []
        for i, text in enumerate(batch):
            pieces = [text]
            for special in self.merges.special:
                if special in text:
                    pieces = [p for piece in pieces for p in piece.split(special)]
            out[i] = len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        joined = "\n".join(parts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        last = np.cumsum([len(p) + 1 for p in parts]) - 1
        ends = np.zeros(len(codes), bool)
        ends[last] = True
        starts = pretoken_starts(classes(codes, ends))
        at = starts.tolist()
        at.append(len(joined))
        is_end = ends[starts]
        found = np.fromiter((0 if e else self[joined[a:b]] for a, b, e in zip(at, at[1:], is_end.tolist())), np.int64, len(starts))
        np.add.at(out, np.array(owner)[np.searchsorted(last, starts)], found)
        return out


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, UTF-8 length, tokens, and whether these are over the limit."""

    def count(batch: pa.RecordBatch) -> dict:
        machine, all_texts = transducer(path), texts(batch)
        found = np.concatenate([machine.counts(all_texts[s]) for s in pieces_of(all_texts, BATCH_CHARACTERS)])
        return {
            "doc_id": batch.column("doc_id").cast(pa.int64()),
            "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in all_texts],
            "n_tokens": found,
            "over_limit": found > limit,
        }

    return map_rows(docs.select("doc_id", "text"), SCHEMA, count)


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))

"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities and counts of a fixed list of insults and of
terms learned from the training rows, how close these stand to second-person
words, rates of capitals, punctuation and obfuscation, lengths. Learned terms are
words and word beginnings that are far more frequent in toxic training texts.

Fitting is bounded: at most ``max_rows`` labelled rows, those of smallest hash of
their id and text, reach the driver (a documented parameter, the same at every
size), with their whole texts. One half of the training rows chooses the terms,
the other trains the trees, so that no term is judged by the rows that chose it;
calibration comes from folds, on rows that neither have seen.

Labels, lang, source and doc_id are never inputs of a score. Rows whose
crc32(doc_id as text) mod 5 is 0 are held out of everything that is fitted.

Defined cases: null text is the empty text and gets a score too. Repeated rows get
equal scores. Without any training row of either class every score is the share of
toxic training rows (0 without rows). Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import map_rows, slices, table, texts

# Insults and slurs of general use, and words that address a reader.
INSULTS = (
    "abscheulich arschloch asshole bastard bitch bloody clown coward cretin cunt damn disgusting dumb dummkopf dumm dumb estúpido fool freak garbage hate "
    "hateful hell idiot idiota idiote imbecile imbécile imbécil jerk kill kys loser maldito moron pathetic pig pathétique pendejo psycho rat retard salaud "
    "scum shit shut sick slut stupid stupide trash twat ugly vermin whore wichser worthless"
).split()
SECOND_PERSON = "you your yours yourself ur u thou du dich dir dein deine ihr euch euer tu te toi ton ta vous votre ti tú usted vosotros".split()

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_WORDS = re.compile(r"[^\W\d_]+")
_LETTER = rb"[A-Za-z\x80-\xff]"
_MASKED = re.compile(rb"(?<=" + _LETTER + rb")[*@$#0-9!]+(?=" + _LETTER + rb")")
_SHOUTED = re.compile(rb"[A-Z]{3,}")
_KINDS = np.zeros((256, 4))  # of a byte: capital, punctuation, exclamation mark, digit
_KINDS[0x41:0x5B, 0] = 1
_KINDS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)], 1] = 1
_KINDS[0x21, 2] = 1
_KINDS[0x30:0x3A, 3] = 1
_DIGITS = str.maketrans("013457@$", "oieastas")
STEMS = range(3, 9)


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


@dataclass
class Features:
    """What a text becomes. learned: term to weight; a beginning ends in '*'."""

    learned: dict[str, float] = field(default_factory=dict)

    NAMES = (
        "insults", "insult_rate", "near_you", "you_rate", "capitals", "shouted", "punctuation", "exclamations", "masked", "digits", "repeated",
        "words", "distinct", "bytes", "masked_insults", "learned", "learned_rate", "learned_weight", "learned_best",
    )

    def __post_init__(self):
        self._insults, self._you = frozenset(INSULTS), frozenset(SECOND_PERSON)
        self._words = {t: w for t, w in self.learned.items() if not t.endswith("*")}
        self._stems = {t[:-1]: w for t, w in self.learned.items() if t.endswith("*")}
        self._memo: dict[str, float] = {}

    def _weight(self, word: str) -> float:
        found = self._memo.get(word)
        if found is None:
            found = max([self._words.get(word, 0.0), *(self._stems.get(word[:n], 0.0) for n in STEMS if n < len(word))]) if self.learned else 0.0
            if len(self._memo) > 500_000:
                self._memo.clear()
            self._memo[word] = found
        return found

    def words(self, text: str) -> Counter:
        return Counter(_WORDS.findall(text.lower()))

    def plain(self, text: str, counted: Counter) -> list[float]:
        """The features that need no learned terms."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        n, size = max(sum(counted.values()), 1), max(len(data), 1)
        insults = sum(counted[w] for w in self._insults if w in counted)
        you = sum(counted[w] for w in self._you if w in counted)
        capitals, punctuation, exclamations, digits = np.bincount(data, minlength=256) @ _KINDS
        near = masked = masked_insults = 0
        if insults and you:
            words = _WORDS.findall(text.lower())
            places = np.array([i for i, w in enumerate(words) if w in self._you])
            at = np.array([i for i, w in enumerate(words) if w in self._insults])
            after = np.searchsorted(places, at)
            gap = np.minimum(np.abs(places[np.minimum(after, len(places) - 1)] - at), np.abs(places[np.maximum(after - 1, 0)] - at))
            near = int((gap <= 5).sum())
        if punctuation or digits:
            masked = len(_MASKED.findall(data.tobytes()))
        if masked:
            masked_insults = sum(1 for t in text.lower().split() if not t.isalpha() and t.translate(_DIGITS).strip(".,;:!?\"'()") in self._insults)
        same = data[1:] == data[:-1]
        runs = same[2:] & same[1:-1] & same[:-2]
        repeated = int(np.count_nonzero(runs[1:] & ~runs[:-1])) + int(len(runs) > 0 and runs[0])
        return [
            insults, insults / n, near, you / n, capitals / size, len(_SHOUTED.findall(data.tobytes())) / n, punctuation / size, exclamations / size, masked / n,
            digits / size, repeated / n, float(np.log1p(n)), len(counted) / n, float(np.log1p(size)), masked_insults,
        ]

    def from_terms(self, counted: Counter) -> list[float]:
        weight = self._weight
        hits = [(c, v) for w, c in counted.items() if (v := weight(w))]
        learned = sum(c for c, _ in hits)
        return [learned, learned / max(sum(counted.values()), 1), sum(c * v for c, v in hits), max((v for _, v in hits), default=0.0)]

    def of(self, text: str) -> list[float]:
        counted = self.words(text)
        return self.plain(text, counted) + self.from_terms(counted)


def learned_terms(sample: list[Counter], labels: np.ndarray, max_terms: int = 512, least: int = 4) -> dict[str, float]:
    """Words and word beginnings with the largest log odds of toxic texts to others."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for words, toxic in zip(sample, labels):
        counts[int(toxic)].update(words.keys() | {w[:k] + "*" for w in words for k in STEMS if k < len(w)})
    ones, zeros = max(1, int(labels.sum())), max(1, len(labels) - int(labels.sum()))
    found = {}
    for term, c in counts[1].items():
        a, b = (c + 0.5) / (ones + 1), (counts[0][term] + 0.5) / (zeros + 1)
        deviation = np.sqrt(1 / (c + 0.5) + 1 / (counts[0][term] + 0.5))
        odds = np.log(a / b)
        if c >= least and odds > 2 and odds / deviation > 2:
            found[term] = float(odds / deviation)
    best = sorted(found, key=lambda t: (-found[t], t))[:max_terms]
    return {t: found[t] for t in best}


# ---------------------------------------------------------------- trees


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for part, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            part.append(x)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right = np.array(self.feature), np.array(self.threshold), np.array(self.left), np.array(self.right)
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
        return np.array(self.value)[at]


def _grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float) -> Tree:
    tree = Tree()
    stack = [(tree.add(), np.arange(len(g)), 0)]
    while stack:
        node, rows, level = stack.pop()
        gain, best = 1e-6, None
        total_g, total_h = g[rows].sum(), h[rows].sum()
        if level < depth and len(rows) > 1:
            for f, edge in enumerate(edges):
                if not len(edge):
                    continue
                bins = binned[rows, f]
                left_g = np.cumsum(np.bincount(bins, g[rows], len(edge) + 1))[:-1]
                left_h = np.cumsum(np.bincount(bins, h[rows], len(edge) + 1))[:-1]
                right_g, right_h = total_g - left_g, total_h - left_h
                gains = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - total_g**2 / (total_h + ridge)
                gains[(left_h < least) | (right_h < least)] = 0
                if gains.max() > gain:
                    gain, best = gains.max(), (f, int(gains.argmax()))
        if best is None:
            tree.value[node] = -total_g / (total_h + ridge)
            continue
        f, cut_at = best
        goes_left = binned[rows, f] <= cut_at
        tree.feature[node], tree.threshold[node] = f, float(edges[f][cut_at])
        tree.left[node], tree.right[node] = tree.add(), tree.add()
        stack += [(tree.left[node], rows[goes_left], level + 1), (tree.right[node], rows[~goes_left], level + 1)]
    return tree


@dataclass
class Boosted:
    """Boosted trees for the log odds of label 1, by second-order gains on binned features."""

    base: float = 0.0
    rate: float = 0.15
    trees: list[Tree] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, bins: int = 48, least: float = 2.0, ridge: float = 1.0) -> Boosted:
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        model = cls(float(np.log(share / (1 - share))))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        edges = [e[e < c.max()] for e, c in zip(edges, x.T)]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        odds = np.full(len(y), model.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-odds))
            tree = _grow(x, binned, edges, p - y, p * (1 - p), depth, least, ridge)
            model.trees.append(tree)
            odds += model.rate * tree.predict(x)
        return model

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places and the nondecreasing values at them."""
    order = np.argsort(score, kind="stable")
    places, first = np.unique(score[order], return_index=True)
    weight = np.diff(np.append(first, len(score))).astype(float)
    sums = np.add.reduceat(y[order].astype(float), first)
    blocks: list[list[float]] = []
    for s, w, n in zip(sums, weight, np.ones(len(sums))):
        blocks.append([s, w, n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2] + n]
    return places, np.repeat([s / w for s, w, _ in blocks], [int(n) for _, _, n in blocks])


@dataclass
class Model:
    features: Features
    trees: Boosted | None
    places: np.ndarray
    values: np.ndarray
    share: float

    def score(self, batch: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(batch), self.share)
        x = np.array([self.features.of(t) for t in batch], float).reshape(len(batch), len(Features.NAMES))
        odds = self.trees.odds(x)
        # The calibrated value decides; the odds order what it leaves equal.
        return np.clip(np.interp(odds, self.places, self.values) + 1e-6 / (1 + np.exp(-odds)), 0, 1)


def fit(sample: list[str], labels: np.ndarray, folds: int = 3) -> Model:
    """A model from texts and labels of 0 and 1, on the driver."""
    labels = np.asarray(labels, float)
    share = float(labels.mean()) if len(labels) else 0.0
    none = np.zeros(1)
    if len(labels) < 20 or labels.sum() < 5 or labels.sum() > len(labels) - 5:
        return Model(Features(), None, none, none, share)
    empty = Features()
    counted = [empty.words(t) for t in sample]
    plain = np.array([empty.plain(t, c) for t, c in zip(sample, counted)])

    def trained(rows: np.ndarray) -> tuple[Features, Boosted]:
        # Terms come from one half, so that their features aren't too good on the trees' rows.
        terms, rest = rows[::2], rows[1::2]
        features = Features(learned_terms([counted[i] for i in terms], labels[terms]))
        return features, Boosted.fit(inputs(features, rest), labels[rest])

    def inputs(features: Features, rows: np.ndarray) -> np.ndarray:
        return np.hstack((plain[rows], [features.from_terms(counted[i]) for i in rows]))

    everything = np.arange(len(labels))
    odds = np.zeros(len(labels))
    for k in range(folds):
        features, trees = trained(everything[everything % folds != k])
        own = everything[everything % folds == k]
        odds[own] = trees.odds(inputs(features, own))
    places, values = isotonic(odds, labels)
    return Model(*trained(everything), places, values, share)


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[list[str], np.ndarray]:
    """At most max_rows labelled rows that aren't held out, in a fixed pseudorandom order."""
    rows = labels.where(F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", "toxic")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    joined = docs.join(F.broadcast(rows), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic", F.xxhash64("doc_id", "text").alias("o"))
    found = joined.orderBy("o", "toxic").limit(max_rows).toArrow()
    return found.column("text").to_pylist(), (np.array(found.column("toxic").to_pylist(), float) > 0).astype(float)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 5000) -> Model:
    return fit(*training_sample(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), max_rows))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    docs = docs.select("doc_id", "text")
    model = train(docs, labels, max_rows)

    def judge(batch: pa.RecordBatch) -> dict:
        scores = model.score(texts(batch))
        return {
            "doc_id": batch.column("doc_id").cast(pa.int64()),
            "held_out": batch.column("held_out"),
            "score": scores,
            "predicted": pa.array((scores >= threshold).astype(np.int32)),
        }

    return map_rows(docs.withColumn("held_out", is_held_out(F.col("doc_id"))), SCHEMA, judge)


def without_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    model = train(docs, labels, max_rows)

    def keep(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(model.score(texts(batch)) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))

"""Operators that bring rows together: near-duplicates, search, mixing, the pipeline."""

import random
from collections import defaultdict
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import knn, mixing, near_dup


# ---------------------------------------------------------------- 8


def brute_components(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append(set(zip(words, words[1:])) if len(words) > 1 else set(map(tuple, [words])) if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    return [(doc, len(s), min(least[find(i)])) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def families(seed):
    """Groups of copies and near copies, a passage that many share, tiny and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows = []
    for group in range(14):
        base = [word() for _ in range(rng.choice((3, 8, 60, 120, 420)))]
        if group % 3 == 0:
            base += passage
        for _ in range(rng.choice((1, 2, 30))):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += ["", None, "one", "ONE", "one two", "One  Two", " \n", "a b c d e f", "a b c d e"]
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows))


@pytest.mark.parametrize(("seed", "small"), [(1, 16), (2, 2)])
def test_near_duplicates_against_brute_force(spark, seed, small):
    rows = families(seed)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")
    found = near_dup.near_duplicates(docs, k=64, small=small).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted(brute_components(rows))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    if seed == 1:
        kept = near_dup.one_of_each(docs)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {c for _, _, c in brute_components(rows)}


def test_near_duplicates_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(empty).count() == 0
    rows = near_dup.near_duplicates(spark.createDataFrame([(7, "a b"), (7, "a b"), (None, "a b"), (9, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in rows) == [(-1, 7), (7, 7), (7, 7), (9, 9)]


def test_one_of_each_of_odd_ids(spark):
    x, y, z = ("x one two three", "y four five six", "z seven eight nine")

    def left(*rows):
        docs = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, more string")
        kept = near_dup.one_of_each(docs)
        assert kept.columns == docs.columns
        return sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)

    assert left((7, x), (7, y), (3, y)) == [(3, y), (7, x)]
    assert left((5, x), (None, x), (6, y)) == [(5, x), (6, y)]
    assert left((None, x), (None, x.upper()), (None, y), (2, y), (2, z), (2, z), (9, z)) in ([(2, y), (2, z), (None, t)] for t in (x, x.upper()))
    long = " ".join(f"w{i}" for i in range(60))
    assert [i for i, _ in left((4, f"{long} a"), (4, f"{long} b"), (8, f"{long} b"), (None, f"{long} c"))] == [4]
    assert left((1, ""), (1, ""), (2, None), (1, x), (3, x), (3, "")) == [(1, ""), (1, x), (2, None), (3, "")]


def test_estimate_and_overlaps():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (4000, 500, 500))
    x, y = np.unique(np.concatenate((common, a))), np.unique(np.concatenate((common, b)))
    assert abs(near_dup.estimate(x[:192], y[:192], 192) - 0.8) < 0.12 and near_dup.linked(x, x)
    shared = near_dup.overlaps([x[:192]], [y[:192], np.array([1], np.uint64)], columns=50)
    assert shared.tolist() == [[len(set(x[:192].tolist()) & set(y[:192].tolist())), 0]]
    assert (shared >= np.maximum.outer(near_dup.least_shared([len(x)], 192), near_dup.least_shared([len(y), 1], 192))).tolist() == [[True, False]]


def test_least_shared_bounds():
    # By definition: P(Binomial(k, 0.8) < m) stays below the chance, and m + 1 would not.
    for k in (12, 64, 192):
        m = near_dup.binomial_floor(k)
        below = lambda m: sum(comb(k, i) * 0.8**i * 0.2 ** (k - i) for i in range(m))  # noqa: E731, B023
        assert below(m) <= near_dup.MISSED < below(m + 1)
    assert near_dup.least_shared([1, 4, 5, 51, 52, 5000], 64).tolist() == [1, 4, 4, 41, near_dup.binomial_floor(64), near_dup.binomial_floor(64)]


def large_families(seed):
    """Long texts about the threshold, a hot group of near copies around one text, a passage that fills most of many."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))

    def edited(base, edits):
        copy = list(base)
        for at in rng.sample(range(len(base)), edits):
            copy[at] = word()
        return copy

    rows = []
    for edits in (1, 9, 40, 50, 55, 60, 70):  # 1,000 words: similarity 0.8 between 55 and 56 edits apart
        base = [word() for _ in range(1000)]
        rows += [base, edited(base, edits), edited(base, edits // 2)]
    centre = [word() for _ in range(150)]
    rows += [centre] + [edited(centre, rng.randint(1, 9)) for _ in range(140)]
    passage = [word() for _ in range(100)]
    rows += [passage + [word() for _ in range(rng.randint(20, 60))] for _ in range(90)]
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"part_rows": 20}, {"k": 1 << 20, "shared": 1}, {"frequent": 0}])
def test_long_texts_and_hot_lists_against_brute_force(spark, options):
    rows = large_families(3)
    found = near_dup.grouped(spark.createDataFrame(rows, "doc_id long, text string"), **({"k": 64, "shared": 4, "small": 16, "frequent": 1 << 18} | options)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted(brute_components(rows))


def test_lists_that_span_batches(spark):
    """A list is whole however its rows fall into batches; lists above ``held`` rows are long at once."""
    rows = [(v, 0, 100 * v + i, 4 << near_dup.SIZE_BITS | 50) for v, c in enumerate((1, 2, 3, 40, 1, 5, 17, 16)) for i in range(c)]
    posted = spark.createDataFrame(rows, "value long, part int, node long, info long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch, held in ((1, 1 << 16), (7, 3), (10_000, 1 << 16)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            found = near_dup.list_rows(posted, 16, held).collect()
            assert sum(r["pair"] for r in found) == 1 + 3 + 10 + 120 or held == 3
            long = {(r["value"], r["a"]) for r in found if not r["pair"]}
            assert {v for v, _ in long} >= {3, 6} and all((v, 100 * v + i) in long for v, c in ((3, 40), (6, 17)) for i in range(c))
            seen = {(r["a"], r["b"]) for r in found if r["pair"]}
            for v, c in ((1, 2), (2, 3), (5, 5), (7, 16)):
                # The pairs of a short list come as pairs, or all its postings as a long list's.
                assert (v, 100 * v) in long and len([x for x in long if x[0] == v]) == c or len([p for p in seen if p[0] // 100 == v]) == c * (c - 1) // 2
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_shingles_of_five_words():
    text = "a b c d e f"
    assert len(near_dup.shingle_set(text, 5)) == 2 and len(near_dup.shingle_set(text)) == 5
    assert len(near_dup.shingle_set("a b", 5)) == len(near_dup.shingle_set("a", 5)) == 1 and not len(near_dup.shingle_set(" \n", 5))
    assert near_dup.shingle_set("a b", 5) != near_dup.shingle_set("b a", 5)


# ---------------------------------------------------------------- 5


def brute_top(rows, k, every):
    usable = [(i, vid, [int(np.floor(1024 * float(x))) for x in v]) for i, (vid, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q, a in usable:
        if q is not None and q % every == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a, b)), vid is None, vid or 0, vid) for j, vid, b in usable if j != i and len(a) == len(b)), key=lambda t: t[:3])
            out += [(q, n + 1, t[3], -t[0]) for n, t in enumerate(scored[:k])]
    return sorted(out, key=str)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]  # one common vector: ties go to the smaller id
    rows += [(2000, None), (2010, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2020, [float("nan")] * 6), (2030, [float("inf")] * 6), (2040, [0.5, 0.25]), (2041, [1.0, 1.0]), (None, rows[7][1]), (20, rows[20][1]), (3000, [1e9] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    rows = [(v, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for v, e in rows]
    found = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in knn.top_k(df, k=7, every=10, shard_rows=60, query_rows=9, first_shards=2).collect()]
    assert sorted(found, key=str) == brute_top(rows, 7, 10)
    assert knn.top_k(df.limit(0)).count() == 0


def test_tree_bounds_hold():
    vectors = np.random.default_rng(6).integers(-50, 50, (700, 5))
    tree = knn.build_tree(vectors, leaf=16)
    ordered = vectors[tree["order"]]
    for (start, end), low, high in zip(tree["spans"], tree["low"], tree["high"]):
        assert (ordered[start:end].min(axis=0) == low).all() and (ordered[start:end].max(axis=0) == high).all()
    assert sorted(tree["order"]) == list(range(700))


# ---------------------------------------------------------------- 3


def filled(sizes, weights=(3, 1, 2)):
    """Targets by resharing what caps cut off, step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > 2 * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def mixed_rows(seed, n):
    rng = random.Random(seed)
    words = lambda k: " ".join(f"w{rng.randrange(99)}" + rng.choice(("", "\n", "\t")) for _ in range(k))
    rows = [(i, words(rng.choice((0, 1, 5, 40, 900))), rng.choice(("a", "a", "a", "é", "Z", "zz", None))) for i in range(n)]
    return rows + [(n, None, "only empty"), (3, "twice here", "a"), (3, "twice here", "a"), (None, "no id", "a")]


def test_mix(spark):
    rows = mixed_rows(1, 300)
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, target double")
    options = {"block_words": 16, "shard_slots": 64}
    found = mixing.taken_words(docs, **options).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"]) for r in found) == sorted((d if d is not None else -1, len((t or "").split())) for d, t, _ in rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    targets, by_target = filled(sizes), defaultdict(int)
    assert sorted({(r["source_size"], round(r["target"], 6)) for r in found}) == sorted({(sizes[s], round(t, 6)) for s, t in targets.items()})
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_target[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert all(abs(taken - target) <= 1 for (_, target), taken in by_target.items())
    again = mixing.taken_words(docs.repartition(7), **options).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.taken_words(docs.limit(0)).count() == 0


def test_mixed_documents_hold_what_is_taken(spark):
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in mixed_rows(2, 120)], "doc_id long, text string, source string, n_chars long")
    options = {"block_words": 16, "shard_slots": 64}
    mixed = mixing.mixed_documents(docs, **options)
    assert mixed.columns == docs.columns
    taken, out = defaultdict(int), defaultdict(int)
    for r in mixing.taken_words(docs, **options).collect():
        taken[r["doc_id"]] += r["taken"]
    originals = defaultdict(set)
    for r in docs.collect():
        originals[r["doc_id"]].add(r["text"])
    for r in mixed.collect():
        out[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
        words = r["text"].split()
        assert any(set(words) <= set((t or "").split()) for t in originals[r["doc_id"]])
    assert {k: v for k, v in taken.items() if v} == dict(out)


def test_permutation_and_draws(spark):
    for n in (1, 2, 7, 100, 1000):
        place = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9), F.lit(1)).alias("p"))
        assert sorted(r["p"] for r in place.collect()) == list(range(n))
    plan = spark.createDataFrame([(0, 5000), (1, 40), (2, 0)], "source_no long, n_slots long")
    slots = mixing._drawn_slots(plan, 4, 1).collect()
    assert sorted((r["source_no"], r["slot"]) for r in slots) == [(0, i) for i in range(5000)] + [(1, i) for i in range(40)]
    counts = np.bincount([r["shard"] for r in slots if r["source_no"] == 0], minlength=16)
    assert len(counts) == 16 and (np.abs(counts - 312.5) < 6 * np.sqrt(312.5)).all() and counts.std() > 3  # drawn, not dealt

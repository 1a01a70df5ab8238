"""Operators whose work must not outgrow their input."""

import random
from collections import Counter
from datetime import date

import pytest

from pyspark.sql import functions as F

from factloom.functions import calendar
from factloom.operators import events, graph, linking, provenance, retrieval, rules


@pytest.mark.parametrize("words, block", [(10, 2000), (10, 7), (90, 2000), (90, 7), (1500, 7)])
def test_class_pairs(spark, monkeypatch, words, block):
    monkeypatch.setattr(linking, "_BLOCK", block)
    step = max(1, words // 25)
    sets = {d: {f"s{(d * 7 + j * j * step) % words}" for j in range(d % 9 + 1)} | {f"s{d % 3}"} for d in range(60)}
    signed = spark.createDataFrame([(d, x) for d, s in sets.items() for x in s], "doc_id long, sig string")
    _, alike = linking.signature_classes(signed, 0.2)
    members = {}
    for d, s in sorted(sets.items()):
        members.setdefault(frozenset(s), []).append(d)
    firsts, expected = sorted((m[0], s, len(m)) for s, m in members.items()), {}
    for i, (a, s, n) in enumerate(firsts):
        if n > 1:
            expected[a, a] = (1.0, n * (n - 1) // 2)
        for b, t, m in firsts[i + 1 :]:
            if len(s & t) / len(s | t) >= 0.2:
                expected[a, b] = (len(s & t) / len(s | t), n * m)
    found = alike.collect()
    assert {(r.a, r.b): (r.similarity, r.pairs) for r in found} == expected and len(found) == len(expected)


def test_class_pairs_meet_in_words(spark):
    """A pair costs operations on words, not on arrays of strings, and no pair is made twice."""
    signed = spark.createDataFrame([(d, f"s{j}") for d in range(20) for j in range(12) if (d + 1) >> (j % 5) & 1 or j > 7], "doc_id long, sig string")
    plan = linking.signature_classes(signed, 0.2)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "bit_count" in plan


def test_periods_and_connectors_are_read_once(spark):
    """An expression names its text once; a document's clauses are cut once, not at each edge."""
    row = spark.createDataFrame([("Within 21 days beginning with the notice",)], "s string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(row.select(rules.inclusivity_evidence(F.col("s")))).count("regexp_extract(") <= 2
    assert plan(row.select(calendar.offset_from_text(F.col("s"))["days"].alias("o"))).count("lower(s#") == 1
    docs = spark.createDataFrame([(1, "Payment falls due 21 days after the notice.")], "doc_id long, source_text string")
    facts = spark.createDataFrame([(1, "n", "Notice")], "doc_id long, fact_id string, entity string")
    deps = spark.createDataFrame([(1, "n", "a", "additive", "21 days", None), (1, "n", "b", "ordering", "", 3)], "doc_id long, from_id string, to_id string, constraint_type string, constraint_expr string, delta_days int")
    checked = provenance.check_relations(deps, facts, docs)
    assert plan(checked).count("(?<=[.;:])") == 1
    assert {(r.to_id, r.relation_verdict) for r in checked.collect()} == {("a", "supported"), ("b", None)}


def executed(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_event_classes_multiply_no_row(spark):
    row = "SELECT 'c' AS cluster, 1L AS doc_id, 1L AS pos, 'e' AS entity, 'START' AS role, DATE '2024-01-01' AS date_parsed, '2024-01-01' AS value, CAST(NULL AS INT) AS duration_days, 0.9D AS confidence, true AS temporal_content, true AS verified, CAST(NULL AS STRING) AS derivation"
    made = events.classify(spark.sql(row))
    assert "Expand" not in executed(made) and "Join" not in executed(made)
    assert [(r.status, r.n_docs, r.n_sources) for r in made.collect()] == [("single_source", 1, 1)]


def test_names_meet_at_lengths_that_occur(spark):
    documents = spark.createDataFrame([("n" * 300, ""), ("lone", "")], "doc_id string, source_text string")
    files = spark.createDataFrame([("n" * 301, "long"), ("lone_b", "b"), ("lone_c", "c")], "stem string, text string")
    found = retrieval.resolve_texts(documents, files)
    assert "sequence(1" not in executed(found)
    assert {(r.doc_id[:4], r.text, r.found_in) for r in found.collect()} == {("nnnn", "long", "only similar file"), ("lone", None, None)}


def test_passages_and_statistics_need_no_exchange_of_words(spark):
    documents = spark.createDataFrame([(d, "en", f"A clown came. The end of {d}.") for d in range(3)], "doc_id long, grp string, text string")
    best = retrieval.passages(documents.select("doc_id", F.col("text").alias("source_text")), "Which clown?")
    assert [(r.doc_id, r.start, r.sentence) for r in best.collect()] == [(d, 0, "A clown came.") for d in range(3)]
    assert "doc_id" not in "".join(x for x in executed(best).splitlines() if "Aggregate" in x)
    assert "count(distinct" not in executed(linking.token_statistics(documents).select("grp", "token", "df"))
    twice = documents.union(documents)
    assert {(r.token, r.df) for r in linking.token_statistics(twice).collect()} >= {("clown", 3), ("1", 1)}


@pytest.mark.parametrize("small", [0, 64])
def test_reach_inside_a_document_and_by_rounds(spark, monkeypatch, small):
    """Both ways find the same: first arrival, ties to the parent found first, then to the edge's place; cycles end."""
    monkeypatch.setattr(graph, "SMALL", small)
    rounds = []
    monkeypatch.setattr(graph, "_first", lambda df, *keys, _f=graph._first: rounds.append(1) or _f(df, *keys))
    edges = [("a", "b", 3, 1), ("a", "c", 1, 2), ("b", "d", 0, 10), ("c", "d", 5, 20), ("d", "a", 6, 1), ("d", "e", 7, None), ("z", "a", 8, 1)]
    deps = spark.createDataFrame([(k, *e, "") for k in (1, 2) for e in edges], "doc_id long, from_id string, to_id string, dep_pos int, delta_days int, constraint_expr string")
    start = spark.sql("SELECT 1L AS doc_id, 'a' AS fact_id, DATE '2024-01-01' AS date UNION ALL SELECT 3L, 'q', DATE '2024-01-01'")
    days = {"a": (0, 1, None), "b": (1, 2, "a"), "c": (1, 3, "a"), "d": (2, 23, "c"), "e": (3, None, "d")}
    for most in (None, 2):
        found = {(r.doc_id, r.fact_id): (r.hop, r.date and r.date.day, r.via) for r in graph.reach(start, deps, most).collect()}
        assert found == {(1, k): v for k, v in days.items() if most is None or v[0] <= most} | {(3, "q"): (0, 1, None)}
    assert bool(rounds) == (small == 0)


def linked(spark, rng):
    """Facts of three groups: 24 with common words, 24 with rare ones, and 4."""
    words = "the notice of payment delivery crane hull permit survey deck".split()
    said = lambda n: " ".join(rng.choices(words, weights=[9, 5, 5, 3, 3, 1, 1, 1, 1, 1], k=n))
    rare = lambda many, n: " ".join(f"w{rng.randrange(many)}" for _ in range(n))
    texts = {"g": lambda: (said(rng.randint(0, 3)) or None, said(rng.randint(2, 9))), "h": lambda: (said(2), said(3)), "k": lambda: (rare(12, 1), rare(40, 3))}
    rows = [(g, f"{g}{d:02}", f"f{i}", 2 * d + i, *texts[g](), rng.choice(["START", "END", "CONTAINS"]), date(2025, 1, 1 + rng.randrange(28)), None, None, 30) for g, n in (("g", 12), ("h", 2), ("k", 12)) for d in range(n) for i in range(2)]
    return spark.createDataFrame(rows, "grp string, doc_id string, fact_id string, pos int, entity string, sentence string, role string, date_parsed date, duration_days int, is_duplicate_of string, span_days int")


def test_pairs_of_facts_are_not_shuffled(spark, monkeypatch):
    """A pair is made once, where its facts lie whole: no aggregate and no join takes pairs."""
    facts = linked(spark, random.Random(3))
    for whole in (1000, 5):
        monkeypatch.setattr(linking, "_WHOLE", whole, raising=False)
        plan = executed(linking.candidate_pairs(facts)).splitlines()
        assert not [x for x in plan if "Aggregate" in x and "a_doc_id" in x]
        depth = lambda x: len(x) - len(x.lstrip(" :+-"))
        first = min((depth(x), x) for x in plan if "Join" in x)[1]
        assert "a_doc_id" in first and not [x for x in plan if "Join" in x and "a_doc_id" in x and "b_doc_id" not in x]
        assert sum("a_doc_id" in x for x in plan if "Join" in x) == (1 if whole == 1000 else 2)


@pytest.mark.parametrize("whole, vocabulary, floor, weighed", [(5, 5000, 0.12, False), (1, 5000, 0.7, True), (23, 5000, 0.3, True), (1000, 9, 0.12, True)])
def test_large_groups_meet_in_blocks(spark, monkeypatch, whole, vocabulary, floor, weighed):
    """Large groups, by words or as all pairs, give the pairs and scores of groups met whole, each once."""
    facts, met, found = linked(spark, random.Random(4)), {"g": Counter(), "h": Counter(), "k": Counter()}, []
    for r in facts.collect():
        met[r.grp].update({f"e {w}" for w in (r.entity or "").split()} | {f"q {w}" for w in r.sentence.split()})
    assert sum(n * n for n in met["k"].values()) < 24 * 24 < sum(n * n for n in met["g"].values())
    statistics = linking.token_statistics(facts.select("grp", "doc_id", F.concat_ws(" ", "entity", "sentence").alias("text"))) if weighed else None
    for limits in ((1000, 5000), (whole, vocabulary)):
        monkeypatch.setattr(linking, "_WHOLE", limits[0])
        monkeypatch.setattr(linking, "_VOCABULARY", limits[1])
        ids = ("grp", "a_doc_id", "a_fact_id", "b_doc_id", "b_fact_id")
        found.append(sorted((*[r[c] for c in ids], *[round(r[c], 9) for c in ("entity_score", "sentence_score", "temporal_score", "role_score", "score")]) for r in linking.candidate_pairs(facts, statistics, 0.3, floor).collect()))
    assert found[0] == found[1]
    assert len({r[:5] for r in found[0]}) == len(found[0]) > 20 and {r[0] for r in found[0]} >= {"g", "k"}


def test_heavy_words(spark):
    """The heaviest words, down to where the rest weighs less than the floor of all; none of an empty map."""
    heavy = lambda m, floor: spark.sql(f"SELECT {m} AS m").select(linking._heavy(F.col("m"), floor).alias("h")).first()["h"]
    assert heavy("map('a', 5.0D, 'b', 1.0D, 'c', 4.0D)", 0.12) == ["c", "a"]
    assert heavy("map('a', 5.0D, 'b', 1.0D, 'c', 4.0D)", 0.1) == ["b", "c", "a"]
    assert heavy("map('a', 5.0D, 'b', 1.0D, 'c', 4.0D)", 1.0) == ["a"]
    assert heavy("CAST(map() AS map<string, double>)", 0.12) == []
